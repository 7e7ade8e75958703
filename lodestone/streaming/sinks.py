"""Sinks of telemetry: a table that ignores known keys, a journal of JSON lines, and the first backed by the second.

All are written by ``foreachBatch`` and may be given a batch twice: each batch
has a folder of its own in the table and in the journal, which a retry
overwrites. What the table could not take lies in the journal until ``replay``
offers it again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)
Writer = Callable[[DataFrame, int], None]


def _read(spark: SparkSession, path: str, schema: StructType, form: str, **options: str) -> DataFrame:
    """The rows under a folder; none if it was never written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(recursiveFileLookup="true", **options).format(form).load(path)


@dataclass
class KeyedTable:
    """A folder of Parquet with one row for each key; the first row of a key stays."""

    path: str
    schema: StructType
    key: str = "query_id"

    def read(self, spark: SparkSession) -> DataFrame:
        return _read(spark, self.path, self.schema, "parquet")

    def write(self, rows: DataFrame, batch: int | str) -> None:
        """Adds rows of unknown keys. A batch that is written again is compared with all others, not with itself."""
        spark = rows.sparkSession
        mine = f"/batch-{batch}/"
        known = self.read(spark).withColumn("__file", F.input_file_name()).filter(~F.contains("__file", F.lit(mine))).select(self.key)
        names = self.schema.fieldNames()
        others = [c for c in names if c != self.key]
        one = rows.select(*names).filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*others)).alias("r")).select(self.key, "r.*").select(*names)
        one.join(known, self.key, "left_anti").select(*names).write.mode("overwrite").parquet(f"{self.path}{mine.rstrip('/')}")


@dataclass
class Journal:
    """A folder of JSON lines, one line an event."""

    path: str

    def write(self, rows: DataFrame, batch: int | str) -> None:
        rows.write.mode("overwrite").json(f"{self.path}/batch-{batch}")

    def read(self, spark: SparkSession, schema: StructType) -> tuple[DataFrame, DataFrame]:
        """(events, rejects): lines that are no JSON object, or that have no query_id, are rejected."""
        rows = _read(spark, self.path, schema.add("_bad", "string") if "_bad" not in schema.fieldNames() else schema, "json", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        good = F.col("_bad").isNull() & (F.coalesce("query_id", F.lit("")) != "")
        return rows.filter(good).drop("_bad"), rows.filter(~good)


@dataclass
class Fallback:
    """The primary writer, with the journal behind it; a failure of both is logged and never reaches the stream."""

    primary: Writer
    backup: Writer
    lost: list[int] = field(default_factory=list)
    """Batches that neither took."""

    def __call__(self, rows: DataFrame, batch: int) -> None:
        try:
            self.primary(rows, batch)
        except Exception as error:  # noqa: BLE001  monitoring never stops what it watches
            log.warning("batch %s goes to the journal: %s", batch, error)
            try:
                self.backup(rows, batch)
            except Exception as worse:  # noqa: BLE001
                log.warning("batch %s is lost: %s", batch, worse)
                self.lost.append(batch)


def fill_found_count(events: DataFrame) -> DataFrame:
    """Older events lack n_passages_found; n_passages was the same count then."""
    return events.withColumn("n_passages_found", F.coalesce("n_passages_found", "n_passages"))


@dataclass(frozen=True)
class Report:
    offered: int
    written: int
    skipped: int


def replay(spark: SparkSession, journal: Journal, table: KeyedTable, name: str = "replay") -> Report:
    """Offers the journal's events to the table. Known keys are ignored, so it may run again and again; rejects are counted."""
    events, rejects = journal.read(spark, StructType(list(table.schema.fields)))
    if {"n_passages", "n_passages_found"} <= set(events.columns):
        events = fill_found_count(events)
    before = table.read(spark).count()
    table.write(events, name)
    return Report(events.count(), table.read(spark).count() - before, rejects.count())


def start(events: DataFrame, sink: Writer, checkpoint: str, **trigger):
    """A stream of events into a sink; ``availableNow=True`` by default, so that it ends."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
