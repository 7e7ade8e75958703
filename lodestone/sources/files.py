"""Sources and sinks: JSON lines, CSV, binary listings, journals, snapshots, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.packing import last_wins

LABELS = T.StructType([T.StructField("question", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("relevant_chunk_ids", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())])
EVENTS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("path", T.StringType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("_bad", T.StringType())])


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, digest (SHA-256 of the content), recursively."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.sha2("content", 256).alias("digest"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labels: trimmed; rows without question or chunk go; labels and source get their defaults."""
    rows = spark.read.schema(LABELS).json(path).withColumn("question", F.trim("question"))
    rows = rows.filter((F.coalesce("question", F.lit("")) != "") & (F.coalesce("chunk_id", F.lit("")) != ""))
    return rows.withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", F.array("chunk_id"))).withColumn("source", F.coalesce("source", F.substring_index("chunk_id", "#", 1)))


def read_golden(spark: SparkSession, path: str, required: tuple[str, ...], key: str) -> DataFrame:
    """CSV with a header; missing columns or repeated keys are errors."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if rows.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return rows


def replay_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, one per query_id; rejects): torn lines and lines without an id are rejected, the earliest of repeats stays."""
    rows = spark.read.schema(EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull() & F.col("query_id").isNotNull()
    others = [c for c in rows.columns if c not in ("query_id", "_bad")]
    kept = rows.filter(good).groupBy("query_id").agg(F.min_by(F.struct(*others), F.struct("ts", "path", "cost_usd")).alias("r")).select("query_id", "r.*")
    return kept, rows.filter(~good)


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose key the target does not have, one per key."""
    return rows.dropDuplicates([key]).join(target, key, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return last_wins(target.unionByName(rows), key, order)


def keyed_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: created, updated, unchanged or stale."""
    both = old.select(key, F.col(content).alias("c0"), F.lit(1).alias("o")).join(new.select(key, F.col(content).alias("c1"), F.lit(1).alias("n")), key, "full")
    change = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "stale").when(F.col("c0").eqNullSafe(F.col("c1")), "unchanged").otherwise("updated")
    return both.select(key, change.alias("change"))


def write_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Writes, reads again and compares as bags; an incomplete write is an error."""
    rows.write.parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if rows.exceptAll(back).limit(1).count() or back.exceptAll(rows).limit(1).count():
        raise ValueError("the snapshot differs from what was written")
    return back


def scope(**allowed: str | list[str] | None):
    """A predicate over metadata: equality or membership, a missing value being a value of its own."""
    out = F.lit(True)
    for column, want in allowed.items():
        out = out & (F.col(column).isin(want) if isinstance(want, list) else F.col(column).eqNullSafe(F.lit(want)))
    return out
