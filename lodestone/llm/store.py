"""Tables written between the passes of an operator.

They go to the shared folder that the session names in ``spark.checkpoint.dir``,
so that every executor can read them and the loss of one loses nothing. Only a
local session may do without the setting (tests, notebooks): it gets a temporary
folder. Anywhere else its absence raises, as a folder of the driver's machine
would not be seen by executors.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once; Spark's own bound of 64 MB weighs several times that, in the JVM and in the worker, for each running task.
BATCH_BYTES = 4 << 20
#: Rows of a file of a table whose number of rows is known.
FILE_ROWS = 500_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Caps the session's Arrow batches at BATCH_BYTES; a lower setting stays."""
    if int(spark.conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write once as Parquet and read back: cuts lineage and fixes row contents.

    Where ``rows`` bounds the table, its files are as few as that allows; else
    each task writes one, however small.

    The pass's shuffle files go as soon as it has ended; Spark would keep them
    until the driver collects garbage.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CONF)
    spark.conf.set(_SHUFFLE_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CONF, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    for made in _watched.get(spark, ()):
        made.append(out)
    return out


#: By session, lists that get each table that is written.
_watched: weakref.WeakKeyDictionary[SparkSession, list[list[DataFrame]]] = weakref.WeakKeyDictionary()


@contextmanager
def tables_made(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """The tables that are written in the body, for a later ``release``."""
    made: list[DataFrame] = []
    _watched.setdefault(spark, []).append(made)
    try:
        yield made
    finally:
        _watched[spark] = [x for x in _watched[spark] if x is not made]


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lodestone_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
