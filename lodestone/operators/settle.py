"""Small tables that several joins of one operator read: written once, so that what made them runs once.

They go to the folder that the session names in ``spark.checkpoint.dir``, which
driver and executors share; only a local session may do without it and gets a
temporary one. A lost executor loses nothing, and no block stays cached.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, tag: str = "settled") -> DataFrame:
    """The same rows, read from a table that is written now."""
    path = f"{_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
