"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Quality rules drop what they reject; line dedup cuts repeated runs, and drops a
document of which nothing is left; of each group of near duplicates one document
stays; mixing repeats or drops documents by their rates; encoding gives ids.

Null texts are rejected by the first stage, as texts without words are. Repeated
rows are documents of their own up to the third stage, which keeps one of them.
Null or repeated doc_ids are kept as they are. Columns beyond those of documents
go when the tables are read. An empty table passes through all stages.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, lines, mixing, pieces, quality
from lodestone.llm.store import materialize, release, tables_made
from lodestone.llm.text import BLANK_SET

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By session, the tables that the operators of the stage before have written.
_left: weakref.WeakKeyDictionary[SparkSession, list[DataFrame]] = weakref.WeakKeyDictionary()


def after_the_last(stage: Stage) -> Stage:
    """A stage starts when its predecessor's result has been written and read again, so the predecessor's own tables go then.

    Only if ``docs`` still reads one of them do they stay. A stage's result must
    be written before the next stage is called in the same session.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.pop(spark, [])
        files = docs.inputFiles() if left else []
        used = [t for t in left if any(f"/{t._lodestone_path.rpartition('/')[2]}/" in f for f in files)]
        if not used:
            release(*left)
        with tables_made(spark) as made:
            out = stage(spark, docs, sf_dir)
        _left[spark] = [*used, *made]
        return out

    return run_stage


@after_the_last
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_rules(docs).filter("kept").select(*docs.columns)


@after_the_last
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.trim("text", F.lit(BLANK_SET)) != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@after_the_last
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; links are five-word shingle sets alike by 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, over=80)


@after_the_last
def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    mixed = mixing.mix(docs, labels).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


@after_the_last
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_texts(docs, pieces.read_model(pieces.public_model()))
    return encoded.select("doc_id", "lang", "source", "ids", "n_ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("mixing", mixing_weights),
    ("sentencepiece", sentencepiece),
]

#: Encoding, and the classifier before it, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
            release(before)
    return docs
