"""Chunks by public id, and the outcome of a retrieval on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import public_id

# Fixed value: how ids of the address layer begin, ``addr:kind:number`` or ``addr:table:number.row``.
ADDRESS = "addr:"


def get_chunks(asked: DataFrame, chunks: DataFrame, addresses: DataFrame) -> DataFrame:
    """asked: chunk_id; chunks: source, local, text; addresses: source, kind, num, row, ord, text -> chunk_id, found, doc_id, text, error.

    An id is ``source::local``. A local id is met as it stands, then as a whole
    number; of several chunks the one with the smallest id and text is taken. A
    table without a row takes the first record of all its rows, by ord and text.
    Repeated ids are answered once; an id without a source is an error. Both
    lookups are joins on source and key: only asked keys are looked for, and what
    is asked of one source is spread over its keys.
    """
    # A generator's columns are made once: what is asked of them below is not copied into the plan that made the ids.
    parts = asked.select("chunk_id").distinct().select("chunk_id", F.inline(F.array(public_id(F.col("chunk_id")))))
    ids = parts.withColumn("source", F.nullif("source", F.lit("")))
    at_address = F.col("rest").startswith(ADDRESS)
    whole = F.when(F.rlike("rest", F.lit(r"^\s*[+-]?\d+\s*$")), F.trim("rest").try_cast("long").cast("string"))
    keys = ids.filter(F.col("source").isNotNull() & ~at_address).select("chunk_id", "source", F.posexplode(F.array_compact(F.array_distinct(F.array("rest", whole)))).alias("turn", "local"))
    plain = keys.join(chunks.select("source", F.col("local").cast("string").alias("local"), "text"), ["source", "local"]).select("chunk_id", "text", F.struct("turn", "local", "text").alias("at"))
    spec = F.substring("rest", F.lit(len(ADDRESS) + 1), F.length("rest"))
    kind, tail = F.substring_index(spec, ":", 1), F.regexp_replace(spec, r"^[^:]*:?", "")
    table = kind == "table"
    want = ids.filter(F.col("source").isNotNull() & at_address).select(
        "chunk_id",
        "source",
        kind.alias("kind"),
        F.when(table, F.substring_index(tail, ".", 1)).otherwise(tail).alias("num"),
        F.when(table, F.nullif(F.regexp_replace(tail, r"^[^.]*\.?", ""), F.lit(""))).alias("wanted"),
    )
    records = addresses.select("source", "kind", F.col("num").cast("string").alias("num"), F.col("row").cast("string").alias("row"), "ord", "text")
    met = want.join(records, ["source", "kind", "num"]).filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("row")))
    by_address = met.groupBy("chunk_id").agg(F.min(F.struct("ord", "text")).alias("r")).select("chunk_id", F.col("r.text").alias("text"))
    by_key = plain.groupBy("chunk_id").agg(F.min_by("text", "at").alias("text"))
    got = by_key.unionByName(by_address).withColumn("hit", F.lit(True))
    out = ids.join(got, "chunk_id", "left").withColumn("found", F.coalesce("hit", F.lit(False)))
    return out.select("chunk_id", "found", F.when(F.col("found"), F.col("source")).alias("doc_id"), "text", F.when(F.col("source").isNull(), "no source").alias("error"))


def outcome(clarification: Column, route: Column, failed: Column, reason: Column, attempts: Column) -> Column:
    """ready, clarification, failed, empty or insufficient; attempts: how many passages each try found.

    A question back goes first. A technical failure counts only where nothing
    was accepted. Without a passage in any try the outcome is empty.
    """
    none = ~F.coalesce(F.exists(attempts, lambda n: n > 0), F.lit(False))
    return (
        F.when(F.coalesce(clarification, F.lit("")) != "", "clarification")
        .when(route == "generate", "ready")
        .when(F.coalesce(failed, F.lit(False)), "failed")
        .when(F.coalesce(reason == "empty_pool", F.lit(False)) | none, "empty")
        .otherwise("insufficient")
    )


def final_context(outcome_: Column, passages: Column) -> Column:
    """Passages of a ready retrieval; nothing that was not accepted is shown."""
    return F.when(outcome_ == "ready", passages).otherwise(F.slice(passages, 1, 0))
