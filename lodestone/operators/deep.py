"""The slow path: a deep pool, reranking by a model, merging with the fast path's anchors, and the queue that decides.

Passages are as in ``context``: query, ord, source, chunk, text, score, section.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import gates
from lodestone.operators.context import fetch_sections
from lodestone.operators.retrieval import mmr, top_k
from lodestone.operators.settle import settle

#: A model: questions and texts of one length to raw scores. A factory of it is called once in each Python task.
Model = Callable[[list[str], list[str]], np.ndarray]

# Sizes of the pool, of what the reranker keeps, of the anchors and of the merged candidate.
CANDIDATES, KEPT, BATCH, SIMPLE_FIRST, MERGED = 100, 60, 32, 12, 24
# Thresholds of the slow path.
DEEP = gates.Thresholds(score=0.35, borderline=0.30, passages=8, overlap=0.20, single_share=0.7)
ORIGINS = ("merged", "last_attempt", "fallback_snapshot")


def lexical_model() -> Model:
    """A stand-in for a cross-encoder that needs no files: the share of a question's stems that a text has, from -4 to 4."""
    import re

    def stems(text: str) -> set[str]:
        return {t[:5] for t in re.findall(r"[а-яёa-z0-9]+", (text or "").lower()) if len(t) >= 2}

    def score(questions: list[str], texts: list[str]) -> np.ndarray:
        return np.array([8 * len(q & stems(t)) / len(q) - 4 if q else -4.0 for q, t in ((stems(q), t) for q, t in zip(questions, texts, strict=True))])

    return score


def rerank(passages: DataFrame, questions: DataFrame, model: Callable[[], Model] = lexical_model, k: int = KEPT, batch: int = BATCH, dense_only: bool = True) -> DataFrame:
    """Each question's passages by the model's score, the first of equals first, at most ``k``: adds rerank_score and vector_score, replaces ord and score.

    questions: query, text. The model is loaded once in each task and sees
    ``batch`` pairs at a time; scores are squashed to 0..1. vector_score is
    ``dense`` where passages have it; unless ``dense_only``, a passage without
    one takes its score instead.
    """

    @F.pandas_udf("double")
    def raw(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = model()
        for asked, texts in pairs:
            parts = [scorer(asked.iloc[i : i + batch].tolist(), texts.iloc[i : i + batch].tolist()) for i in range(0, len(asked), batch)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    dense = F.col("dense") if "dense" in passages.columns else F.lit(None).cast("double")
    asked = questions.select("query", F.coalesce("text", F.lit("")).alias("__asked"))
    scored = passages.withColumn("vector_score", dense if dense_only else F.coalesce(dense, "score")).join(asked, "query")
    scored = scored.withColumn("__raw", raw("__asked", F.coalesce("text", F.lit("")))).withColumn("__p", 1 / (1 + F.exp(-F.col("__raw"))))
    best = top_k(scored, "query", [F.desc("__p"), F.asc("ord")], k)
    value = F.round("__p", 4)
    return best.withColumns({"ord": F.col("rank"), "score": value, "rerank_score": value}).drop("rank", "__asked", "__raw", "__p", "dense")


def deep_plan(pool: DataFrame, corpus: DataFrame, questions: DataFrame, model: Callable[[], Model] = lexical_model, most: int = CANDIDATES, k: int = KEPT, section_chunks: int = 50) -> DataFrame:
    """The fused pool in its order, then the anchors' sections, cut to ``most`` before the model ranks them."""
    dense = pool.select("query", "source", "chunk", "dense") if "dense" in pool.columns else None
    whole = fetch_sections(pool, corpus, most=section_chunks).filter(F.col("ord") <= most)
    if dense is not None:
        whole = whole.join(dense, ["query", "source", "chunk"], "left")
    return rerank(whole, questions, model, k)


def merge_with_anchors(simple: DataFrame, deep: DataFrame, first: int = SIMPLE_FIRST, most: int = MERGED, weight: float = 0.7) -> DataFrame:
    """query, ord, source, chunk: the fast path's first passages, then new ones of the slow path by marginal relevance, ``most`` in all.

    A question for which the slow path has nothing new has no merged candidate.
    """
    anchors = settle(simple.filter(F.col("ord") <= first).select("query", "ord", "source", "chunk"), "anchors")
    new = deep.join(anchors.select("query", "source", "chunk"), ["query", "source", "chunk"], "left_anti")
    sizes = anchors.groupBy("query").agg(F.count("*").cast("int").alias("n"))
    relevance = F.coalesce("rerank_score", F.nullif("vector_score", F.lit(0.0)), "score", F.lit(0.0))
    pool = new.join(sizes, "query", "left").select("query", "ord", F.struct("source", "chunk").alias("doc"), F.col("source").alias("family"), relevance.alias("relevance"), F.greatest(F.lit(most) - F.coalesce("n", F.lit(0)), F.lit(0)).alias("room"))
    pool = settle(pool, "pool")
    picked = mmr(pool, "room", weight)
    tail = picked.join(sizes, "query", "left").select("query", (F.col("rank") + F.coalesce("n", F.lit(0))).alias("ord"), "doc.source", "doc.chunk")
    head = anchors.join(pool.select("query").distinct(), "query", "left_semi")
    return head.unionByName(tail)


def complex_queue(queue: DataFrame, contexts: DataFrame, questions: DataFrame, prior: DataFrame, t: gates.Thresholds = DEEP) -> tuple[DataFrame, DataFrame]:
    """The decision of each question (query, origin, route, reason, n_passages) and what was rejected on the way (query, origin, unmet, verdict, n_passages).

    queue: query, place (from 0), origin and pack_status, a row for each
    candidate; contexts: query, place, ord, source, chunk, text, score: the
    packed passages of each (none for an empty candidate; score is the dense one
    or null); questions: query, text; prior: query, source, chunk, the fast
    path's context. Strict acceptance goes before everything, in order of the
    queue. Failing that, of the candidates that miss one tolerated obligation the one with
    the highest score, then the most passages, then the first. Otherwise the question is given up.
    """
    key = F.concat_ws("|", F.col("query").cast("string"), F.col("place").cast("string"))
    queue = queue.withColumn("__key", key)
    rows = contexts.withColumn("__key", key)
    asked = queue.join(questions, "query").select(F.col("__key").alias("query"), "text", "pack_status")
    packed = settle(rows.select(F.col("__key").alias("query"), "ord", F.col("source").alias("family"), "text", "score"), "packed")
    signals = gates.signals(packed, asked.select("query", "text"))
    news = rows.join(prior.select("query", "source", "chunk"), ["query", "source", "chunk"], "left_anti").join(prior.select("query").distinct(), "query", "left_semi").select(F.col("__key").alias("query"))
    triaged = gates.triage(gates.hard_gates(signals, t), t).join(asked.select("query", "pack_status"), "query")
    judged = gates.obligations(triaged, asked, gates.open_references(packed), t, news)
    judged = judged.withColumns({"strict": gates.accepts(), "tolerated": gates.accepts(on_complex=True, last=True)}).withColumnRenamed("query", "__key")
    table = settle(queue.drop("pack_status").join(judged, "__key"), "judged")
    order = Window.partitionBy("query").orderBy(F.desc("strict"), F.desc("tolerated"), F.desc(F.when(~F.col("strict"), F.col("top_score"))), F.desc(F.when(~F.col("strict"), F.col("n_passages"))), "place")
    best = table.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    taken = F.col("strict") | F.col("tolerated")
    reason = (
        F.when(F.col("strict"), F.when(F.col("origin") == ORIGINS[2], "complex_fallback_accepted").otherwise("complex_sufficient"))
        .when(~F.col("tolerated"), "complex_exhausted")
        .when(F.col("unmet") == F.array(F.lit(gates.REFS)), "refs_best_effort")
        .otherwise("enumeration_best_effort")
    )
    decided = best.select("query", F.when(taken, F.col("origin")).alias("origin"), F.when(taken, "generate").otherwise("abstain").alias("route"), reason.alias("reason"), F.when(taken, F.col("n_passages")).otherwise(0).alias("n_passages"), F.when(F.col("strict"), F.col("place")).alias("__until"))
    # a strict acceptance ends the queue; what stands behind it was never looked at
    lost = table.join(decided.select("query", F.col("origin").alias("__won"), "__until"), "query")
    lost = lost.filter((F.col("place") < F.coalesce("__until", F.lit(1 << 30))) & ~F.col("origin").eqNullSafe(F.col("__won")))
    return decided.drop("__until"), lost.select("query", "origin", "unmet", "verdict", "n_passages")
