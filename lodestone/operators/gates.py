"""Sufficiency gates, obligations and decisions over the passages of each question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.references import contains_unit, references, wants_all
from lodestone.functions.text import prefix_stems


# Thresholds of the simple path.
@dataclass(frozen=True)
class Thresholds:
    score: float = 0.5
    borderline: float = 0.38
    passages: int = 5
    overlap: float = 0.15
    original_overlap: float = 0.0
    single_share: float = 0.8
    multi_doc: bool = False


REFS, ORIGINAL, ENUM = "refs_resolved", "original_overlap", "enumeration_complete"


def diversity(passages: DataFrame) -> DataFrame:
    """query, n_families, max_share over (query, family)."""
    per = passages.groupBy("query", "family").agg(F.count("*").alias("n"))
    return per.groupBy("query").agg(F.count("*").alias("n_families"), F.round(F.max("n") / F.sum("n"), 6).alias("max_share"))


def _overlap(asked: F.Column, held: F.Column) -> F.Column:
    """The share of the asked terms that are held; 1 without terms."""
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)), F.size(asked)), F.lit(1.0)), 6)


def keyword_overlap(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query, overlap: the share of the query's distinct stems that some passage holds; 1 for a query without stems."""
    stems = queries.select("query", F.explode_outer(F.array_distinct(prefix_stems(F.col("text")))).alias("term"))
    held = passages.select("query", F.explode(F.array_distinct(prefix_stems(F.col("text")))).alias("term")).distinct().withColumn("held", F.lit(1))
    joined = stems.join(held, ["query", "term"], "left")
    return joined.groupBy("query").agg(F.round(F.coalesce(F.try_divide(F.count("held"), F.count("term")), F.lit(1.0)), 6).alias("overlap"))


def signals(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """All that the gates need of each question, from one aggregation over its passages.

    passages: query, family, text, score (null where no dense score is known);
    questions: query, text and, if it was rewritten, active. A question's
    passages are a short list; one without a known family counts for no family.
    A question without any passages has no families, share 1 and overlaps of 0.
    """
    active = F.col("active") if "active" in questions.columns else F.col("text")
    asked = questions.select("query", F.array_distinct(prefix_stems(F.col("text"))).alias("asked"), F.array_distinct(prefix_stems(active)).alias("active"))
    own = F.struct(F.col("family"), F.array_distinct(prefix_stems(F.col("text"))).alias("stems"))
    per = passages.select("query", "score", own.alias("p")).groupBy("query").agg(F.count("*").alias("n_passages"), F.max(F.coalesce("score", F.lit(0.0))).alias("top_score"), F.collect_list("p").alias("ps"))
    held = F.array_distinct(F.flatten(F.transform("ps", lambda p: p["stems"])))
    families = F.filter(F.transform("ps", lambda p: p["family"]), lambda f: f.isNotNull())
    most = F.array_max(F.transform(F.array_distinct(families), lambda f: F.size(F.filter(families, lambda g: g == f))))
    some = F.col("n_passages").isNotNull()
    return asked.join(per, "query", "left").select(
        "query",
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.when(some, _overlap(F.col("active"), held)).otherwise(0.0).alias("overlap"),
        F.when(some, _overlap(F.col("asked"), held)).otherwise(0.0).alias("overlap_original"),
        F.when(some, F.size(F.array_distinct(families))).otherwise(0).cast("long").alias("n_families"),
        F.when(some, F.coalesce(F.round(F.try_divide(most, F.size(families)), 6), F.lit(1.0))).otherwise(1.0).alias("max_share"),
    )


def hard_gates(signals: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds pass_score, pass_count, pass_overlap, sufficient; a question without passages passes none."""
    some = F.col("n_passages") > 0
    out = signals.withColumns(
        {
            "pass_score": some & (F.coalesce(F.col("top_score"), F.lit(0.0)) >= t.score),
            "pass_count": some & (F.col("n_passages") >= t.passages),
            "pass_overlap": some & (F.col("overlap") >= t.overlap),
        }
    )
    return out.withColumn("sufficient", F.col("pass_score") & F.col("pass_count") & F.col("pass_overlap"))


def triage(gated: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds diverse, hard_ok and verdict; one family too many blocks only where several documents are required."""
    diverse = F.col("max_share") <= t.single_share
    ok = F.col("sufficient") & diverse if t.multi_doc else F.col("sufficient")
    bad = (F.coalesce(F.col("top_score"), F.lit(0.0)) < t.borderline) | ~F.col("pass_count")
    return gated.withColumns({"diverse": diverse, "hard_ok": ok, "verdict": F.when(ok, "sufficient").when(bad, "clearly_bad").otherwise("borderline")})


def open_references(passages: DataFrame, first: int = 5) -> DataFrame:
    """query, kind, num, resolved: what the first passages of a question refer to, and whether its passages hold it.

    passages: query, ord (from 1), family, text. A reference is held if some
    passage of the same family holds the unit itself; one number that two
    families name is resolved only if both hold theirs.
    """
    named = passages.filter(F.col("ord") <= first).select("query", "family", F.explode(references(F.col("text"))).alias("r"))
    named = named.select("query", "family", "r.kind", "r.num").distinct()
    near = passages.select("query", "family", F.col("text").alias("body"))
    held = named.join(near, ["query", "family"], "left").groupBy("query", "family", "kind", "num")
    held = held.agg(F.max(contains_unit(F.col("kind"), F.col("num"), F.coalesce("body", F.lit("")))).alias("ok"))
    return held.groupBy("query", "kind", "num").agg(F.min("ok").alias("resolved"))


def obligations(triaged: DataFrame, questions: DataFrame, gaps: DataFrame, t: Thresholds = Thresholds(), new_ids: DataFrame | None = None) -> DataFrame:
    """Adds unmet, the sorted obligations that the context does not meet.

    gaps: of ``open_references``. ``new_ids``: the queries whose context has
    passages beyond the earlier one; a complete list cannot be met without any.
    ``triaged`` may have pack_status; a degraded one leaves references open.
    """
    status = F.col("pack_status") if "pack_status" in triaged.columns else F.lit("ok")
    still = gaps.groupBy("query").agg(F.max(~F.col("resolved")).alias("gap"))
    asks = questions.select("query", wants_all(F.col("text")).alias("all"))
    out = triaged.join(still, "query", "left").join(asks, "query", "left")
    if new_ids is None:
        out = out.withColumn("new", F.lit(False))
    else:
        out = out.join(new_ids.select("query", F.lit(True).alias("new")).distinct(), "query", "left")
    empty = F.col("n_passages") == 0
    unmet = F.array_compact(
        F.array(
            F.when(F.col("all") & (empty | ~F.coalesce("new", F.lit(False))), F.lit(ENUM)),
            F.when((F.col("overlap_original") <= 0) | (F.col("overlap_original") < t.original_overlap), F.lit(ORIGINAL)),
            F.when((status == "degraded") | F.coalesce("gap", F.lit(False)) | empty, F.lit(REFS)),
        )
    )
    return out.withColumn("unmet", unmet).drop("gap", "all", "new")


def accepts(on_complex: bool = False, last: bool = False) -> F.Column:
    """Whether a candidate (n_passages, hard_ok, unmet, pack_status) is taken; the last one of the complex path may miss one obligation."""
    spared = (F.col("unmet") == F.array(F.lit(REFS))) & (F.col("pack_status") == "ok") | (F.col("unmet") == F.array(F.lit(ENUM)))
    met = F.size("unmet") == 0
    return (F.col("n_passages") > 0) & F.col("hard_ok") & (met | spared if on_complex and last else met)


def decide(validated: DataFrame, abstain_on_empty: bool = True) -> DataFrame:
    """Adds route and reason of the simple path; the first row of the table that fits decides.

    validated: n_passages, overlap, overlap_original, verdict, hard_ok, unmet
    and, optionally, retrieval_error and pack_status.
    """
    for name, default in (("retrieval_error", F.lit(False)), ("pack_status", F.lit("ok"))):
        if name not in validated.columns:
            validated = validated.withColumn(name, default)
    gone = "abstain" if abstain_on_empty else "complex"
    told = "" if abstain_on_empty else "_escalated"
    lacks = lambda what: F.array_contains("unmet", what)
    rules = (
        (F.col("retrieval_error"), "abstain", "retrieval_error"),
        (F.col("n_passages") == 0, gone, "empty_pool" + told),
        ((F.col("overlap") <= 0) & (F.col("overlap_original") <= 0), gone, "zero_overlap_both" + told),
        (lacks(ENUM), "complex", "enumeration_intent"),
        (lacks(REFS), "complex", "refs_unresolved"),
        (lacks(ORIGINAL), "complex", "zero_overlap_original"),
        (F.col("verdict") == "borderline", "complex", "triage_borderline"),
        (F.col("verdict") == "clearly_bad", "complex", "triage_clearly_bad"),
        (accepts(), "generate", "context_sufficient"),
    )
    route, reason = F.lit("complex"), F.lit("triage_borderline")
    for when, to, why in reversed(rules):
        route, reason = F.when(when, to).otherwise(route), F.when(when, why).otherwise(reason)
    return validated.withColumn("route", route).withColumn("reason", reason)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Of each query's accepted candidates (query, place, accepted, top_score, n_passages) the one with the highest score, then the most passages, then the first."""
    return candidates.filter("accepted").groupBy("query").agg(F.max_by("place", F.struct("top_score", "n_passages", -F.col("place"))).alias("place"))
