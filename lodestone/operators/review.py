"""What a person or a stronger judge has to look at, and samples that all variants share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import quote_holds

# Fixed value: a review below this confidence goes to a person.
CONFIDENT = 0.75


def common_sample(covered: DataFrame, variants: Sequence[str]) -> DataFrame:
    """covered: question, variant, ok for each label -> question, missing (variants that cover no label, in the order given); a question is kept where none is missing.

    Only one array of at most as many names as there are variants is gathered a question.
    """
    names = F.array(*map(F.lit, variants))
    per = covered.groupBy("question").agg(F.collect_set(F.when(F.col("ok"), F.col("variant"))).alias("have"))
    return per.select("question", F.array_except(names, "have").alias("missing"))


def rejected_with_quote(arbiter: DataFrame, cited: DataFrame) -> DataFrame:
    """arbiter: n, relevant; cited: n -> n of questions where the arbiter found nothing although an annotator had a quote."""
    empty = F.coalesce(F.size("relevant") == 0, F.lit(True))
    return arbiter.filter(empty).select("n").join(cited.select("n"), "n", "left_semi")


def unverified_quotes(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """labels: n, chunk_id, quote; candidates: n, chunk_id (unique in n), text -> n, n_labels, n_unverified.

    A quote of a chunk that was no candidate, or without letters, is not verified.
    """
    holds = F.coalesce(quote_holds(F.col("text"), F.col("quote")), F.lit(False))
    return labels.select("n", "chunk_id", "quote").join(candidates.select("n", "chunk_id", "text"), ["n", "chunk_id"], "left").groupBy("n").agg(F.count("*").alias("n_labels"), F.count_if(~holds).alias("n_unverified"))


def loss_reason(before: Column, after: Column, unlimited: Column, parentless: Column) -> Column:
    """Why a variant lost what another found: the budget, if without one it is found; a missing parent; other. Null where nothing is lost."""
    return F.when(before & ~after, F.when(unlimited, "budget").when(parentless, "missing_parent").otherwise("other"))


def needs_human(verdict: Column, confidence: Column, confident: float = CONFIDENT) -> Column:
    """Every drop, and whatever is not sure; a missing confidence is none."""
    return (verdict == "drop") | (F.coalesce(confidence, F.lit(0.0)) < confident)
