"""A judge's checks of an answer, held against the texts they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import quote_holds

# What a check may say, and fields whose omission does not count.
MATCH, MISMATCH, UNVERIFIABLE, MISSING = "match", "mismatch", "unverifiable", "missing_in_answer"
OPTIONAL_FIELDS = ("date", "edition")


def _bad_quote(quote: Column, text: Column) -> Column:
    """A quote is null, or it holds letters and stands in its text."""
    return quote.isNotNull() & ~F.coalesce(quote_holds(text, quote), F.lit(False))


def verdicts(answers: DataFrame, checks: DataFrame, optional: tuple[str, ...] = OPTIONAL_FIELDS) -> DataFrame:
    """answers: id, answer, context; checks: id, ord, field, comparison, answer_quote, context_quote -> id, status, complete, n_checks, problem.

    fail goes before needs_review before pass. A match or mismatch needs both
    quotes, an omission the context's; every quote must stand in its text. The
    first check that breaks this makes the status format_error and names the
    problem. An omission with a quote from the answer contradicts itself and
    goes to a human, unless its field is optional. Without any confirmed check a
    human looks. complete: nothing obligatory is left out.
    """
    texts = answers.select("id", "answer", "context")
    c, spared = F.col("comparison"), F.coalesce(F.col("field").isin(*optional), F.lit(False))
    problem = (
        F.when(_bad_quote(F.col("answer_quote"), F.col("answer")), "answer_quote")
        .when(_bad_quote(F.col("context_quote"), F.col("context")), "context_quote")
        .when(c.isin(MATCH, MISMATCH) & (F.col("answer_quote").isNull() | F.col("context_quote").isNull()), "both quotes")
        .when((c == MISSING) & F.col("context_quote").isNull(), "context_quote required")
        .when(~F.coalesce(c.isin(MATCH, MISMATCH, UNVERIFIABLE, MISSING), F.lit(False)), "comparison")
    )
    contradicts = (c == MISSING) & F.col("answer_quote").isNotNull() & ~spared
    severity = F.when(c == MISMATCH, 2).when((c == UNVERIFIABLE) | contradicts, 1).otherwise(0)
    rows = checks.join(texts, "id").select("id", "ord", problem.alias("p"), severity.alias("s"), (c == MATCH).alias("m"), ((c == MISSING) & ~spared).alias("out"))
    per = rows.groupBy("id").agg(F.count("*").alias("n"), F.max("s").alias("s"), F.max("m").alias("m"), F.max("out").alias("out"), F.min(F.when(F.col("p").isNotNull(), F.struct("ord", "p"))).alias("first"))
    status = F.when(F.col("n").isNull(), "needs_review").when(F.col("first").isNotNull(), "format_error").when(F.col("s") == 2, "fail").when((F.col("s") == 1) | ~F.col("m"), "needs_review").otherwise("pass")
    return texts.select("id").join(per, "id", "left").select("id", status.alias("status"), (~F.coalesce("out", F.lit(False))).alias("complete"), F.coalesce("n", F.lit(0)).alias("n_checks"), F.col("first.p").alias("problem"))
