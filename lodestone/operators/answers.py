"""Figures of generated answers: runs, refusals, inversions, citations, evaluators.

``by`` names the columns of a group (a run, a path); without any there is one
row over everything. Each figure is one aggregation that combines before it
exchanges, so a group that holds most rows is no hot task. Shares of nothing
are 0, or 1 where nothing could go wrong. Rounding is half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import FRAGMENT, fragments

# What a refusal says in its first characters, and the score below which a short path was not enough.
REFUSAL, REFUSAL_WINDOW, ENOUGH = r"(?U)\bнет\b|не могу", 200, 5.0
END = "end of the reply"


def _share(hit: Column, among: Column, empty: float) -> Column:
    """Of the rows ``among`` the share with ``hit``; ``empty`` where there are none. Nulls are false."""
    among = F.coalesce(among, F.lit(False))
    n = F.count_if(among)
    return F.when(n == 0, F.lit(empty)).otherwise(F.count_if(among & F.coalesce(hit, F.lit(False))) / n)


def _blank(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"(?U)^\s*$")), F.lit(True))


def abstained(answer: Column, flag: Column) -> Column:
    """The flag says so, or there is nothing in the answer."""
    return F.coalesce(flag, F.lit(False)) | _blank(answer)


def refused(answer: Column, pattern: str = REFUSAL) -> Column:
    """An answer that says no in its beginning, or an empty one; without an answer null."""
    return (answer == "") | F.rlike(F.substring(F.lower(answer), 1, REFUSAL_WINDOW), F.lit(pattern))


def inverted(answer: Column, forbidden: Column) -> Column:
    """One of the patterns, parted by ``|``, stands in the answer, case aside."""
    patterns = F.filter(F.transform(F.split(F.lower(forbidden), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.exists(patterns, lambda p: F.contains(F.lower(answer), p)), F.lit(False))


def scorable(r: DataFrame) -> Column:
    """Whether an answer counts for correctness: checked reference, in scope, answered, scored, no error."""
    return answered(r) & (F.coalesce(r["reference_status"], F.lit("")) == "verified") & (F.coalesce(r["oos_type"], F.lit("")) == "") & r["correctness"].isNotNull()


def answered(r: DataFrame) -> Column:
    return r["error"].isNull() & ~F.coalesce(r["generation_failed"], F.lit(False)) & (F.coalesce(r["answer"], F.lit("")) != "")


def run_summary(results: DataFrame, *by: str, pattern: str = REFUSAL) -> DataFrame:
    """One row a group of results: how many were answered, failed, abstained, and how good the answers are.

    results: path, answer (null where the run broke off), error, generation_failed,
    route_decision, abstain_reason, elapsed_sec, usage_unknown, oos_type,
    reference_status, faithfulness, relevance, correctness. Means of correctness
    are null where nothing is scored; other scores that lack count as 0.
    """
    r = results
    valid, counted, measured, gone = answered(r), scorable(r), r["elapsed_sec"].isNotNull(), F.coalesce(r["generation_failed"], F.lit(False))
    mean = lambda value, over: F.avg(F.when(over, value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    oos = (r["reference_status"] == "verified") & (r["oos_type"] == "out_of_scope") & r["answer"].isNotNull()
    return results.groupBy(*by).agg(
        F.count_if(valid).alias("answered"),
        F.count_if(gone | F.coalesce(r["error"] != "empty answer", F.lit(False))).alias("failed"),
        F.count_if(F.coalesce(r["route_decision"] == "abstain", F.lit(False)) | (F.coalesce(r["abstain_reason"], F.lit("")) != "")).alias("abstained"),
        F.count_if(measured & F.coalesce(r["usage_unknown"], F.lit(False))).alias("usage_unknown"),
        F.round(_share(r["path"] == "complex", measured, 0.0), 3).alias("complex_path_rate"),
        F.round(zero(F.avg(r["elapsed_sec"])), 2).alias("mean_elapsed_sec"),
        F.round(zero(mean(zero(r["faithfulness"]), valid)), 3).alias("faithfulness"),
        F.round(zero(mean(zero(r["relevance"]), valid)), 3).alias("answer_relevance"),
        F.round(mean(r["correctness"], valid), 2).alias("correctness_mean"),
        F.round(mean(r["correctness"], counted), 2).alias("correctness_inscope"),
        F.count_if(counted).alias("correctness_scored"),
        F.count_if(valid & (F.coalesce(r["oos_type"], F.lit("")) == "")).alias("correctness_in_scope_total"),
        F.round(_share(~gone & refused(r["answer"], pattern), oos, 0.0), 3).alias("oos_rejection_rate"),
        F.round(_share(r["correctness"] < ENOUGH, counted & (r["path"] == "simple"), 0.0), 3).alias("false_sufficiency_rate"),
    )


def abstain_rates(results: DataFrame, *by: str) -> DataFrame:
    """results: answer, abstained, is_oos, forbidden, top_score, n_passages -> rates of silence and inversions, means of retrieval.

    false_abstain: silent in scope. correct_abstain: silent out of scope, 1
    without such rows. inversion: a forbidden pattern, among rows that have one.
    """
    quiet, oos = abstained(F.col("answer"), F.col("abstained")), F.coalesce("is_oos", F.lit(False))
    mean = lambda c, k: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0)), k)
    return results.groupBy(*by).agg(
        _share(quiet, F.lit(True), 0.0).alias("abstain_rate"),
        _share(quiet, ~oos, 0.0).alias("false_abstain_rate"),
        _share(quiet, oos, 1.0).alias("correct_abstain_rate"),
        _share(inverted(F.col("answer"), F.col("forbidden")), ~_blank(F.col("forbidden")), 0.0).alias("inversion_rate"),
        mean("top_score", 4).alias("avg_top_score"),
        mean("n_passages", 2).alias("avg_passage_count"),
    )


def citation_figures(answer: Column, sources: Column) -> Column:
    """struct<n_citations, n_distinct, diversity, citation_rate, in_retrieval, doc_match> of one answer and its passages' sources.

    citation_rate: sentences with a citation; brackets hold no end of a sentence.
    in_retrieval: numbers that a passage has. doc_match: of those, names that
    stand in that passage's source. Without citations or passages all are 0. The
    letters U+0001 and U+0002 of an answer are not read.
    """
    text = F.translate(F.coalesce(answer, F.lit("")), "\u0001\u0002", "")
    marked = F.regexp_replace(F.regexp_replace(text, FRAGMENT.replace(r"\[", r"\[(?:[^\]]*\[)?", 1), "\u0001"), r"\[[^\]]*\]", "\u0002")
    parts = F.split(marked, r"(?U)[.!?]+(?:\s+|$)")
    last = F.element_at(parts, -1)
    sentences = F.when(_blank(last), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    cited, n = fragments(text), F.size(F.coalesce(sources, F.array().cast("array<string>")))
    inside = F.filter(cited, lambda c: c["n"].between(1, n))
    named = F.filter(inside, lambda c: (c["doc"] != "") & F.contains(F.lower(F.coalesce(F.get(sources, c["n"] - 1), F.lit(""))), F.lower(c["doc"])))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    count, kinds = F.size(cited), F.size(F.array_distinct(cited))
    return F.struct(
        count.alias("n_citations"),
        kinds.alias("n_distinct"),
        over(kinds, count).alias("diversity"),
        over(F.size(F.filter(sentences, lambda s: F.contains(s, F.lit("\u0001")))), F.size(sentences)).alias("citation_rate"),
        F.when(n > 0, over(F.size(inside), count)).otherwise(0.0).alias("in_retrieval"),
        over(F.size(named), F.size(inside)).alias("doc_match"),
    )


def evaluator_summary(scores: DataFrame, *by: str) -> DataFrame:
    """scores: key, score, comment -> a row per evaluator with a score: mean, n; for retrieval_hit also mrr, from ``rank=`` in the comment (a miss counts as 0)."""
    rank = F.nullif(F.regexp_extract(F.coalesce("comment", F.lit("")), r"rank=(\d+)", 1), F.lit("")).cast("int")
    hit = F.when(F.col("key") == "retrieval_hit", F.coalesce(1 / rank, F.lit(0.0)))
    return scores.filter("score IS NOT NULL").groupBy(*by, "key").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.avg(hit).alias("mrr"))


def usage(response: Column) -> Column:
    """struct<prompt_tokens, completion_tokens, reasoning_tokens, provider> of a model's response in JSON.

    Three spellings of the counts are read, the first that is there wins; what is missing or no number is 0.
    """
    at = lambda path: F.get_json_object(response, path)
    first = F.coalesce(at("$.usage_metadata"), F.lit("{}"))
    root = F.when(F.trim(first).isin("{}", "null", ""), F.coalesce(at("$.response_metadata.token_usage"), F.lit("{}"))).otherwise(first)
    count = lambda *paths: F.coalesce(F.coalesce(*(F.get_json_object(root, p) for p in paths)).try_cast("double").try_cast("long"), F.lit(0)).cast("long")
    return F.struct(
        count("$.input_tokens", "$.prompt_tokens").alias("prompt_tokens"),
        count("$.output_tokens", "$.completion_tokens").alias("completion_tokens"),
        count("$.output_token_details.reasoning", "$.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
        F.coalesce(at("$.response_metadata.openrouter_provider"), F.lit("")).alias("provider"),
    )


def preference(raw: Column) -> Column:
    """A judge's JSON, also in a code fence: winner A, B or TIE -> 0, 1, -1; anything else null."""
    text = F.trim(raw, F.lit(" \t\r\n"))
    body = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"```$", "")).otherwise(text)
    # The parser stops behind the first value; a last element that must be found shows that nothing else stands there.
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit(f', "{END}"]')))
    winner = F.when(F.try_variant_get(whole, "$[1]", "string") == END, F.upper(F.try_variant_get(whole, "$[0].winner", "string")))
    return F.when(winner == "A", 0).when(winner == "B", 1).when(winner == "TIE", -1)


def seat_scores(raw: Column, broken: Column) -> Column:
    """struct<a, b, comment>: 1 and 0, a tie 0.5 each; without scores where a run broke or the judge's reply cannot be read."""
    side = preference(raw)
    score = lambda wins: F.when(~broken, F.when(side == -1, 0.5).when(side == wins, 1.0).when(side.isNotNull(), 0.0))
    return F.struct(score(0).alias("a"), score(1).alias("b"), F.when(broken, "target_error").when(side.isNull(), "judge_format_error").alias("comment"))
