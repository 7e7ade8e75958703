"""A finished question as a row of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["query_id", "run_id", "ts", "source", "question", "path", "answer_len", "n_passages", "n_passages_found", "latency_ms", "prompt_tokens", "completion_tokens", "cost_usd", "models", "unpriced_models", "error"]


def resolve_path(abstained: Column, clarified: Column, stages: Column) -> Column:
    """What the user got goes before how much work it took."""
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(told(abstained), "abstain").when(told(clarified), "clarify").when(F.coalesce(F.array_contains(stages, "complex"), F.lit(False)), "complex").otherwise("simple")


def project_events(states: DataFrame, rates: dict[str, tuple[float, float]]) -> DataFrame:
    """The 16 columns of an event from a state.

    states: query_id, run_id, ts, source, query, abstain_reason,
    clarify_message, stages (array), answer, n_found, latency_ms, usages
    (array<struct<model, prompt_tokens, completion_tokens, n_passages>>), error,
    generation_failed, generation_error. ``rates``: USD for a million prompt and
    completion tokens by model. Missing counts are zeros; only error and run_id
    may be null. Passages are what the calls report; where none does, what was found.
    """
    usages = F.coalesce("usages", F.array().cast(states.schema["usages"].dataType))
    total = lambda name: F.aggregate(usages, F.lit(0).cast("long"), lambda a, u: a + F.coalesce(u[name], F.lit(0)).cast("long"))
    model = lambda u: F.coalesce(u["model"], F.lit("unknown"))
    if rates:
        prices = F.create_map(*(x for m, (p, c) in rates.items() for x in (F.lit(m), F.struct(F.lit(float(p)).alias("prompt"), F.lit(float(c)).alias("completion")))))
        price = lambda u: F.try_element_at(prices, model(u))
        usd = lambda u: F.coalesce(F.coalesce(u["prompt_tokens"], F.lit(0)) / 1_000_000 * price(u)["prompt"] + F.coalesce(u["completion_tokens"], F.lit(0)) / 1_000_000 * price(u)["completion"], F.lit(0.0))
        unpriced = F.array_distinct(F.transform(F.filter(usages, lambda u: price(u).isNull()), model))
    else:
        usd, unpriced = (lambda u: F.lit(0.0)), F.array_distinct(F.transform(usages, model))
    found = F.coalesce("n_found", F.lit(0)).cast("long")
    reported = F.filter(usages, lambda u: u["n_passages"].isNotNull())
    sent = F.when(F.size(reported) > 0, F.aggregate(reported, F.lit(0).cast("long"), lambda a, u: a + u["n_passages"].cast("long"))).otherwise(found)
    failed = F.when(F.coalesce("generation_failed", F.lit(False)), F.concat(F.lit("generation_failed: "), F.coalesce("generation_error", F.lit("unknown"))))
    return states.select(
        "query_id",
        "run_id",
        "ts",
        "source",
        F.coalesce("query", F.lit("")).alias("question"),
        resolve_path(F.col("abstain_reason"), F.col("clarify_message"), F.col("stages")).alias("path"),
        F.length(F.coalesce("answer", F.lit(""))).cast("long").alias("answer_len"),
        sent.alias("n_passages"),
        found.alias("n_passages_found"),
        F.coalesce("latency_ms", F.lit(0)).cast("long").alias("latency_ms"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        F.aggregate(usages, F.lit(0.0), lambda a, u: a + usd(u)).alias("cost_usd"),
        usages.alias("models"),
        unpriced.alias("unpriced_models"),
        F.coalesce("error", failed).alias("error"),
    )
