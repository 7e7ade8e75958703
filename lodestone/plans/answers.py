"""Queries of figures of generated answers.

Every document is an answer; its label is what a judge gave, its source the run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import answers
from lodestone.plans.catalog import query
from lodestone.session import table

RESULTS = """res AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'complex' ELSE 'simple' END AS path, CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'Нет, ' || text ELSE text END AS answer,
CASE WHEN doc_id % 31 = 0 THEN 'broken' WHEN doc_id % 17 = 0 THEN 'empty answer' END AS error, doc_id % 29 = 0 AS gf, doc_id % 23 = 0 AS quiet, CASE WHEN doc_id % 19 <> 0 THEN n_chars / 4 END AS elapsed_sec, doc_id % 37 = 0 AS unknown,
CASE WHEN lang = 'en' THEN '' WHEN lang = 'de' THEN 'out_of_scope' ELSE NULL END AS oos, doc_id % 5 <> 0 AS verified, toxic / 4.0 AS faith, quality * 8.0 + doc_id % 3 AS correctness FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, error IS NULL AND NOT gf AND coalesce(answer, '') <> '' AS ok, coalesce(oos, '') = '' AS inside, regexp_matches(substr(lower(answer), 1, 200), '(^|[^\\pL\\pN_])нет([^\\pL\\pN_]|$)|не могу') AS no FROM res)"""


def _results(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality", "toxic")
    k, no = F.col("doc_id"), F.lit(None).cast("string")
    return docs.join(labels, "doc_id", "left").select(
        "source",
        F.when(k % 3 == 0, "complex").otherwise("simple").alias("path"),
        F.when(k % 31 == 0, no).when(k % 17 == 0, "").when(k % 13 == 0, F.concat(F.lit("Нет, "), "text")).otherwise(F.col("text")).alias("answer"),
        F.when(k % 31 == 0, "broken").when(k % 17 == 0, "empty answer").alias("error"),
        (k % 29 == 0).alias("generation_failed"),
        no.alias("route_decision"),
        F.when(k % 23 == 0, "no evidence").otherwise("").alias("abstain_reason"),
        F.when(k % 19 != 0, F.col("n_chars") / 4).alias("elapsed_sec"),
        (k % 37 == 0).alias("usage_unknown"),
        F.when(F.col("lang") == "en", "").when(F.col("lang") == "de", "out_of_scope").alias("oos_type"),
        F.when(k % 5 != 0, "verified").otherwise("draft").alias("reference_status"),
        (F.col("toxic") / 4).alias("faithfulness"),
        no.cast("double").alias("relevance"),
        (F.col("quality") * 8.0 + k % 3).alias("correctness"),
    )


@query(
    f"""WITH {RESULTS} SELECT source, count(*) FILTER (ok) AS answered, count(*) FILTER (gf OR coalesce(error = 'broken', false)) AS failed, count(*) FILTER (quiet) AS abstained, count(*) FILTER (unknown AND elapsed_sec IS NOT NULL) AS usage_unknown,
round(coalesce(count(*) FILTER (path = 'complex' AND elapsed_sec IS NOT NULL)::DOUBLE / nullif(count(elapsed_sec), 0), 0), 3) AS complex_path_rate, round(coalesce(avg(elapsed_sec), 0), 2) AS mean_elapsed_sec,
round(coalesce(avg(coalesce(faith, 0)) FILTER (ok), 0)::DOUBLE, 3) AS faithfulness, 0::DOUBLE AS answer_relevance, round((avg(correctness) FILTER (ok))::DOUBLE, 2) AS correctness_mean, round((avg(correctness) FILTER (ok AND verified AND inside))::DOUBLE, 2) AS correctness_inscope,
count(*) FILTER (ok AND verified AND inside AND correctness IS NOT NULL) AS correctness_scored, count(*) FILTER (ok AND inside) AS correctness_in_scope_total,
round(coalesce(count(*) FILTER (verified AND oos = 'out_of_scope' AND answer IS NOT NULL AND NOT gf AND (answer = '' OR no))::DOUBLE / nullif(count(*) FILTER (verified AND oos = 'out_of_scope' AND answer IS NOT NULL), 0), 0), 3) AS oos_rejection_rate,
round(coalesce(count(*) FILTER (ok AND verified AND inside AND path = 'simple' AND correctness < 5)::DOUBLE / nullif(count(*) FILTER (ok AND verified AND inside AND path = 'simple' AND correctness IS NOT NULL), 0), 0), 3) AS false_sufficiency_rate FROM r GROUP BY source"""
)
def run_summary(spark, d):
    return answers.run_summary(_results(spark, d), "source")


@query(
    r"""WITH t AS (SELECT source, lower(text) AS a, doc_id % 41 = 0 OR regexp_matches(coalesce(text, ''), '^\s*$') AS q, lang = 'de' AS oos, doc_id % 3 <> 0 AS rule, doc_id % 7 AS s, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 END AS n FROM documents)
SELECT source, avg(q::INT) AS abstain_rate, coalesce(avg(q::INT) FILTER (NOT oos), 0) AS false_abstain_rate, coalesce(avg(q::INT) FILTER (oos), 1) AS correct_abstain_rate,
coalesce(avg(CASE WHEN contains(a, 'three') OR contains(a, '.org') THEN 1 ELSE 0 END) FILTER (rule), 0) AS inversion_rate, round(avg(s), 4) AS avg_top_score, round(avg(coalesce(n, 0)), 2) AS avg_passage_count FROM t GROUP BY source"""
)
def abstain_rates(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select("source", F.col("text").alias("answer"), (k % 41 == 0).alias("abstained"), (F.col("lang") == "de").alias("is_oos"), F.when(k % 3 != 0, "ThreE| | .ORG |").otherwise(" ").alias("forbidden"), (k % 7).alias("top_score"), F.when(k % 2 == 0, k % 5).alias("n_passages"))
    return answers.abstain_rates(rows, "source")


_MARK = r"\[Фрагмент\s+(\d+):\s*([^,\]]+?)(?:,\s*п\.\s*([^\]]+?)|,\s*без\s+пункта)?\s*\]"


@query(
    f"""WITH a AS (SELECT doc_id, substr(text, 1, 150) || ' [Фрагмент ' || doc_id % 6 || ': ' || source || ', п. 3.1]. ' || substr(text, 151, 150) || CASE doc_id % 4 WHEN 0 THEN ' [фрагмент 2:  SRC1 , без пункта] x. y' WHEN 1 THEN ' [see. p. [Фрагмент 1: ' || source || ']' WHEN 2 THEN ' [note. 3] end... ! ' ELSE '' END AS answer, list_slice(['a/' || source, 'src1.pdf', 'src2.pdf'], 1, doc_id % 4) AS sources FROM documents),
p AS (SELECT *, '(?i){_MARK}' AS m FROM a), c AS (SELECT doc_id, sources, [{{'n': t.n::INT, 'doc': lower(trim(t.d)), 's': trim(coalesce(t.s, ''))}} FOR t IN list_transform(range(1, len(regexp_extract_all(answer, m)) + 1), lambda k: {{'n': regexp_extract_all(answer, m, 1)[k], 'd': regexp_extract_all(answer, m, 2)[k], 's': regexp_extract_all(answer, m, 3)[k]}})] AS cs,
regexp_extract_all(regexp_replace(regexp_replace(answer, '(?i)\\[(?:[^\\]]*\\[)?{_MARK[2:]}', '@@', 'g'), '\\[[^\\]]*\\]', '##', 'g') || chr(1), '(?s)(.*?)(?:[.!?]+(?:\\s+|' || chr(1) || ')|' || chr(1) || ')') AS parts, len(sources) AS n FROM p),
f AS (SELECT *, list_filter(cs, lambda x: x.n BETWEEN 1 AND n) AS inside, list_filter(parts, lambda x: trim(x, chr(1) || ' ' || chr(9) || chr(10)) <> '') AS ps FROM c)
SELECT doc_id, len(cs) AS n_citations, len(list_distinct(cs)) AS n_distinct, coalesce(len(list_distinct(cs)) / nullif(len(cs), 0), 0) AS diversity, coalesce(len(list_filter(ps, lambda x: contains(x, '@@'))) / nullif(len(ps), 0), 0) AS citation_rate,
CASE WHEN n > 0 AND len(cs) > 0 THEN len(inside) / len(cs) ELSE 0 END AS in_retrieval, coalesce(len(list_filter(inside, lambda x: contains(lower(sources[x.n]), x.doc))) / nullif(len(inside), 0), 0) AS doc_match FROM f"""
)
def citation_figures(spark, d):
    k, cut = F.col("doc_id"), lambda a: F.coalesce(F.substring("text", a, 150), F.lit(""))
    tail = F.when(k % 4 == 0, " [фрагмент 2:  SRC1 , без пункта] x. y").when(k % 4 == 1, F.concat(F.lit(" [see. p. [Фрагмент 1: "), "source", F.lit("]"))).when(k % 4 == 2, " [note. 3] end... ! ").otherwise("")
    answer = F.concat(cut(1), F.lit(" [Фрагмент "), (k % 6).cast("string"), F.lit(": "), "source", F.lit(", п. 3.1]. "), cut(151), tail)
    sources = F.slice(F.array(F.concat(F.lit("a/"), "source"), F.lit("src1.pdf"), F.lit("src2.pdf")), F.lit(1), (k % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", answers.citation_figures(answer, sources).alias("c")).select("doc_id", "c.*")


@query(
    """WITH s AS (SELECT event_type, event_id, CASE event_id % 3 WHEN 0 THEN 'retrieval_hit' WHEN 1 THEN 'doc_cited' ELSE 'forbidden' END AS key, CASE WHEN event_id % 11 <> 0 THEN (event_id % 4 > 0)::INT END AS score FROM events)
SELECT event_type, key, avg(score) AS mean, count(*) AS n, avg(CASE WHEN key = 'retrieval_hit' THEN CASE WHEN score = 1 THEN 1 / (event_id % 12 + 1) ELSE 0 END END) AS mrr FROM s WHERE score IS NOT NULL GROUP BY ALL"""
)
def evaluator_summary(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_type", F.when(k % 3 == 0, "retrieval_hit").when(k % 3 == 1, "doc_cited").otherwise("forbidden").alias("key"), F.when(k % 11 != 0, (k % 4 > 0).cast("int")).alias("score"), F.when(k % 4 > 0, F.concat(F.lit("rank="), (k % 12 + 1).cast("string"))).otherwise("miss").alias("comment"))
    return answers.evaluator_summary(rows, "event_type")


@query(
    """WITH e AS (SELECT event_id, event_type, coalesce((props::JSON->>'$.k')::BIGINT, 0) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE k END AS prompt_tokens, CASE event_id % 5 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE event_id % 90 END AS completion_tokens, CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN event_id % 8 WHEN 2 THEN 0 ELSE 0 END AS reasoning_tokens, CASE WHEN event_id % 5 IN (1, 2) THEN event_type ELSE '' END AS provider FROM e"""
)
def usage_extraction(spark, d):
    """Responses in the three spellings, one with a count that is no number and one without counts."""
    k, event = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).cast("string"), F.col("event_id")
    n, cat = (event % 90).cast("string"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    response = (
        F.when(event % 5 == 0, cat('{"usage_metadata": {"input_tokens": ', k, ', "output_tokens": ', n, ', "output_token_details": {"reasoning": 7}}}'))
        .when(event % 5 == 1, cat('{"usage_metadata": {}, "response_metadata": {"openrouter_provider": "', F.col("event_type"), '", "token_usage": {"prompt_tokens": ', k, ', "completion_tokens": ', n, ', "completion_tokens_details": {"reasoning_tokens": ', (event % 8).cast("string"), "}}}}"))
        .when(event % 5 == 2, cat('{"response_metadata": {"openrouter_provider": "', F.col("event_type"), '", "token_usage": {"prompt_tokens": "', k, '", "completion_tokens": ', n, "}}}"))
        .when(event % 5 == 3, cat('{"usage_metadata": {"prompt_tokens": ', k, ', "completion_tokens": "many"}}'))
        .otherwise("{}")
    )
    return table(spark, d, "events").select("event_id", answers.usage(response).alias("u")).select("event_id", "u.*")


@query(
    """WITH e AS (SELECT event_id, event_id % 13 = 0 AS broken, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 0 END AS w FROM events)
SELECT event_id, CASE WHEN NOT broken THEN CASE w WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0 WHEN -1 THEN 0.5 END END AS a, CASE WHEN NOT broken THEN CASE w WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1 WHEN -1 THEN 0.5 END END AS b, CASE WHEN broken THEN 'target_error' WHEN w IS NULL THEN 'judge_format_error' END AS comment FROM e"""
)
def pairwise_preference(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 7 == 0, '{"winner": "A"}').when(k % 7 == 1, '```json\n{"winner": "b", "why": 1}\n```').when(k % 7 == 2, '  {"winner": "Tie"}\n').when(k % 7 == 3, '```\n{"winner": "a"}```').when(k % 7 == 4, '{"winner": "C"}').when(k % 7 == 5, '{"winner": "A"').otherwise('["A"]')
    return table(spark, d, "events").select("event_id", answers.seat_scores(raw, k % 13 == 0).alias("s")).select("event_id", "s.*")
