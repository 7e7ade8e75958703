"""Queries of lookups, outcomes, questions and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import questions
from lodestone.operators import lookup, review
from lodestone.plans.catalog import query
from lodestone.session import table


@query(
    """WITH a AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 10 THEN 'plain ' || doc_id WHEN doc_id % 5 = 0 THEN source || '::' || doc_id WHEN doc_id % 5 = 1 THEN source || '::00' || doc_id WHEN doc_id % 5 = 2 THEN 'src1::' || doc_id
WHEN doc_id % 50 = 3 THEN source || '::addr:item:' || doc_id % 40 || '.1' WHEN doc_id % 5 = 3 THEN source || '::addr:table:' || doc_id % 40 ELSE source || '::addr:table:' || doc_id % 40 || '.' || doc_id % 3 END AS chunk_id FROM documents),
p AS (SELECT chunk_id, CASE WHEN contains(chunk_id, '::') THEN split_part(chunk_id, '::', 1) END AS source, split_part(chunk_id, '::', 2) AS rest FROM a),
adr AS (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'item' END AS kind, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 40)::VARCHAR ELSE doc_id % 40 || '.1' END AS num, CASE WHEN doc_id % 2 = 0 THEN (doc_id // 2 % 3)::VARCHAR END AS row_, doc_id AS ord, substr(text, 1, 40) AS text FROM documents),
q AS (SELECT *, split_part(rest, ':', 2) AS kind, split_part(rest, ':', 3) AS n FROM p WHERE rest LIKE 'addr:%'),
m AS (SELECT chunk_id, arg_min(coalesce(adr.text, ''), ord) AS text FROM q JOIN adr ON adr.source = q.source AND adr.kind = q.kind AND adr.num = CASE q.kind WHEN 'table' THEN split_part(n, '.', 1) ELSE n END AND (q.kind <> 'table' OR NOT contains(n, '.') OR row_ = split_part(n, '.', 2)) GROUP BY 1
UNION ALL SELECT chunk_id, substr(d.text, 1, 40) FROM p JOIN documents d ON d.source = p.source AND d.doc_id = try_cast(p.rest AS BIGINT))
SELECT chunk_id, m.text IS NOT NULL AS found, CASE WHEN m.text IS NOT NULL THEN source END AS doc_id, m.text AS text, CASE WHEN source IS NULL THEN 'no source' END AS error FROM p LEFT JOIN m USING (chunk_id)"""
)
def point_get(spark, d):
    """Ids as they stand, with leading zeros, of another source, of tables, rows and items, and without a source."""
    docs, k = table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 40).alias("text")), F.col("doc_id")
    number = (k % 40).cast("string")
    at = lambda *parts: F.concat(F.col("source"), F.lit("::"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    raw = (
        F.when(k % 50 == 10, F.concat(F.lit("plain "), k.cast("string")))
        .when(k % 5 == 0, at(k.cast("string")))
        .when(k % 5 == 1, at("00", k.cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("src1::"), k.cast("string")))
        .when(k % 50 == 3, at("addr:item:", number, ".1"))
        .when(k % 5 == 3, at("addr:table:", number))
        .otherwise(at("addr:table:", number, ".", (k % 3).cast("string")))
    )
    even = k % 2 == 0
    addresses = docs.select("source", F.when(even, "table").otherwise("item").alias("kind"), F.when(even, number).otherwise(F.concat(number, F.lit(".1"))).alias("num"), F.when(even, F.floor(k / 2) % 3).alias("row"), k.alias("ord"), "text")
    return lookup.get_chunks(docs.select(raw.alias("chunk_id")), docs.select("source", k.alias("local"), "text"), addresses)


@query(
    """WITH s AS (SELECT event_id, event_id % 7 AS k, event_id % 3 AS n, event_id % 4 AS m FROM events), o AS (SELECT event_id, n, CASE WHEN k = 0 THEN 'clarification' WHEN k IN (1, 2) THEN 'ready' WHEN k = 3 THEN 'failed' WHEN k = 4 OR event_id % 11 = 0 OR n = 0 AND m = 0 THEN 'empty' ELSE 'insufficient' END AS outcome FROM s)
SELECT event_id, outcome, CASE WHEN outcome = 'ready' THEN n ELSE 0 END AS n_context FROM o"""
)
def retrieval_outcome(spark, d):
    e = F.col("event_id")
    k, n = e % 7, (e % 3).cast("int")
    tries = F.when(e % 11 != 0, F.array(n, (e % 4).cast("int")))
    out = lookup.outcome(F.when(k == 0, "which?").otherwise(""), F.when(k.isin(1, 2), "generate").when(k == 5, "abstain"), F.when(k.isin(1, 3), True), F.when(k == 4, "empty_pool"), tries)
    rows = table(spark, d, "events").select("event_id", out.alias("outcome"), F.array_repeat(F.lit("p"), n).alias("passages"))
    return rows.select("event_id", "outcome", F.size(lookup.final_context(F.col("outcome"), F.col("passages"))).cast("long").alias("n_context"))


ASKED = ("Каким приказом утверждено ", "Какой федеральный закон регулирует ", "Согласно статье 5, ", "Сравни ", "Сколько ", "")


@query(
    r"""WITH t AS (SELECT doc_id, doc_id % 6 AS k, source, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t, 'Как понять: ' || lower(substr(coalesce(text, ''), 1, 40)) AS q FROM documents),
i AS (SELECT *, t <> '' AND (contains(t, '...') OR NOT regexp_matches(t, '[.?!;:]$') AND len(string_split_regex(t, '\s+')) > 5 OR regexp_matches(t, '(?m)^\s*[-*\d]+\s') AND NOT regexp_matches(t, '^\s*(1\.|-|\*)\s')) AS incomplete FROM t)
SELECT doc_id, k IN (0, 1, 2) AS weak, k = 3 OR contains(q, 'vs') AS several_documents, CASE WHEN k = 3 OR contains(q, 'vs') THEN 0.5::DOUBLE WHEN k = 4 THEN 0.95 ELSE 0.7 END AS diversity, incomplete, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND (doc_id % 4 = 0 OR incomplete OR len(t) < 150) AS needs_picture FROM i"""
)
def question_checks(spark, d):
    """Six beginnings of questions before words of the documents; texts as pieces of pages."""
    k = F.col("doc_id")
    begin = F.element_at(F.array(*map(F.lit, ASKED)), (k % 6 + 1).cast("int"))
    asked = F.concat(begin, F.lit("Как понять: "), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 40)))
    box = F.when(k % 7 != 0, F.array(F.lit(1.0)))
    picture = questions.needs_picture(F.col("text"), F.col("source"), F.when(k % 5 != 0, 1), box, F.when(k % 4 == 0, "DataTable"))
    rows = table(spark, d, "documents").select("doc_id", questions.weak_question(asked).alias("weak"), questions.query_class(asked).alias("c"), questions.incomplete(F.col("text")).alias("incomplete"), picture.alias("needs_picture"))
    return rows.select("doc_id", "weak", "c.*", "incomplete", "needs_picture")


@query(
    """WITH l AS (SELECT l_orderkey AS question, 'v' || l_linenumber % 4 AS variant, l_quantity > 20 AS ok FROM lineitem), v AS (SELECT unnest(['v3', 'v1', 'v0']) AS variant, unnest([1, 2, 3]) AS k)
SELECT question, coalesce(list(variant ORDER BY k) FILTER (NOT ok), []) AS missing FROM (SELECT q.question, v.variant, v.k, coalesce(bool_or(ok), false) AS ok FROM (SELECT DISTINCT question FROM l) q, v LEFT JOIN l ON l.question = q.question AND l.variant = v.variant GROUP BY ALL) GROUP BY question"""
)
def common_sample(spark, d):
    """Orders stand for questions, line numbers for variants; a line above 20 pieces is a covered label."""
    covered = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.concat(F.lit("v"), (F.col("l_linenumber") % 4).cast("string")).alias("variant"), (F.col("l_quantity") > 20).alias("ok"))
    return review.common_sample(covered, ["v3", "v1", "v0"])


@query(
    """WITH l AS (SELECT doc_id AS n, unnest([0, 1, 2]) AS i, text FROM documents), h AS (SELECT n, CASE i WHEN 0 THEN n % 3 <> 0 WHEN 1 THEN n % 4 <> 0 ELSE false END AND trim(regexp_replace(substr(text, 6, 20), '[ \\t\\r\\n]+', ' ', 'g')) <> '' AS holds FROM l WHERE i <= n % 3)
SELECT n, count(*) AS n_labels, count(*) FILTER (NOT coalesce(holds, false)) AS n_unverified, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 3 = 0 THEN 'budget' WHEN n % 5 = 0 THEN 'missing_parent' ELSE 'other' END END AS lost, n % 10 = 0 OR (n % 8) / 8 < 0.75 AS needs_human FROM h GROUP BY n"""
)
def quote_review(spark, d):
    """Up to three quotes a document: one may be changed, one may name a chunk that was no candidate, the third is empty."""
    n, q = F.col("doc_id"), F.substring("text", 6, 20)
    label = lambda chunk, quote: F.struct(chunk.alias("chunk_id"), quote.alias("quote"))
    three = F.array(label(F.lit(1), F.when(n % 3 == 0, F.concat(q, F.lit("§"))).otherwise(F.replace(q, F.lit(" "), F.lit("  ")))), label(F.when(n % 4 == 0, 7).otherwise(1), q), label(F.lit(1), F.lit(" ")))
    docs = table(spark, d, "documents")
    labels = docs.select(n.alias("n"), F.inline(F.slice(three, F.lit(1), (n % 3 + 1).cast("int"))))
    got = review.unverified_quotes(labels, docs.select(n.alias("n"), F.lit(1).alias("chunk_id"), "text"))
    k = F.col("n")
    return got.withColumn("lost", review.loss_reason(k % 2 == 0, F.lit(False), k % 3 == 0, k % 5 == 0)).withColumn("needs_human", review.needs_human(F.when(k % 10 == 0, "drop").otherwise("keep"), (k % 8) / 8))
