"""The registry of named queries and of their SQL oracles.

Bindings to the tables: documents are chunks of a corpus and ``source`` their
family; benchmark items are questions; embeddings of the same number are
vectors of documents and questions; events are telemetry (event_type is the
path, value the latency, the number in props the cost in cents).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import similarity
from lodestone.operators import gates, metrics, packing, retrieval
from lodestone.operators.settle import settle
from lodestone.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


STEMS = "list_transform(list_filter(regexp_extract_all(lower(coalesce(text,'')), '[а-яёa-z0-9]+'), lambda x: len(x) >= 2), lambda x: x[1:5])"
BM25 = f"""
tok AS (SELECT doc_id AS doc, {STEMS} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT term, doc, dl, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({STEMS}) AS term FROM benchmark) GROUP BY ALL),
hit AS (SELECT query, doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN terms USING (term) JOIN post USING (term), st GROUP BY ALL),
allq AS (SELECT query, doc_id AS doc FROM (SELECT DISTINCT query FROM qt), documents),
scored AS (SELECT query, doc, round(coalesce(s, 0), 6) AS score FROM allq LEFT JOIN hit USING (query, doc)),
lex AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored QUALIFY rank <= 24)"""
DENSE = """
dd AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS distance FROM embeddings q, embeddings d WHERE {where}),
den AS (SELECT query, doc, distance, row_number() OVER (PARTITION BY query ORDER BY distance, doc) AS rank FROM dd QUALIFY rank <= 24)"""
ITEM_DENSE = DENSE.format(where="q.vec_id IN (SELECT item_id FROM benchmark)")
FUSED = f"""{BM25},{ITEM_DENSE},
lists AS (SELECT query, 0 AS list, rank, doc FROM den UNION ALL SELECT query, 1, rank, doc FROM lex),
fu AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS s, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT query, doc, round(s, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, seen) AS rank FROM fu QUALIFY rank <= 12)"""


def _lexical(spark, d, k=24):
    index = retrieval.build_index(table(spark, d, "documents"), "doc_id", "text")
    return retrieval.bm25(index, table(spark, d, "benchmark"), "item_id", "text", k)


def _dense(spark, d, k=24):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return retrieval.nearest(vectors, vectors.join(items, "vec_id", "left_semi"), k)


def _lists(spark, d):
    """Both short lists. They are dealt anew before the union: adaptive execution may resize one of two equally partitioned parts and not the other."""
    dense = _dense(spark, d).select("query", F.lit(0).alias("list"), "rank", "doc").hint("rebalance")
    return dense.unionByName(_lexical(spark, d).select("query", F.lit(1).alias("list"), "rank", "doc").hint("rebalance"))


def _fused(spark, d):
    return retrieval.fuse(_lists(spark, d))


def _self_knn(spark, d, metric="l2", k=20):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = retrieval.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k + 1, metric)
    found = found.filter("query <> doc")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("rank") <= k)


def _same_label(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label")
    return e.join(F.broadcast(q) if q.count() < 100_000 else q, "label").filter("query <> vec_id").select("query", F.col("vec_id").alias("doc"))


KNN = """
kn AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS dist FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
kn1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, doc) AS r0 FROM kn QUALIFY r0 <= 21),
ranked AS (SELECT query, doc, dist, row_number() OVER (PARTITION BY query ORDER BY r0) AS rank FROM kn1 WHERE query <> doc QUALIFY rank <= 20),
rel AS (SELECT q.vec_id AS query, d.vec_id AS doc FROM embeddings q JOIN embeddings d USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)"""


@query(f"SELECT doc_id, array_to_string({STEMS}, ' ') AS stems, len({STEMS}) AS n FROM documents")
def prefix_stem_tokens(spark, d):
    s = tx.prefix_stems(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.array_join("s", " ").alias("stems"), F.size("s").cast("long").alias("n"))


@query(f"WITH {BM25} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM terms")
def bm25_stats(spark, d):
    return retrieval.build_index(table(spark, d, "documents"), "doc_id", "text").terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query, doc, round(score, 4) AS score, rank::INT AS rank FROM lex WHERE rank <= 12")
def bm25_topk(spark, d):
    return _lexical(spark, d, 12).select("query", "doc", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {KNN} SELECT query, doc, round(1 / (1 + dist), 4) AS score, rank::INT AS rank FROM ranked")
def knn_l2_topk(spark, d):
    return _self_knn(spark, d).select("query", "doc", F.round(similarity(F.col("distance")), 4).alias("score"), "rank")


@query(
    """WITH kn AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS dist FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
kn1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, doc) AS r0 FROM kn QUALIFY r0 <= 21)
SELECT query, doc, round(dist, 5) AS distance, row_number() OVER (PARTITION BY query ORDER BY r0)::INT AS rank FROM kn1 WHERE query <> doc QUALIFY rank <= 20"""
)
def knn_cosine_topk(spark, d):
    return _self_knn(spark, d, "cosine").select("query", "doc", F.round("distance", 5).alias("distance"), "rank")


@query(f"WITH {FUSED} SELECT query, doc, score, rank::INT AS rank FROM fused")
def rrf_hybrid_topk(spark, d):
    return _fused(spark, d)


@query(
    f"""WITH {FUSED}, miss AS (SELECT query, doc, rank FROM lex WHERE rank <= 3 AND (query, doc) NOT IN (SELECT query, doc FROM fused))
SELECT query, doc, score, rank::INT AS rank FROM fused UNION ALL SELECT m.query, m.doc, NULL, ((SELECT max(rank) FROM fused f WHERE f.query = m.query) + row_number() OVER (PARTITION BY m.query ORDER BY m.rank))::INT FROM miss m"""
)
def bm25_guarantee(spark, d):
    lists = settle(_lists(spark, d), "lists")  # both are read twice
    return retrieval.guarantee(retrieval.fuse(lists), lists.filter("list = 1").select("query", "doc", "rank"))


@query(
    f"""WITH {FUSED}, f AS (SELECT query, doc, min(rank * 10 + list) AS pos, string_agg(DISTINCT list::VARCHAR, ',' ORDER BY list::VARCHAR) AS pools FROM lists GROUP BY ALL)
SELECT query, doc, pools, row_number() OVER (PARTITION BY query ORDER BY pos)::INT AS rank FROM f QUALIFY rank <= 20"""
)
def round_robin_merge(spark, d):
    return retrieval.round_robin(_lists(spark, d).withColumn("list", F.col("list").cast("string")), 20)


@query()
def mmr_select(spark, d):
    ranked = _passages(spark, d).select("query", F.col("rank").alias("ord"), "doc", "family", F.col("score").alias("relevance"))
    return retrieval.mmr(ranked, 6)


@query(
    """WITH m AS (SELECT i, avg(x) AS c FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
c AS (SELECT list(c ORDER BY i) AS c FROM m)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS sim, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) >= 0.2 AS passed FROM embeddings, c"""
)
def centroid_gate(spark, d):
    from lodestone.functions.vectors import cosine

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    mean = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))  # one row
    sim = F.round(cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("c")), 6)
    return e.join(F.broadcast(centre)).select("vec_id", sim.alias("sim"), (sim >= 0.2).alias("passed"))


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IS NOT DISTINCT FROM 'en'")
def scope_filter(spark, d):
    from lodestone.sources.files import scope

    return table(spark, d, "documents").filter(scope(source=["src1", "src2", "src3"], lang="en")).select("doc_id", "source", "lang")


PER_QUERY = f"""{KNN},
m AS (SELECT r.query, r.rank, (rel.doc IS NOT NULL) AS ok FROM ranked r LEFT JOIN rel ON rel.query = r.query AND rel.doc = r.doc),
nr AS (SELECT query, count(*) AS n FROM rel GROUP BY 1),
pq AS (SELECT query, (count(*) FILTER (ok AND rank <= 10) > 0)::INT AS hit, round(coalesce(1.0 / min(rank) FILTER (ok), 0), 6) AS rr, round(count(*) FILTER (ok AND rank <= 10) / 10, 6) AS "precision", round(coalesce(count(*) FILTER (ok AND rank <= 10) / any_value(n), 0), 6) AS recall FROM m LEFT JOIN nr USING (query) GROUP BY query)"""


@query(f"WITH {PER_QUERY} SELECT * FROM pq")
def ir_per_query(spark, d):
    return metrics.ranking(_self_knn(spark, d), _same_label(spark, d), 10)


@query(f"WITH {PER_QUERY} SELECT label, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM pq JOIN embeddings ON vec_id = query GROUP BY label")
def ir_per_label(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query"), "label")
    return ir_per_query(spark, d).join(labels, "query").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(
    f"""WITH {KNN}, g AS (SELECT query, doc, 1 + (doc % 3) AS grade FROM rel),
dcg AS (SELECT r.query, sum(coalesce(grade / log2(rank + 1), 0)) AS d FROM ranked r LEFT JOIN g ON g.query = r.query AND g.doc = r.doc WHERE rank <= 10 GROUP BY r.query),
ide AS (SELECT query, sum(grade / log2(k + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS k FROM g) WHERE k <= 10 GROUP BY query)
SELECT query, round(coalesce(d / nullif(i, 0), 0), 6) AS ndcg FROM dcg LEFT JOIN ide USING (query)"""
)
def ir_ndcg(spark, d):
    return metrics.ndcg(_self_knn(spark, d), _same_label(spark, d).withColumn("grade", 1 + F.col("doc") % 3), 10)


@query(
    f"""WITH {KNN}, f AS (SELECT r.query, min(rank) AS first FROM ranked r JOIN rel USING (query, doc) GROUP BY 1), q AS (SELECT DISTINCT query FROM ranked)
SELECT k::INT AS k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM q LEFT JOIN f USING (query), range(1, 21) t(k) GROUP BY k"""
)
def hit_rate_curve(spark, d):
    return metrics.hit_curve(_self_knn(spark, d), _same_label(spark, d), 20)


@query("SELECT event_type AS path, count(*) AS n, round(avg(value), 6) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS most FROM events GROUP BY 1")
def latency_nearest_rank(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"))


@query("SELECT event_type AS path, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY 1")
def latency_linear(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


COST = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("cost", F.get_json_object("props", "$.k").try_cast("long"))


@query(f"SELECT sum({COST})::BIGINT AS cents FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def panel_total(spark, d):
    return _events(spark, d).filter("ts >= timestamp'2024-01-05' AND ts < timestamp'2024-01-20'").agg(F.sum("cost").alias("cents"))


@query("SELECT round(100.0 * count(*) FILTER (WHERE l.quality = 0) / nullif(count(*), 0), 6) AS share FROM labels l JOIN documents d USING (doc_id)")
def panel_share(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.agg(F.round(F.try_divide(100.0 * F.count_if(F.col("quality") == 0), F.count("*")), 6).alias("share"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS metric, count(*) AS n FROM events GROUP BY 1, 2")
def panel_daily_source(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS path, count(*) AS n FROM events GROUP BY 1")
def panel_routes(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("n"))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY {COST}), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY {COST}), 6) AS p95 FROM events GROUP BY 1")
def panel_cost_p(spark, d):
    return _events(spark, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.expr("percentile(cost, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(cost, 0.95)"), 6).alias("p95"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY 1")
def panel_latency_p(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def panel_latest_negative(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "user_id", "value")


@query(f"SELECT event_type AS path, grouping(event_type)::INT AS overall, count(*) AS n, sum({COST})::BIGINT AS cents, round(avg({COST}), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), ())")
def cost_by_path_grouping(spark, d):
    at = _events(spark, d).withColumnRenamed("event_type", "path").rollup("path")
    return at.agg(F.grouping("path").cast("int").alias("overall"), F.count("*").alias("n"), F.sum("cost").alias("cents"), F.round(F.avg("cost"), 6).alias("mean"))


@query(f"SELECT user_id, sum(coalesce({COST}, 0))::BIGINT AS tokens FROM events GROUP BY 1")
def usage_tolerant_cast(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.sum(F.coalesce("cost", F.lit(0))).alias("tokens"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def feedback_last_wins(spark, d):
    return packing.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def journal_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


DIVERSITY = "div AS (SELECT query, count(*) AS n_families, round(max(n) / sum(n), 6) AS max_share FROM (SELECT query, source, count(*) AS n FROM fused JOIN documents ON doc_id = doc GROUP BY ALL) GROUP BY query)"
OVERLAP = f"""qs AS (SELECT DISTINCT query, term FROM qt), ps AS (SELECT DISTINCT query, unnest({STEMS}) AS term FROM fused JOIN documents ON doc_id = doc),
ov AS (SELECT b.item_id AS query, round(coalesce(count(ps.term) / nullif(count(qs.term), 0), 1.0), 6) AS overlap FROM benchmark b LEFT JOIN qs ON qs.query = b.item_id LEFT JOIN ps ON ps.query = qs.query AND ps.term = qs.term GROUP BY 1)"""
SIGNALS = f"""{FUSED},{DIVERSITY},{OVERLAP},
sig AS (SELECT f.query, max(coalesce(round(1 / (1 + distance), 6), 0)) AS top_score, count(*) AS n_passages FROM fused f LEFT JOIN den ON den.query = f.query AND den.doc = f.doc GROUP BY 1),
gt AS (SELECT s.*, overlap, max_share, top_score >= 0.5 AS pass_score, n_passages >= 5 AS pass_count, overlap >= 0.15 AS pass_overlap FROM sig s JOIN ov USING (query) JOIN div USING (query)),
tri AS (SELECT *, pass_score AND pass_count AND pass_overlap AS sufficient, CASE WHEN pass_score AND pass_count AND pass_overlap THEN 'sufficient' WHEN top_score < 0.38 OR NOT pass_count THEN 'clearly_bad' ELSE 'borderline' END AS verdict FROM gt)"""


def _documents_of(spark, d, rows):
    """doc, family, text of the documents that ``rows`` (written, few) name. Few names are sent to where the texts lie, so the other texts are not exchanged."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("family"), "text")
    return docs.join(rows.select("doc"), "doc", "left_semi")


def _passages(spark, d):
    fused = settle(_fused(spark, d), "fused")
    return fused.join(_documents_of(spark, d, fused), "doc")


def _signals(spark, d):
    """From one fused list: it carries each passage's dense score, so nothing is retrieved twice."""
    dense = _dense(spark, d).select("query", "doc", F.round(similarity(F.col("distance")), 6).alias("score"), "rank")
    lists = dense.select("query", F.lit(0).alias("list"), "rank", "doc", F.col("score").alias("dense")).hint("rebalance")
    lists = lists.unionByName(_lexical(spark, d).select("query", F.lit(1).alias("list"), "rank", "doc", F.lit(None).cast("double").alias("dense")).hint("rebalance"))
    fused = settle(retrieval.fuse(lists).drop("score").withColumnRenamed("dense", "score"), "fused")
    passages = fused.join(_documents_of(spark, d, fused), "doc", "left")
    passages = settle(passages, "passages")  # twelve rows a question, read by signals and gaps
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return gates.signals(passages, items), passages, items


@query(f"WITH {FUSED},{DIVERSITY} SELECT * FROM div")
def doc_diversity(spark, d):
    return gates.diversity(_passages(spark, d))


@query(f"WITH {FUSED},{OVERLAP} SELECT * FROM ov")
def keyword_overlap(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return gates.keyword_overlap(items, _passages(spark, d))


@query(f"WITH {SIGNALS} SELECT query, top_score, n_passages, pass_score, pass_count, pass_overlap, sufficient FROM tri")
def hard_gates(spark, d):
    return gates.hard_gates(_signals(spark, d)[0]).select("query", "top_score", "n_passages", "pass_score", "pass_count", "pass_overlap", "sufficient")


@query(f"WITH {SIGNALS} SELECT query, verdict FROM tri")
def triage3(spark, d):
    return gates.triage(gates.hard_gates(_signals(spark, d)[0])).select("query", "verdict")


@query(
    f"""WITH {SIGNALS}, v AS (SELECT b.item_id AS query, coalesce(n_passages, 0) AS n, coalesce(overlap, 0) AS o, coalesce(verdict, 'clearly_bad') AS verdict, sufficient,
  regexp_matches(lower(b.text), 'кто\\s+проходит|кто\\s+обязан|какие\\s+категори[яи]|в\\s+каких\\s+случаях|перечислите|какие\\s+работники|каким\\s+работникам') AS wants FROM benchmark b LEFT JOIN tri ON tri.query = b.item_id)
SELECT query, CASE WHEN n = 0 OR o <= 0 THEN 'abstain' WHEN wants THEN 'complex' WHEN sufficient THEN 'generate' ELSE 'complex' END AS route,
CASE WHEN n = 0 THEN 'empty_pool' WHEN o <= 0 THEN 'zero_overlap_both' WHEN wants THEN 'enumeration_intent' WHEN verdict <> 'sufficient' THEN 'triage_' || verdict ELSE 'context_sufficient' END AS reason FROM v"""
)
def decision_table(spark, d):
    """No passage of the driver's tables refers to another clause, so the oracle leaves that row out; literal rows cover it."""
    signals, passages, items = _signals(spark, d)
    gaps = gates.open_references(passages.withColumnRenamed("rank", "ord"))
    validated = gates.obligations(gates.triage(gates.hard_gates(signals)), items, gaps)
    return gates.decide(validated).select("query", "route", "reason")


@query("SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum(len(text) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 6000")
def token_budget_prefix(spark, d):
    docs = table(spark, d, "documents").withColumn("cost", tx.token_estimate(F.col("text"))).select("source", "doc_id", "cost")
    return packing.long_budget_prefix(docs, "source", "doc_id", F.col("cost"), 6000).select("source", "doc_id", "used")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, sum(len(text)) OVER w AS used, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 3000 OR rn = 1")
def char_budget_first_kept(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("cost"))
    return packing.long_budget_prefix(docs, "source", "doc_id", F.col("cost"), 3000, keep_first=True).select("source", "doc_id")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_id FROM documents")
def dense_chunk_id(spark, d):
    return packing.dense_ids(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")



@query("SELECT source, sum(c)::BIGINT AS n, sha256(string_agg(h || ':' || c, ',' ORDER BY h || ':' || c)) AS digest FROM (SELECT source, sha256(text) AS h, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source")
def multiset_digest(spark, d):
    return packing.multiset_digest(table(spark, d, "documents").select("source", "text"), "source", F.col("text"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 50 - 1, 0) + 1, 300)) AS i FROM w)
SELECT doc_id, (i // 300)::INT AS n, sha256(array_to_string(ws[i + 1 : i + 350], ' ')) AS digest FROM s"""
)
def sliding_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(packing.windows(F.col("text"))).alias("n", "w"))
    return docs.select("doc_id", "n", F.sha2("w", 256).alias("digest"))


@query(
    """WITH i AS (SELECT user_id, event_id - 20 AS lo, event_id + 20 AS hi FROM events),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, island"""
)
def interval_merge(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") - 20).alias("lo"), (F.col("event_id") + 20).alias("hi"))
    return packing.merge_intervals(rows, "user_id", "lo", "hi")



@query(
    f"""WITH {KNN}, q AS (SELECT DISTINCT query FROM ranked), h AS (SELECT r.query, min(rank) AS first FROM ranked r JOIN rel USING (query, doc) GROUP BY 1),
x AS (SELECT query, (coalesce(first, 99) <= 1)::INT AS h0, (coalesce(first, 99) <= 5)::INT AS h1 FROM q LEFT JOIN h USING (query))
SELECT CASE WHEN h0 > h1 THEN 'regressed' WHEN h0 < h1 THEN 'recovered' ELSE 'same' END AS change, count(*) AS n FROM x GROUP BY 1"""
)
def run_compare(spark, d):
    ranked, rel = _self_knn(spark, d), _same_label(spark, d)
    return metrics.run_compare(metrics.ranking(ranked, rel, 1), metrics.ranking(ranked, rel, 5))


@query(
    """WITH f AS (SELECT value > 50 AS slow, event_type = 'error' AS failed, user_id % 2 = 0 AS even FROM events), c AS (SELECT a.b AS slow, b.b AS failed, c.b AS even FROM (VALUES (true), (false)) a(b), (VALUES (true), (false)) b(b), (VALUES (true), (false)) c(b))
SELECT c.slow, c.failed, c.even, count(f.slow) AS n FROM c LEFT JOIN f ON f.slow = c.slow AND f.failed = c.failed AND f.even = c.even GROUP BY ALL"""
)
def route_matrix_8(spark, d):
    flags = table(spark, d, "events").select((F.col("value") > 50).alias("slow"), (F.col("event_type") == "error").alias("failed"), (F.col("user_id") % 2 == 0).alias("even"))
    return metrics.flag_matrix(flags, ["slow", "failed", "even"])


@query(
    f"""WITH {SIGNALS}, g AS (SELECT s, o FROM (VALUES (0.4), (0.45), (0.5)) a(s), (VALUES (0.2), (0.5), (0.8)) b(o))
SELECT s::DOUBLE AS score_at, o::DOUBLE AS overlap_at, count(*) FILTER (coalesce(top_score, 0) >= s AND overlap >= o) AS accepted, count(*) FILTER (coalesce(top_score, 0) >= s AND overlap >= o AND n_passages >= 12) AS good FROM tri, g GROUP BY ALL"""
)
def threshold_grid(spark, d):
    s = _signals(spark, d)[0].select(F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "overlap", (F.col("n_passages") >= 12).alias("good"))
    return metrics.threshold_grid(s, [0.4, 0.45, 0.5], [0.2, 0.5, 0.8])


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS skipped, round(count(*) FILTER (quality = toxic) / nullif(count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL), 0), 6) AS accuracy FROM labels")
def judge_agreement(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g').replace('&lt;', '<').replace('&gt;', '>').replace('&quot;', chr(34)).replace('&#39;', '''').replace('&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("body"))


@query("SELECT conv_id, round(len(list_intersect(r, a)) / nullif(len(r), 0), 6) AS completeness FROM (SELECT conv_id, list_distinct(list_filter(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user')), '[а-яёa-z0-9]+'), lambda x: len(x) >= 4)) AS r, list_distinct(list_filter(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant')), '[а-яёa-z0-9]+'), lambda x: len(x) >= 4)) AS a FROM conversations GROUP BY conv_id)")
def answer_completeness(spark, d):
    turns = table(spark, d, "conversations").filter("role in ('user', 'assistant')")
    terms = turns.select("conv_id", "role", F.explode(tx.word_set(F.col("text"))).alias("w")).groupBy("conv_id", "w").agg(F.max((F.col("role") == "user").cast("int")).alias("u"), F.max((F.col("role") == "assistant").cast("int")).alias("a"))
    got = terms.groupBy("conv_id").agg(F.sum("u").alias("n"), F.sum(F.col("u") * F.col("a")).alias("m"))
    return table(spark, d, "conversations").select("conv_id").distinct().join(got, "conv_id", "left").select("conv_id", F.round(F.try_divide(F.col("m"), F.col("n")), 6).alias("completeness"))
