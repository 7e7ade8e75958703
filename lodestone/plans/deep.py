"""Queries of the slow path: reranking, the deep plan, merging with anchors and the candidate queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import similarity
from lodestone.operators import deep, retrieval
from lodestone.operators.settle import settle
from lodestone.plans.acts import CHUNKS, CORPUS, PARAGRAPHS, act_corpus, acts
from lodestone.plans.catalog import FUSED, STEMS, _dense, _lexical, query
from lodestone.session import table

#: The first chunk of every fused document, 48 at most; dense is the similarity of those that the dense list has.
POOL = f"""{FUSED}, {PARAGRAPHS}, {CHUNKS}, {CORPUS},
wide AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY s DESC, seen) AS rank FROM fu),
pool AS (SELECT w.query, w.rank AS ord, c.source, c.chunk, c.text, c.section, round(1 / (1 + distance), 6) AS dense FROM wide w JOIN corpus c ON c.source = w.doc::VARCHAR AND c.chunk = 0 LEFT JOIN den d ON d.query = w.query AND d.doc = w.doc WHERE w.rank <= 48)"""
#: share: the part of the question's stems that the text has.
SHARE = f"""qs AS (SELECT item_id AS query, list_distinct({STEMS}) AS qt FROM benchmark),
{{name}} AS (SELECT r.*, CASE WHEN len(qt) > 0 THEN 8.0::DOUBLE * len(list_intersect(qt, {STEMS})) / len(qt) - 4 ELSE -4::DOUBLE END AS logit FROM {{rows}} r JOIN qs USING (query))"""


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def _pool(spark, d) -> tuple[DataFrame, DataFrame]:
    """The pool, and the chunks of its documents, which are all that the deep plan looks into. Both are written once."""
    dense = _dense(spark, d).select("query", F.lit(0).alias("list"), "rank", "doc", F.round(similarity(F.col("distance")), 6).alias("dense")).hint("rebalance")
    lists = dense.unionByName(_lexical(spark, d).select("query", F.lit(1).alias("list"), "rank", "doc", F.lit(None).cast("double").alias("dense")).hint("rebalance"))
    wide = settle(retrieval.fuse(lists, limit=48), "wide")
    corpus = settle(act_corpus(acts(spark, d, wide)), "corpus")
    wide = wide.select("query", F.col("rank").alias("ord"), F.col("doc").cast("string").alias("source"), "score", "dense")
    return settle(wide.join(corpus.filter("chunk = 0"), "source"), "pool"), corpus


@query(
    f"""WITH {POOL}, {SHARE.format(name="crossed", rows="pool")}
SELECT query, row_number() OVER (PARTITION BY query ORDER BY 1 / (1 + exp(-logit)) DESC, ord) AS ord, source, chunk, round(1 / (1 + exp(-logit)), 4) AS rerank_score, dense AS vector_score FROM crossed QUALIFY row_number() OVER (PARTITION BY query ORDER BY 1 / (1 + exp(-logit)) DESC, ord) <= 12"""
)
def overfetch_rerank(spark, d):
    """Four times as many candidates as are wanted, ranked again by the model."""
    return deep.rerank(_pool(spark, d)[0], _questions(spark, d), k=12).select("query", "ord", "source", "chunk", "rerank_score", "vector_score")


DEEP = f"""{POOL},
anch AS (SELECT query, source, section, min(ord) AS anchor FROM pool WHERE ord <= 3 GROUP BY ALL),
found AS (SELECT a.query, anchor, c.source, c.chunk, c.text FROM anch a JOIN (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY chunk) AS k FROM corpus QUALIFY k <= 5) c USING (source, section) WHERE (a.query, c.text) NOT IN (SELECT query, text FROM pool)),
one AS (SELECT query, text, first(source ORDER BY anchor, chunk) AS source, first(chunk ORDER BY anchor, chunk) AS chunk, min({{'a': anchor, 'c': chunk}}) AS place FROM found GROUP BY ALL),
filled AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY fetched, place) AS ord, source, chunk, text FROM (SELECT query, source, chunk, text, false AS fetched, {{'a': ord, 'c': 0}} AS place FROM pool UNION ALL SELECT query, source, chunk, text, true, place FROM one) QUALIFY ord <= 50),
{SHARE.format(name="rated", rows="filled")},
deep AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY 1 / (1 + exp(-logit)) DESC, ord) AS ord, source, chunk, text, round(1 / (1 + exp(-logit)), 4) AS rerank_score FROM rated QUALIFY row_number() OVER (PARTITION BY query ORDER BY 1 / (1 + exp(-logit)) DESC, ord) <= 30)"""


def _deep(spark, d, pool: DataFrame, corpus: DataFrame) -> DataFrame:
    return settle(deep.deep_plan(pool, corpus, _questions(spark, d), most=50, k=30, section_chunks=5), "deep")


@query(f"WITH {DEEP} SELECT query, ord, source, chunk, rerank_score FROM deep")
def deep_retrieval(spark, d):
    return _deep(spark, d, *_pool(spark, d)).select("query", "ord", "source", "chunk", "rerank_score")


MERGED = f"""{DEEP},
simple AS (SELECT query, ord, source, chunk FROM pool WHERE ord <= 12),
fresh AS (SELECT query, ord, source, chunk, rerank_score AS r FROM deep WHERE (query, source, chunk) NOT IN (SELECT query, source, chunk FROM simple)),
rows AS (SELECT f.query, 24 - n AS room, n, list({{'o': ord, 's': source, 'c': chunk, 'r': r}} ORDER BY ord) AS rs FROM fresh f JOIN (SELECT query, count(*) AS n FROM simple GROUP BY 1) USING (query) GROUP BY ALL),
mm AS (WITH RECURSIVE m AS (SELECT query, room, n, rs, CAST([] AS VARCHAR[]) AS fam, CAST(NULL AS STRUCT(o BIGINT, s VARCHAR, c BIGINT, r DOUBLE)) AS x, 0 AS step FROM rows WHERE len(rs) > room UNION ALL
SELECT query, room, n, list_filter(rs, lambda y: y.o <> b.y.o), list_append(fam, b.y.s), b.y, step + 1 FROM (SELECT *, list_sort(list_transform(rs, lambda y: {{'v': -(0.7::DOUBLE * y.r - (1 - 0.7::DOUBLE) * CASE WHEN len(fam) = 0 THEN 0::DOUBLE ELSE len(list_filter(fam, lambda f: f = y.s))::DOUBLE / len(fam) END), 'o': y.o, 'y': y}}))[1] AS b FROM m WHERE step < room) WHERE b.v < 1) SELECT query, n + step AS ord, x.s AS source, x.c AS chunk FROM m WHERE step > 0
UNION ALL SELECT query, n + k, rs[k].s, rs[k].c FROM rows, range(1, 200) t(k) WHERE len(rs) <= room AND k <= len(rs)),
merged AS (SELECT query, ord, source, chunk FROM simple WHERE query IN (SELECT query FROM rows) UNION ALL SELECT query, ord, source, chunk FROM mm)"""


def _merged(spark, d, pool: DataFrame, found: DataFrame) -> DataFrame:
    return deep.merge_with_anchors(pool, found)


@query(f"WITH {MERGED} SELECT query, ord, source, chunk FROM merged")
def merged_candidate(spark, d):
    pool, corpus = _pool(spark, d)
    return _merged(spark, d, pool, _deep(spark, d, pool, corpus))


@query()
def complex_decision(spark, d):
    """The queue of merged, deep and fast candidates; literal rows test every outcome."""
    pool, corpus = _pool(spark, d)
    found = _deep(spark, d, pool, corpus)
    simple = pool.filter("ord <= 12")
    texts = corpus.select("source", "chunk", "text")
    dense = pool.select("query", "source", "chunk", F.col("dense").alias("score"))
    at = lambda rows, place: rows.select("query", "ord", "source", "chunk", F.lit(place).alias("place"))
    rows = at(_merged(spark, d, pool, found), 0).unionByName(at(found, 1)).unionByName(at(simple, 2))
    contexts = rows.join(texts, ["source", "chunk"]).join(dense, ["query", "source", "chunk"], "left")
    origins = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(o).alias("origin")) for k, o in enumerate(deep.ORIGINS))))
    queue = _questions(spark, d).select("query", origins.alias("o")).select("query", "o.place", "o.origin", F.lit("ok").alias("pack_status"))
    return deep.complex_queue(queue, settle(contexts, "contexts"), _questions(spark, d), simple)[0]
