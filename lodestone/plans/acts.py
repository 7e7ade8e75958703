"""Queries over structured documents: units, headings, alignment, parent windows.

The tables hold plain prose. ``acts`` marks every document's sentences up as a
regulation (articles, numbered parts, lists, chapters, references), by the place
of each sentence alone, so the structure grows with the table and SQL can do the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import structure as st
from lodestone.functions.arrays import let
from lodestone.operators import align as al
from lodestone.operators import context as cx
from lodestone.operators import headings as hd
from lodestone.operators import matching as mt
from lodestone.operators import retrieval, scan
from lodestone.operators.settle import settle
from lodestone.plans.catalog import FUSED, _lists, query
from lodestone.session import table

# ---- regulations from prose

_MARKS = {
    1: ("'Статья ' || (i // 9 + 1) || '. ' || p", lambda p, i: F.concat(F.lit("Статья "), (F.floor(i / 9) + 1).cast("string"), F.lit(". "), p)),
    2: ("'1. ' || p || ' Согласно пункту 3 настоящих Правил.'", lambda p, i: F.concat(F.lit("1. "), p, F.lit(" Согласно пункту 3 настоящих Правил."))),
    3: ("'1. а) ' || p", lambda p, i: F.concat(F.lit("1. а) "), p)),
    4: ("'1. б) ' || p", lambda p, i: F.concat(F.lit("1. б) "), p)),
    5: ("'2. ' || p || ' По статье 213 Трудового кодекса.'", lambda p, i: F.concat(F.lit("2. "), p, F.lit(" По статье 213 Трудового кодекса."))),
    6: ("'а) ' || p", lambda p, i: F.concat(F.lit("а) "), p)),
    8: ("'3. ' || p || ' Согласно статье ' || (1 + i * 7 % 5) || '.'", lambda p, i: F.concat(F.lit("3. "), p, F.lit(" Согласно статье "), (1 + i * 7 % 5).cast("string"), F.lit("."))),
}
_CASES = " ".join(f"WHEN i % 9 = {m} THEN {sql}" for m, (sql, _) in _MARKS.items())
#: doc and its paragraphs ps, as lists.
PARAGRAPHS = f"""prose AS (SELECT doc_id AS doc, list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS xs FROM documents),
acts AS (SELECT doc, list_transform(xs, lambda p, i: CASE WHEN i % 27 = 0 THEN 'Глава ' || (i // 27) || '. ' || p[1:60] {_CASES} ELSE p END) AS ps FROM prose)"""


def acts(spark, d, only: DataFrame | None = None) -> DataFrame:
    """doc and its paragraphs ``ps``; with ``only`` (doc, few rows) of those documents alone."""
    docs = table(spark, d, "documents")
    if only is not None:
        docs = docs.join(only.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def marked(p, k):
        i = k + 1
        out = F.when(i % 27 == 0, F.concat(F.lit("Глава "), F.floor(i / 27).cast("string"), F.lit(". "), F.substring(p, 1, 60)))
        for m, (_, form) in _MARKS.items():
            out = out.when(i % 9 == m, form(p, i))
        return out.otherwise(p)

    lines = F.transform(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n")), "\n", -1), lambda x: F.trim(x))
    return docs.select(F.col("doc_id").alias("doc"), let(F.filter(lines, lambda x: x != ""), lambda xs: F.transform(xs, marked)).alias("ps"))


def act_units(marked: DataFrame) -> DataFrame:
    """Of ``acts``: doc, ordinal (from 1), kind, number, title, heading, paragraphs."""
    rows = marked.select("doc", F.posexplode(st.parse_units(F.col("ps"))).alias("at", "u"))
    return rows.select("doc", (F.col("at") + 1).cast("long").alias("ordinal"), "u.*")


#: ar, it, hd: the patterns of ``structure`` in RE2.
_AR, _IT, _HD = r"^Статья\s+(\d+(?:\.\d+)*(?:-\d+)?)\.\s*(.*)$", r"^(\d+(?:\(\d+\))?(?:\.\d+)*)\\?\.\s+\S", r"^(?:Раздел|РАЗДЕЛ|Глава|ГЛАВА|[IVXLC]+\.)\s+\S.{0,150}$"
UNITS = f"""para AS (SELECT doc, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM acts),
flag AS (SELECT *, regexp_matches(p, '{_HD}') AND NOT regexp_matches(p, '{_IT}') AS hd, regexp_matches(p, '{_AR}') AS ar, regexp_matches(p, '{_IT}') AS it, count(*) FILTER (regexp_matches(p, '{_AR}')) OVER (PARTITION BY doc) >= 2 AS bya FROM para),
numb AS (SELECT *, NOT hd AND CASE WHEN bya THEN ar ELSE it END AS opens, last_value(CASE WHEN hd THEN p END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS above FROM flag),
grp AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY i) AS g FROM numb),
un AS (SELECT doc, g, bya, list(p ORDER BY i) AS paragraphs, first(above ORDER BY i) AS above FROM grp GROUP BY ALL),
units AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY g) AS ordinal, CASE WHEN g = 0 THEN 'preamble' WHEN bya THEN 'article' ELSE 'item' END AS kind,
CASE WHEN g = 0 THEN '' WHEN bya THEN regexp_extract(paragraphs[1], '{_AR}', 1) ELSE regexp_extract(paragraphs[1], '{_IT}', 1) END AS number,
CASE WHEN g > 0 AND bya THEN regexp_extract(paragraphs[1], '{_AR}', 2) ELSE '' END AS title, CASE WHEN g = 0 THEN '' ELSE coalesce(above[1:100], '') END AS heading, paragraphs FROM un)"""


@query(f"WITH {PARAGRAPHS}, {UNITS} SELECT doc, ordinal, kind, number, title, heading, paragraphs FROM units")
def unit_segmentation(spark, d):
    return act_units(acts(spark, d))


@query()
def structural_chunks(spark, d):
    """Chunks of at most 900 characters that follow units and parts; greedy packing is beyond one SQL statement, tests hold it against plain loops."""
    cut = st.chunk_structural(F.col("ps"), F.concat(F.lit("doc "), F.col("doc").cast("string")), 900)
    return acts(spark, d).select("doc", F.posexplode(cut).alias("ord", "c")).select("doc", "ord", "c.prefix", "c.body")


@query()
def paragraph_chunks(spark, d):
    cut = st.chunk_paragraphs(F.col("ps"), 200, 900)
    return acts(spark, d).select("doc", F.posexplode(cut).alias("ord", "body"))


# ---- heading paths and what they carry

#: An item's level where it is a heading: chapters 1, articles 2, parts 3.
_LEVEL = "CASE WHEN p LIKE 'Глава %' THEN 1 WHEN p LIKE 'Статья %' THEN 2 WHEN regexp_matches(p, '^[0-9]+[.] ') THEN 3 END"
ITEMS = f"items AS (SELECT doc, i AS ord, p AS text, {_LEVEL} AS level FROM (SELECT doc, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM acts))"


def _items(spark, d) -> DataFrame:
    rows = acts(spark, d).select("doc", F.posexplode("ps").alias("at", "text"))
    level = F.when(F.col("text").startswith("Глава "), 1).when(F.col("text").startswith("Статья "), 2).when(F.rlike("text", F.lit("^[0-9]+[.] ")), 3)
    return rows.select("doc", (F.col("at") + 1).alias("ord"), "text", level.alias("level"))


@query(
    f"""WITH {PARAGRAPHS}, {ITEMS}, open AS (SELECT a.doc, a.ord, h.level, arg_max(h.text, h.ord) AS text, max(h.ord) AS at FROM items a JOIN items h ON h.doc = a.doc AND h.ord <= a.ord AND h.level IS NOT NULL WHERE a.level IS NULL GROUP BY ALL),
alive AS (SELECT * FROM open o WHERE NOT EXISTS (FROM open x WHERE x.doc = o.doc AND x.ord = o.ord AND x.level < o.level AND x.at > o.at))
SELECT doc, ord, coalesce(list(text ORDER BY level) FILTER (text IS NOT NULL), []) AS path FROM (SELECT doc, ord FROM items WHERE level IS NULL) LEFT JOIN alive USING (doc, ord) GROUP BY ALL"""
)
def heading_paths(spark, d):
    return scan.heading_paths(_items(spark, d), levels=4, block=64).filter("level is null").select("doc", "ord", "path")


# ---- alignment

_CHUNK = "range(0, (len(ps) + 3) // 4)"
WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[а-яёa-z0-9]+'), lambda x: len(x) >= 4)))"
CHUNKS = f"""chunks AS (SELECT doc, k AS ord, body, nullif(regexp_extract(body, 'Статья ([0-9]+)[.]', 1), '') AS article, nullif(regexp_extract(body, '(?m)^([0-9]+)[.] ', 1), '') AS part, first AS heading_path
FROM (SELECT doc, unnest({_CHUNK}) AS k, ps, ps[1] AS first FROM acts), LATERAL (SELECT array_to_string(ps[4 * k + 1 : 4 * k + 4], chr(10)) AS body))"""


def act_chunks(marked: DataFrame) -> DataFrame:
    """Of ``acts``: four paragraphs are a chunk; doc, ord, body, article, part, heading_path."""
    ps = F.col("ps")
    bodies = F.transform(F.sequence(F.lit(0), F.size(ps) - 1, F.lit(4)), lambda at: F.array_join(F.slice(ps, at + 1, 4), "\n"))
    rows = marked.filter(F.size("ps") > 0).select("doc", F.get(ps, F.lit(0)).alias("heading_path"), F.posexplode(bodies).alias("ord", "body"))
    found = lambda pattern: F.nullif(F.regexp_extract("body", pattern, 1), F.lit(""))
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), "body", found(r"Статья ([0-9]+)[.]").alias("article"), found(r"(?m)^([0-9]+)[.] ").alias("part"), "heading_path")


def _units_text(marked: DataFrame) -> DataFrame:
    return act_units(marked).withColumn("text", F.array_join("paragraphs", "\n"))


ALIGN = f"""{PARAGRAPHS}, {UNITS}, {CHUNKS},
cw AS (SELECT *, {WORDS.format("body")} AS w, {WORDS.format("heading_path")} AS h FROM chunks),
uw AS (SELECT doc, ordinal, kind, number, array_to_string(paragraphs, chr(10)) AS text, {WORDS.format("array_to_string(paragraphs, chr(10))")} AS w FROM units),
pair AS (SELECT c.doc, c.ord, u.ordinal, u.kind, CASE WHEN len(c.w) > 0 THEN len(list_intersect(c.w, u.w))::DOUBLE / len(c.w) ELSE 0::DOUBLE END AS score,
CASE WHEN u.kind = 'article' AND c.article = u.number THEN 0.03::DOUBLE ELSE 0::DOUBLE END + CASE WHEN c.part IS NOT NULL AND regexp_matches(u.text, '(?:^|\\n)' || c.part || '\\.\\s') THEN 0.015::DOUBLE ELSE 0::DOUBLE END
+ CASE WHEN len(c.h) > 0 THEN 0.015::DOUBLE * len(list_intersect(c.h, u.w)) / len(c.h) ELSE 0::DOUBLE END AS bonus, 0.01::DOUBLE * len(list_intersect(c.w, u.w)) / greatest(1, len(u.w)) AS spec, len(c.w) AS nw FROM cw c JOIN uw u USING (doc)),
em AS MATERIALIZED (SELECT doc, ord, list(score + bonus + spec ORDER BY ordinal) AS e FROM pair GROUP BY ALL),
fwd AS (WITH RECURSIVE r AS (SELECT doc, ord, e AS prev, CAST([] AS BIGINT[]) AS came FROM em WHERE ord = 0 UNION ALL
SELECT doc, ord, list_transform(s, lambda x, j: x.v + e[j]), list_transform(s, lambda x: x.b) FROM (SELECT em.doc, em.ord, em.e, list_transform(range(1, len(prev) + 1), lambda j: CASE WHEN j < len(prev) AND prev[j + 1] - 0.15::DOUBLE > list_max(prev[1:j]) THEN {{'v': prev[j + 1] - 0.15::DOUBLE, 'b': j + 1}} ELSE {{'v': list_max(prev[1:j]), 'b': list_position(prev, list_max(prev[1:j]))::BIGINT}} END) AS s FROM r JOIN em ON em.doc = r.doc AND em.ord = r.ord + 1)) SELECT * FROM r),
back AS (WITH RECURSIVE t AS (SELECT doc, ord, list_position(prev, list_max(prev))::BIGINT AS j, came FROM fwd WHERE (doc, ord) IN (SELECT doc, max(ord) FROM em GROUP BY doc) UNION ALL
SELECT f.doc, f.ord, t.came[t.j], f.came FROM t JOIN fwd f ON f.doc = t.doc AND f.ord = t.ord - 1) SELECT doc, ord, j FROM t),
aligned AS (SELECT doc, ord, CASE WHEN nw = 0 OR score < 0.6::DOUBLE THEN NULL ELSE j END AS parent, j AS candidate, score, best_score, bonus, CASE WHEN nw = 0 THEN 'empty_words' WHEN score < 0.6::DOUBLE THEN 'below_threshold' END AS reason, coalesce(j < lag(j) OVER (PARTITION BY doc ORDER BY ord), false) AS rollback
FROM back JOIN pair USING (doc, ord) JOIN (SELECT doc, ord, max(score) AS best_score FROM pair GROUP BY ALL) USING (doc, ord) WHERE ordinal = j)"""


def _aligned(marked: DataFrame) -> DataFrame:
    return al.align(act_chunks(marked), _units_text(marked))


@query(f"WITH {ALIGN} SELECT doc, ord, parent, candidate, round(score, 9) AS score, round(best_score, 9) AS best_score, round(bonus, 9) AS bonus, reason, rollback FROM aligned")
def monotone_alignment(spark, d):
    short = lambda c: F.round(c, 9).alias(c)
    return _aligned(acts(spark, d)).select("doc", "ord", "parent", "candidate", short("score"), short("best_score"), short("bonus"), "reason", "rollback")


@query(
    f"""WITH {ALIGN} SELECT doc, count(*) AS chunks, count(*) FILTER (parent IS NULL) AS without_parent, count(*) FILTER (reason = 'no_units') AS n_no_units, count(*) FILTER (reason = 'empty_words') AS n_empty_words, count(*) FILTER (reason = 'below_threshold') AS n_below_threshold,
count(*) FILTER (rollback) AS rollbacks, round(sum(score), 6) AS score_sum, count(*) FILTER (kind = 'preamble') AS preamble_parents FROM aligned LEFT JOIN (SELECT doc, ordinal AS parent, kind FROM units) USING (doc, parent) GROUP BY GROUPING SETS ((doc), ())"""
)
def alignment_statistics(spark, d):
    return al.alignment_statistics(_aligned(acts(spark, d)), act_units(acts(spark, d)))


# ---- windows of units around chunks

_PW = 600
WINDOWS = f"""{ALIGN},
pw AS (SELECT a.doc, a.ord AS chunk, a.doc || '::' || u.kind || ':' || u.number || ':' || u.ordinal AS parent_id, u.paragraphs AS qs, array_to_string(u.paragraphs, chr(10)) AS whole, c.w FROM aligned a JOIN units u ON u.doc = a.doc AND u.ordinal = a.parent JOIN cw c ON c.doc = a.doc AND c.ord = a.ord),
sc AS (SELECT *, list_transform(qs, lambda q: len(list_intersect({WORDS.format("q")}, w))) AS s FROM pw),
grow AS (WITH RECURSIVE g AS (SELECT doc, chunk, qs, list_position(s, list_max(s)) AS lo, list_position(s, list_max(s)) AS hi, len(qs[list_position(s, list_max(s))]) AS size, 0 AS n FROM sc UNION ALL
SELECT doc, chunk, qs, lo, CASE WHEN hi < len(qs) AND size + len(qs[hi + 1]) + 1 <= {_PW} THEN hi + 1 ELSE hi END, CASE WHEN hi < len(qs) AND size + len(qs[hi + 1]) + 1 <= {_PW} THEN size + len(qs[hi + 1]) + 1 ELSE size END, n FROM
(SELECT doc, chunk, qs, CASE WHEN lo > 1 AND size + len(qs[lo - 1]) + 1 <= {_PW} THEN lo - 1 ELSE lo END AS lo, hi, CASE WHEN lo > 1 AND size + len(qs[lo - 1]) + 1 <= {_PW} THEN size + len(qs[lo - 1]) + 1 ELSE size END AS size, n + 1 AS n FROM g WHERE n < len(qs))) SELECT doc, chunk, lo, hi FROM g WHERE n = len(qs)),
wins AS (SELECT doc, chunk, parent_id, len(whole) > {_PW} AS truncated, CASE WHEN len(whole) <= {_PW} THEN whole WHEN len(qs[list_position(s, list_max(s))]) > {_PW} THEN list_reduce(list_transform(range(1, len(qs[list_position(s, list_max(s))]) + 1, {_PW}), lambda a: qs[list_position(s, list_max(s))][a : a + {_PW - 1}]), lambda x, y: CASE WHEN len(list_intersect({WORDS.format("y")}, w)) > len(list_intersect({WORDS.format("x")}, w)) THEN y ELSE x END)
ELSE array_to_string(qs[lo:hi], chr(10)) END AS text FROM sc JOIN grow USING (doc, chunk))"""


def _windows(marked: DataFrame) -> DataFrame:
    return al.parent_windows(_aligned(marked), act_chunks(marked), act_units(marked), _PW)


@query(f"WITH {WINDOWS} SELECT doc, chunk, parent_id, text, truncated FROM wins")
def parent_windows(spark, d):
    return _windows(acts(spark, d))


#: The first three chunks of each question's four best documents, in order.
PASSAGES = f"""{FUSED}, pass AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank, ord) AS rank, f.doc, ord AS chunk, body AS text, score FROM fused f JOIN chunks c ON c.doc = f.doc AND c.ord < 3 AND f.rank <= 4)"""


def _retrieved(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each question's four best documents (query, rank, doc, score), the lexical list (query, rank, doc), and ``acts`` of the best documents.

    All are written once. What a question's context is made of never leaves its
    passages' own documents, so only these are marked up, cut and aligned.
    """
    lists = settle(_lists(spark, d), "lists")
    best = settle(retrieval.fuse(lists).filter("rank <= 4").select("query", "rank", "doc", "score"), "best")
    return best, lists.filter("list = 1").select("query", "rank", "doc"), settle(acts(spark, d, best), "marked")


def act_passages(best: DataFrame, marked: DataFrame) -> DataFrame:
    """query, rank, doc, chunk, text, score."""
    near = act_chunks(marked).filter("ord < 3").select("doc", F.col("ord").alias("chunk"), F.col("body").alias("text"))
    rows = best.select("query", F.col("rank").alias("__rank"), "doc", "score").join(near, "doc")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("__rank", "chunk"))
    return rows.select("query", rank.alias("rank"), "doc", "chunk", "text", "score")


@query(
    f"""WITH {WINDOWS}, {PASSAGES}, r AS (SELECT p.*, parent_id, coalesce(w.text, p.text) AS t, CASE WHEN w.text IS NULL THEN rank END AS own FROM pass p LEFT JOIN wins w USING (doc, chunk))
SELECT query, row_number() OVER (PARTITION BY query ORDER BY min(rank)) AS rank, doc, arg_min(chunk, rank) AS chunk, t AS text, parent_id, CASE WHEN parent_id IS NOT NULL THEN list(chunk ORDER BY rank) END AS child_chunk_ids FROM r GROUP BY query, doc, parent_id, t, own"""
)
def parent_context(spark, d):
    """Retrieved chunks give way to the windows of their units."""
    best, _, marked = _retrieved(spark, d)
    return al.replace_parents(act_passages(best, marked), _windows(marked), _PW)


# ---- context: references, order, packing

CORPUS = "corpus AS (SELECT doc::VARCHAR AS source, ord AS chunk, body AS text, (ord // 5)::INT AS page, (ord // 2 % 3)::VARCHAR AS bbox, 'раздел ' || (ord // 6) AS section FROM chunks)"


def act_corpus(marked: DataFrame) -> DataFrame:
    """Of ``acts``: chunks with pages of five, boxes of two and sections of six."""
    at = F.col("ord")
    return act_chunks(marked).select(F.col("doc").cast("string").alias("source"), at.alias("chunk"), F.col("body").alias("text"), F.floor(at / 5).cast("int").alias("page"), (F.floor(at / 2) % 3).cast("string").alias("bbox"), F.concat(F.lit("раздел "), F.floor(at / 6).cast("string")).alias("section"))


def _placed(best: DataFrame, marked: DataFrame) -> DataFrame:
    """The retrieved chunks as passages: query, ord, source, chunk, text, score, page, bbox, section."""
    rows = act_passages(best, marked).select("query", F.col("rank").alias("ord"), F.col("doc").cast("string").alias("source"), "chunk", "score")
    return settle(rows.join(act_corpus(marked), ["source", "chunk"]), "placed")


def _near(lexical: DataFrame, marked: DataFrame) -> DataFrame:
    """The fourth chunk of each lexically near document that some question's passages come from; others cannot be added."""
    fourth = act_corpus(marked).filter("chunk = 3").select("source", "chunk", "text")
    return lexical.select("query", "rank", F.col("doc").cast("string").alias("source")).join(fourth, "source")


EXPANDED = f"""{PARAGRAPHS}, {CHUNKS}, {PASSAGES}, {CORPUS},
placed AS (SELECT p.query, p.rank AS ord, c.source, c.chunk, c.text, p.score, c.page, c.bbox, c.section FROM pass p JOIN corpus c ON c.source = p.doc::VARCHAR AND c.chunk = p.chunk),
named AS (SELECT *, list_distinct(list_concat(list_transform(regexp_extract_all(text, 'пункту? ([0-9]+)', 1), lambda n: 'clause' || n), list_transform(regexp_extract_all(text, 'Согласно статье ([0-9]+)', 1), lambda n: 'article' || n))) AS rs FROM placed),
held AS (SELECT *, list_distinct(list_concat(list_transform(regexp_extract_all(text, '(?m)^([0-9]+)[.] ', 1), lambda n: 'clause' || n), list_transform(regexp_extract_all(text, 'пункту? ([0-9]+)', 1), lambda n: 'clause' || n), list_transform(regexp_extract_all(text, '(?:Статья|статье) ([0-9]+)', 1), lambda n: 'article' || n))) AS us FROM corpus),
elem AS (SELECT *, nullif(regexp_extract(text, '^([0-9]+)[.] [аб][)]', 1), '') AS num FROM corpus),
cand AS (SELECT query, 1 AS way, ord, h.chunk AS pos, h.* FROM named n JOIN held h ON h.source = n.source AND list_has_any(n.rs, h.us)
UNION ALL BY NAME SELECT l.query, 2 AS way, 0 AS ord, l.rank AS pos, c.* EXCLUDE (page, bbox, section) FROM lex l JOIN corpus c ON c.source = l.doc::VARCHAR AND c.chunk = 3 WHERE (l.query, c.source) IN (SELECT query, source FROM placed)
UNION ALL BY NAME SELECT p.query, 3 AS way, p.ord, e.chunk AS pos, e.* FROM placed p JOIN elem e ON e.source = p.source AND e.num = nullif(regexp_extract(p.text, '^([0-9]+)[.] [аб][)]', 1), '')
UNION ALL BY NAME SELECT p.query, 4 AS way, p.ord, c.chunk AS pos, c.*, p.score AS beside FROM placed p JOIN corpus c USING (source, page, bbox)),
seq AS MATERIALIZED (SELECT query, way, ord, pos, source, chunk, text, page, bbox, section, beside, row_number() OVER (PARTITION BY query ORDER BY way, ord, pos) AS n FROM cand),
fold AS (WITH RECURSIVE f AS (SELECT query, 0::BIGINT AS n, list(DISTINCT text) AS seen, 0 AS n1, 0 AS np, -1::BIGINT AS last, 0 AS n3, 0 AS n4, false AS ok FROM placed GROUP BY query UNION ALL
SELECT query, n, CASE WHEN ok THEN list_append(seen, text) ELSE seen END, n1 + (ok AND way = 1)::INT, CASE WHEN way = 1 THEN base + ok::INT ELSE np END, CASE WHEN way = 1 THEN ord ELSE last END, n3 + (ok AND way = 3)::INT, n4 + (ok AND way = 4)::INT, ok FROM
(SELECT *, NOT list_contains(seen, text) AND CASE way WHEN 1 THEN n1 < 15 AND base < 5 WHEN 3 THEN n3 < 10 WHEN 4 THEN n4 < 10 ELSE true END AS ok FROM (SELECT f.query, s.n, f.seen, f.n1, f.np, f.last, f.n3, f.n4, s.way, s.ord, s.text, CASE WHEN s.ord = f.last THEN f.np ELSE 0 END AS base FROM f JOIN seq s ON s.query = f.query AND s.n = f.n + 1))) SELECT query, n FROM f WHERE ok),
taken AS (SELECT s.* FROM seq s JOIN fold USING (query, n)),
every AS (SELECT query, 0 AS part, ord, 0 AS n, source, chunk, text, score, page, bbox, section, false AS cross_ref FROM placed
UNION ALL BY NAME SELECT query, 1 AS part, 0 AS ord, n, source, chunk, text, 0.35::DOUBLE AS score, page, bbox, section, true AS cross_ref FROM taken WHERE way < 4
UNION ALL BY NAME SELECT t.query, 0 AS part, p.ord, t.n, t.source, t.chunk, t.text, t.beside AS score, t.page, t.bbox, t.section, true AS cross_ref FROM taken t JOIN placed p USING (query, source, page, bbox) WHERE way = 4),
expanded AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY part, ord, n) AS place, * EXCLUDE (query, part, ord, n) FROM every)"""


def _expanded(spark, d) -> tuple[DataFrame, DataFrame]:
    """The passages, and what expansion makes of them."""
    best, lexical, marked = _retrieved(spark, d)
    placed = _placed(best, marked)
    return placed, cx.expand_references(placed, act_corpus(marked), _near(lexical, marked))


@query(f"WITH {EXPANDED} SELECT query, place AS ord, source, chunk, text, score, cross_ref FROM expanded")
def reference_expansion(spark, d):
    return _expanded(spark, d)[1].select("query", "ord", "source", "chunk", "text", "score", "cross_ref")


#: Every tail passage with the references it closes; picked one after another.
CLOSING = f"""{EXPANDED},
tail AS (SELECT e.* FROM expanded e WHERE NOT EXISTS (FROM placed p WHERE p.query = e.query AND p.source = e.source AND p.text = e.text)),
marks AS (SELECT DISTINCT query, source, unnest(rs) AS r FROM named WHERE ord <= 5),
opens AS (SELECT source, text, list_distinct(list_concat(list_transform(regexp_extract_all(text, '(?m)^([0-9]+)[.] ', 1), lambda n: 'clause' || n), list_transform(regexp_extract_all(text, '(?m)^Статья ([0-9]+)[.]', 1), lambda n: 'article' || n))) AS us FROM corpus),
asked AS (SELECT query, list(source || '|' || r ORDER BY source, r) AS asked FROM marks GROUP BY query),
shut AS (SELECT m.query, list(DISTINCT m.source || '|' || r) AS done FROM marks m JOIN placed p USING (query, source) JOIN opens o ON o.source = p.source AND o.text = p.text WHERE list_contains(o.us, r) GROUP BY m.query),
closes AS (SELECT t.query, t.place, list(DISTINCT m.source || '|' || r) AS us FROM tail t JOIN marks m USING (query, source) JOIN opens o ON o.source = t.source AND o.text = t.text WHERE list_contains(o.us, r) GROUP BY ALL),
work AS (SELECT query, asked, coalesce(done, []) AS done, list({{'place': place, 'us': us}} ORDER BY place) AS cs FROM asked JOIN closes USING (query) LEFT JOIN shut USING (query) GROUP BY ALL),
pick AS (WITH RECURSIVE k AS (SELECT query, asked, done, cs, CAST(NULL AS BIGINT) AS place, 0 AS step FROM work UNION ALL
SELECT query, asked, list_concat(done, b.us), list_filter(cs, lambda c: c.place <> b.place), b.place, step + 1 FROM (SELECT *, list_sort(list_transform(cs, lambda c: {{'open': len(list_distinct(list_transform(list_filter(asked, lambda a: NOT list_contains(list_concat(done, c.us), a)), lambda a: string_split(a, '|')[2]))), 'place': c.place, 'us': c.us}}))[1] AS b FROM k WHERE len(cs) > 0)
WHERE b.open < len(list_distinct(list_transform(list_filter(asked, lambda a: NOT list_contains(done, a)), lambda a: string_split(a, '|')[2])))) SELECT query, place, step FROM k WHERE step > 0),
ordered AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY part, pos) AS ord, source, chunk, text, score, section FROM (SELECT query, 0 AS part, ord AS pos, source, chunk, text, score, section FROM placed UNION ALL SELECT query, CASE WHEN step IS NULL THEN 2 ELSE 1 END, coalesce(step, place), source, chunk, text, score, section FROM tail LEFT JOIN pick USING (query, place)))"""


@query(f"WITH {CLOSING} SELECT query, ord, source, chunk, text FROM ordered")
def closing_order(spark, d):
    return cx.closing_order(*_expanded(spark, d)).select("query", "ord", "source", "chunk", "text")


_LIMITS = cx.Limits(passages=30, tokens=2500)
PACKED = f"""{CLOSING},
costed AS (SELECT *, len(text) // 4 + 48 AS cost FROM ordered),
packed AS (SELECT *, sum(cost) OVER (PARTITION BY query ORDER BY ord ROWS UNBOUNDED PRECEDING) AS spent FROM costed WHERE ord <= 30 QUALIFY spent <= 2500)"""


@query(f"WITH {PACKED} SELECT query, ord, source, chunk, cost FROM packed")
def packed_context(spark, d):
    return cx.pack_context(*_expanded(spark, d), _LIMITS)[0].select("query", "ord", "source", "chunk", "cost")


@query(f"WITH {PACKED} SELECT query, 'ok' AS status, count(*) FILTER (spent IS NOT NULL) AS kept, count(*) FILTER (spent IS NULL) AS dropped FROM ordered LEFT JOIN (SELECT query, ord, spent FROM packed) USING (query, ord) GROUP BY query")
def packing_report(spark, d):
    return cx.pack_context(*_expanded(spark, d), _LIMITS)[1]


@query(
    f"""WITH {PARAGRAPHS}, {CHUNKS}, {PASSAGES}, {CORPUS},
placed AS (SELECT p.query, p.rank AS ord, c.source, c.chunk, c.text, c.section FROM pass p JOIN corpus c ON c.source = p.doc::VARCHAR AND c.chunk = p.chunk),
anch AS (SELECT query, source, section, min(ord) AS anchor FROM placed WHERE ord <= 3 GROUP BY ALL),
found AS (SELECT a.query, anchor, c.source, c.chunk, c.text FROM anch a JOIN (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY chunk) AS k FROM corpus QUALIFY k <= 5) c USING (source, section) WHERE (a.query, c.text) NOT IN (SELECT query, text FROM placed)),
one AS (SELECT query, text, first(source ORDER BY anchor, chunk) AS source, first(chunk ORDER BY anchor, chunk) AS chunk, min({{'a': anchor, 'c': chunk}}) AS place FROM found GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY fetched, place) AS ord, source, chunk, fetched FROM (SELECT query, source, chunk, false AS fetched, {{'a': ord, 'c': 0}} AS place FROM placed UNION ALL SELECT query, source, chunk, true, place FROM one)"""
)
def section_fetch(spark, d):
    """The first three anchors' sections, five chunks each."""
    best, _, marked = _retrieved(spark, d)
    return cx.fetch_sections(_placed(best, marked), act_corpus(marked), most=5).select("query", "ord", "source", "chunk", "fetched")


# ---- articles and parts that go on

_TITLE = "CASE WHEN len({0}) <= 200 THEN {0} ELSE regexp_extract({0}[1:200], '(?s)^(.*) [^ ]*$', 1) || '…' END"
CARRIED = f"""{PARAGRAPHS}, {CHUNKS},
chap AS (SELECT doc, (i - 1) // 4 AS ord, i, last_value(CASE WHEN p LIKE 'Глава %' THEN p END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS chapter FROM (SELECT doc, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM acts)),
hc AS (SELECT doc, c.ord, body, chapter, list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ls FROM chunks c JOIN chap h USING (doc, ord) WHERE h.i = 4 * c.ord + 1),
met AS (SELECT *, regexp_matches(ls[1], '^Статья [0-9]+[.] \\S') AS opens, list_filter(ls, lambda x: regexp_matches(x, '^Статья [0-9]+[.]( \\S|$)'))[-1] AS last FROM hc),
cur AS (SELECT *, CASE WHEN opens THEN ls[1] ELSE last_value(last IGNORE NULLS) OVER (PARTITION BY doc, chapter ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS current FROM met),
carried AS (SELECT doc, ord, body, list_concat(CASE WHEN chapter IS NULL THEN [] ELSE [chapter] END, CASE WHEN current IS NULL THEN [] ELSE [{_TITLE.format("current")}] END) AS headings, opens FROM cur)"""


def _carried(spark, d) -> DataFrame:
    chapters = scan.heading_paths(_items(spark, d).withColumn("level", F.when(F.col("level") == 1, 0)), levels=1, block=64)
    first = chapters.filter((F.col("ord") - 1) % 4 == 0).select("doc", F.floor((F.col("ord") - 1) / 4).alias("ord"), F.col("path").alias("headings"))
    return hd.resolve_articles(act_chunks(acts(spark, d)).select("doc", "ord", F.col("body").alias("text")).join(first, ["doc", "ord"]), block=16)


@query(f"WITH {CARRIED} SELECT doc, ord, headings, opens FROM carried")
def inline_articles(spark, d):
    return _carried(spark, d).select("doc", "ord", "headings", "opens")


@query(
    f"""WITH {CARRIED}, art AS (SELECT doc, ord, nullif(regexp_extract(array_to_string(headings, ' > '), '.*Статья ([0-9]+)[.]', 1), '') AS article, CASE WHEN opens THEN regexp_replace(body, '^[^\\n]*\\n?', '') ELSE body END AS b FROM carried),
mk AS (SELECT *, list_concat(regexp_extract_all(b, '(?m)^([0-9]+)[.][ \\t]*\\n?[ \\t]*[А-ЯЁ]', 1), list_filter([regexp_extract(b, '(?:^|\\n)([0-9]+)[.]\\s*$', 1)], lambda x: x <> '')) AS marks, nullif(regexp_extract(b, '^([0-9]+)[.][ \\t]*\\n?[ \\t]*[А-ЯЁ]', 1), '') AS start FROM art),
ca AS (SELECT *, last_value(marks[-1] IGNORE NULLS) OVER (PARTITION BY doc, article ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(len(marks)) OVER (PARTITION BY doc, article) > 0 AND article IS NOT NULL AS parted FROM mk),
pt AS (SELECT *, CASE WHEN parted THEN coalesce(start, before) END AS part FROM ca)
SELECT doc, ord, article, part, CASE WHEN part IS NOT NULL THEN start IS NULL END AS part_inherited, CASE WHEN part IS NOT NULL THEN coalesce(marks[-1], part) END AS part_end FROM pt"""
)
def article_parts(spark, d):
    rows = _carried(spark, d).select("doc", "ord", "text", F.array_join("headings", " > ").alias("heading_path"))
    return hd.annotate_parts(rows, block=16).select("doc", "ord", "article", "part", "part_inherited", "part_end")


# ---- matching by shared words

_W = WORDS.format("text")
#: Old chunks are four paragraphs; new ones two or three, or the old ones again where the number is a multiple of five.
SNAPSHOTS = f"""{PARAGRAPHS}, {CHUNKS}, old AS (SELECT doc::VARCHAR AS source, ord AS num, body AS text FROM chunks),
new AS (SELECT source, num + 1 AS num, '  ' || text AS text FROM old WHERE num % 5 = 0 UNION ALL SELECT doc::VARCHAR, 1000 + k, array_to_string(ps[3 * k + 1 : 3 * k + 3], chr(10)) FROM acts, LATERAL (SELECT unnest(range(0, (len(ps) + 2) // 3)) AS k))"""


@query(
    f"""WITH {SNAPSHOTS}, o AS (SELECT source, num, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t, {_W} AS ws FROM old), n AS (SELECT source, num, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t, {_W} AS ws FROM new),
ex AS (SELECT o.source, o.num, first(n.num ORDER BY abs(n.num - o.num), n.num) AS same FROM o JOIN n ON n.source = o.source AND n.t = o.t GROUP BY ALL),
common AS (SELECT source, list(w) AS cw FROM (SELECT source, w, count(*) AS df FROM (SELECT source, unnest(ws) AS w FROM n) GROUP BY ALL) JOIN (SELECT source, count(*) AS c FROM n GROUP BY 1) USING (source) WHERE df * 10 > c GROUP BY source),
rn AS (SELECT source, num, list_filter(ws, lambda w: NOT list_contains(coalesce(cw, []), w)) AS ws FROM n LEFT JOIN common USING (source)),
ro AS (SELECT source, num, same, list_filter(ws, lambda w: NOT list_contains(coalesce(cw, []), w)) AS ws FROM o LEFT JOIN common USING (source) LEFT JOIN ex USING (source, num)),
pr AS (SELECT ro.source, ro.num, rn.num AS target, len(list_intersect(ro.ws, rn.ws)) AS k, len(rn.ws) AS nn FROM ro JOIN rn USING (source)),
fd AS (SELECT source, num, coalesce(list(target ORDER BY target) FILTER (nn >= 5 AND k * 10 >= nn * 6), []) AS split, first(target ORDER BY k DESC, target) AS best, max(k) AS k FROM pr GROUP BY ALL),
kd AS (SELECT *, CASE WHEN same IS NOT NULL THEN 'exact' WHEN len(ws) = 0 THEN 'no-words' WHEN len(split) > 0 THEN 'split' WHEN k * 10 >= len(ws) * 8 THEN 'merge' ELSE 'unmapped' END AS kind FROM ro LEFT JOIN fd USING (source, num))
SELECT source, num, CASE kind WHEN 'exact' THEN [same] WHEN 'split' THEN split WHEN 'merge' THEN [best] ELSE CAST([] AS BIGINT[]) END AS targets, kind FROM kd"""
)
def snapshot_remap(spark, d):
    old = act_chunks(acts(spark, d)).select(F.col("doc").cast("string").alias("source"), F.col("ord").alias("num"), F.col("body").alias("text"))
    again = old.filter("num % 5 = 0").select("source", (F.col("num") + 1).alias("num"), F.concat(F.lit("  "), F.col("text")).alias("text"))
    ps = F.col("ps")
    cut = F.transform(F.sequence(F.lit(0), F.size(ps) - 1, F.lit(3)), lambda at: F.array_join(F.slice(ps, at + 1, 3), "\n"))
    fresh = acts(spark, d).filter(F.size("ps") > 0).select(F.col("doc").cast("string").alias("source"), F.posexplode(cut).alias("k", "text"))
    return mt.remap_labels(old, again.unionByName(fresh.select("source", (F.col("k") + 1000).cast("long").alias("num"), "text")))


@query(
    f"""WITH {PARAGRAPHS}, {UNITS}, {CHUNKS}, ut AS (SELECT doc, ordinal AS unit, array_to_string(paragraphs, chr(10)) AS text FROM units),
uw AS (SELECT doc, unit, len(text) AS size, {_W} AS w FROM ut), cw AS (SELECT doc, ord AS id, {WORDS.format("body")} AS w FROM chunks),
rk AS (SELECT c.doc, c.id, len(c.w) AS nw, u.unit, len(list_intersect(c.w, u.w)) AS n, row_number() OVER (PARTITION BY c.doc, c.id ORDER BY len(list_intersect(c.w, u.w)) DESC, size, unit) AS r, count(*) OVER (PARTITION BY c.doc, c.id) AS units FROM cw c JOIN uw u USING (doc)),
two AS (SELECT doc, id, nw, max(unit) FILTER (r = 1) AS best, max(n) FILTER (r = 1) AS n, coalesce(max(n) FILTER (r = 2), 0) AS m, max(units) AS units FROM rk GROUP BY ALL),
res AS (SELECT *, CASE WHEN nw = 0 THEN 'empty_words' WHEN n * 5 < nw * 3 THEN 'below_threshold' WHEN units > 1 AND (n - m) * 10 < nw THEN 'ambiguous' END AS reason FROM two)
SELECT id, doc, CASE WHEN reason IS NULL THEN best END AS unit, round(CASE WHEN nw = 0 THEN 0 ELSE n / nw END, 9) AS score, round(CASE WHEN nw = 0 THEN 0 ELSE m / nw END, 9) AS second, reason FROM res"""
)
def norm_match(spark, d):
    texts = act_chunks(acts(spark, d)).select(F.col("ord").alias("id"), "doc", F.col("body").alias("text"))
    units = _units_text(acts(spark, d)).select("doc", F.col("ordinal").alias("unit"), "text")
    return mt.match_units(texts, units).withColumns({c: F.round(c, 9) for c in ("score", "second")})
