"""Queries of citations, scopes and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import citations, packing
from lodestone.plans import acts
from lodestone.plans.catalog import query
from lodestone.session import table
from lodestone.sources import guards


@query(
    """WITH t AS (SELECT doc_id AS id, substr(text, 1, 300) AS answer, text AS context FROM documents),
c AS (SELECT id, answer, context, 1 AS ord, 'norm' AS field, CASE WHEN id % 9 = 8 THEN 'unverifiable' ELSE 'match' END AS comparison, lower(replace(substr(context, 1, 25), ' ', '  ')) AS a, CASE WHEN id % 9 = 7 THEN substr(context, 1, 10) || ' qqq' ELSE substr(context, 1, 25) END AS q FROM t WHERE id % 11 <> 0
UNION ALL SELECT id, answer, context, 2, CASE WHEN id % 2 = 0 THEN 'date' ELSE 'norm' END, CASE id % 9 WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'missing_in_answer' WHEN 4 THEN 'missing_in_answer' WHEN 5 THEN 'other' ELSE 'match' END, CASE WHEN id % 9 IN (3, 6) THEN NULL ELSE substr(context, 5, 20) END, substr(context, 5, 20) FROM t WHERE id % 11 <> 0 AND id % 9 BETWEEN 1 AND 6),
z AS (SELECT *, trim(regexp_replace(lower(answer), '[ \\t\\r\\n]+', ' ', 'g')) AS na, trim(regexp_replace(lower(context), '[ \\t\\r\\n]+', ' ', 'g')) AS nc, trim(regexp_replace(lower(a), '[ \\t\\r\\n]+', ' ', 'g')) AS qa, trim(regexp_replace(lower(q), '[ \\t\\r\\n]+', ' ', 'g')) AS qc FROM c),
p AS (SELECT *, CASE WHEN a IS NOT NULL AND (qa = '' OR NOT contains(na, qa)) THEN 'answer_quote' WHEN qc = '' OR NOT contains(nc, qc) THEN 'context_quote' WHEN comparison IN ('match', 'mismatch') AND a IS NULL THEN 'both quotes' WHEN comparison = 'other' THEN 'comparison' END AS problem FROM z),
f AS (SELECT id, count(*) AS n, first(problem ORDER BY ord) FILTER (problem IS NOT NULL) AS problem, max(CASE WHEN comparison = 'mismatch' THEN 2 WHEN comparison = 'unverifiable' OR comparison = 'missing_in_answer' AND a IS NOT NULL AND field <> 'date' THEN 1 ELSE 0 END) AS s, bool_or(comparison = 'match') AS m, bool_or(comparison = 'missing_in_answer' AND field <> 'date') AS gone FROM p GROUP BY id)
SELECT t.id, CASE WHEN n IS NULL THEN 'needs_review' WHEN problem IS NOT NULL THEN 'format_error' WHEN s = 2 THEN 'fail' WHEN s = 1 OR NOT m THEN 'needs_review' ELSE 'pass' END AS status, NOT coalesce(gone, false) AS complete, coalesce(n, 0) AS n_checks, problem FROM t LEFT JOIN f USING (id)"""
)
def checked_citations(spark, d):
    """Checks whose quotes are taken from the texts themselves, some of them wrong."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 300).alias("answer"), F.col("text").alias("context"))
    k, at = F.col("id") % 9, lambda a, n: F.substring("context", a, n)
    kinds = F.when(k == 1, "mismatch").when(k == 2, "unverifiable").when(k.isin(3, 4), "missing_in_answer").when(k == 5, "other").otherwise("match")
    check = lambda o, field, what, a, q: F.struct(F.lit(o).alias("ord"), field.alias("field"), what.alias("comparison"), a.alias("answer_quote"), q.alias("context_quote"))
    first = check(1, F.lit("norm"), F.when(k == 8, "unverifiable").otherwise("match"), F.lower(F.replace(at(1, 25), F.lit(" "), F.lit("  "))), F.when(k == 7, F.concat(at(1, 10), F.lit(" qqq"))).otherwise(at(1, 25)))
    second = check(2, F.when(F.col("id") % 2 == 0, "date").otherwise("norm"), kinds, F.when(~k.isin(3, 6), at(5, 20)), at(5, 20))
    both = F.when(k.between(1, 6), F.array(first, second)).otherwise(F.array(first))
    checks = rows.filter("id % 11 <> 0").select("id", F.explode(both).alias("c")).select("id", "c.*")
    return citations.verdicts(rows, checks)


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def scoped_scan(spark, d):
    """A caller's filter with a key that is not allowed, made safe and pushed to the scan."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    asked = guards.lenient({"category": {"$in": ["src1", "src2"]}, "doc_type": "en", "$where": "1 = 1"})
    view = docs.withColumnsRenamed({"source": "category", "lang": "doc_type"})
    return view.filter(guards.predicate(guards.strict(asked), view.columns)).withColumnsRenamed({"category": "source", "doc_type": "lang"})


@query(
    f"""WITH {acts.WINDOWS}, {acts.PASSAGES}, r AS (SELECT p.*, w.parent_id, coalesce(w.text, p.text) AS t FROM pass p LEFT JOIN wins w USING (doc, chunk)),
g AS (SELECT query, doc, parent_id, t, CASE WHEN parent_id IS NULL THEN rank END AS own, min(rank) AS slot, list(chunk ORDER BY rank) AS cs FROM r GROUP BY ALL),
e AS (SELECT query, doc::VARCHAR || '#' || cs[k] AS id, min({{'s': slot, 'k': k}}) AS at_ FROM g, LATERAL (SELECT unnest(range(1, len(cs) + 1)) AS k) GROUP BY ALL)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY at_) AS position FROM e"""
)
def position_rank(spark, d):
    """Identities in the order in which a question meets them; a window counts as the children it took in."""
    shown = acts.parent_context(spark, d)
    children = F.coalesce("child_chunk_ids", F.array("chunk"))
    rows = shown.select("query", "doc", "rank", F.posexplode(children).alias("k", "child"))
    ids = rows.select("query", F.concat_ws("#", F.col("doc").cast("string"), F.col("child").cast("string")).alias("id"), F.struct("rank", "k").alias("at"))
    one = ids.groupBy("query", "id").agg(F.min("at").alias("at"))
    return one.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("at")).alias("position"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, sum(len(text) + 1) OVER w - 1 AS used, row_number() OVER w AS k FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE used <= 2500 OR k = 1")
def char_truncation(spark, d):
    """The first text stays in any case; each further one costs its separator too, and the first that does not fit ends the list."""
    rows = table(spark, d, "documents").select("source", "doc_id", (F.length("text") + 1).alias("cost"))
    return packing.long_budget_prefix(rows, "source", "doc_id", F.col("cost"), 2501, keep_first=True).select("source", "doc_id")
