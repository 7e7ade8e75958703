"""Queries of numbered tables: every order is a table of its customer, its line items the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import table_rows as tr
from lodestone.plans.catalog import query
from lodestone.session import table


def order_tables(spark, d) -> DataFrame:
    """doc, ord, ref, page, width, grid: some rows are numbered, some part of the row before, some plain; a table has three or four columns."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4).alias("page"), F.when(F.col("o_orderkey") % 5 == 0, 4).otherwise(3).alias("width"))
    n, name = F.col("l_linenumber"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    first = F.when(n % 4 == 1, F.concat(n.cast("string"), F.lit("."))).when(n % 4 == 2, F.concat((n - 1).cast("string"), F.lit(".1"))).when(n % 4 == 3, "").otherwise("Note")
    cells = F.array(first, F.when(n % 4 == 3, "").otherwise(name), F.concat(F.lit("price "), F.col("l_extendedprice").cast("long").cast("string")))
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.groupBy(F.col("l_orderkey").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", cells.alias("cells")))).alias("rs"))
    return orders.join(rows.select("ord", F.transform("rs", lambda r: r["cells"]).alias("grid")), "ord").withColumn("ref", F.concat(F.lit("#/tables/"), F.col("ord").cast("string")))


@query(
    """WITH t AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderkey % 4 AS page, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END AS width FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)),
s AS (SELECT *, CASE WHEN lag(width) OVER w = width AND page - lag(page) OVER w = 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY doc ORDER BY ord))
SELECT doc, ord, sum(new) OVER (PARTITION BY doc ORDER BY ord) AS grp FROM s"""
)
def page_continuations(spark, d):
    return tr.merged_tables(order_tables(spark, d)).select("doc", "ord", "grp")


@query()
def numbered_table_rows(spark, d):
    """The folded rows of merged tables; tests hold the fold against a plain loop."""
    return tr.table_units(order_tables(spark, d), budget=40, loose_least=8).select("doc", "grp", F.posexplode("units").alias("part", "u")).select("doc", "grp", "part", "u.row_id", "u.text")


#: A chunk for every order; every third also refers to the next table of its customer.
_CHUNKS = "SELECT o_custkey AS doc, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 AND lead(o_orderkey) OVER w IS NOT NULL THEN [o_orderkey, lead(o_orderkey) OVER w] ELSE [o_orderkey] END AS refs FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"


@query(
    f"""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderkey % 4 AS page, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END AS width FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)),
s AS (SELECT *, CASE WHEN lag(width) OVER w = width AND page - lag(page) OVER w = 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY doc ORDER BY ord)),
g AS (SELECT doc, ord, sum(new) OVER (PARTITION BY doc ORDER BY ord) AS grp FROM s),
num AS (SELECT DISTINCT doc, grp FROM g JOIN lineitem ON l_orderkey = ord WHERE l_linenumber % 4 IN (1, 2)),
c AS ({_CHUNKS}), m AS (SELECT c.doc, c.ord, num.grp FROM (SELECT doc, ord, unnest(refs) AS r FROM c) c LEFT JOIN g ON g.doc = c.doc AND g.ord = r LEFT JOIN num ON num.doc = g.doc AND num.grp = g.grp),
pure AS (SELECT doc, ord, min(grp) AS grp FROM m GROUP BY ALL HAVING count(*) = count(grp) AND min(grp) = max(grp))
SELECT doc, ord, CASE WHEN pure.ord IS NULL THEN 'kept' WHEN c.ord = min(pure.ord) OVER (PARTITION BY doc, grp) THEN 'replaced' ELSE 'dropped' END AS fate FROM c LEFT JOIN pure USING (doc, ord)"""
)
def table_chunk_replacement(spark, d):
    """What becomes of each chunk when chunks made of one numbered table give way to its rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ref = lambda k: F.concat(F.lit("#/tables/"), k.cast("string"))
    following = F.lead("o_orderkey").over(w)
    chunks = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc"),
        F.col("o_orderkey").alias("ord"),
        F.when((F.col("o_orderkey") % 3 == 0) & following.isNotNull(), F.array(ref(F.col("o_orderkey")), ref(following))).otherwise(F.array(ref(F.col("o_orderkey")))).alias("refs"),
        F.lit("whole table").alias("text"),
        F.col("o_orderpriority").alias("section"),
    )
    out = tr.replace_table_chunks(chunks, order_tables(spark, d))
    left = out.groupBy("doc", "ord").agg(F.max(F.col("text") != "whole table").alias("new"))
    fate = F.when(F.col("new").isNull(), "dropped").when(F.col("new"), "replaced").otherwise("kept")
    return chunks.select("doc", "ord").join(left, ["doc", "ord"], "left").select("doc", "ord", fate.alias("fate"))
