"""Evaluation: ranking metrics, percentiles, matrices, merges of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, hit, rr, precision, recall over (query, doc, rank) and (query, doc).

    Precision divides by k even for short lists; a query without relevant
    documents has recall 0; the reciprocal rank looks at the whole list.
    """
    labels = relevant.groupBy("query").agg(F.count("*").alias("n_rel"))
    marked = ranked.join(relevant.withColumn("rel", F.lit(1)), ["query", "doc"], "left")
    within = (F.col("rank") <= k) & F.col("rel").isNotNull()
    per = marked.groupBy("query").agg(F.sum(within.cast("int")).alias("got"), F.min(F.when(F.col("rel").isNotNull(), F.col("rank"))).alias("first"))
    per = per.join(labels, "query", "left")
    return per.select(
        "query",
        (F.col("got") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)), 6).alias("rr"),
        F.round(F.col("got") / k, 6).alias("precision"),
        F.round(F.coalesce(F.try_divide(F.col("got"), F.col("n_rel")), F.lit(0.0)), 6).alias("recall"),
    )


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, ndcg with grades in ``grade``; 0 where the ideal is 0."""
    gain = lambda rank: F.col("grade") / F.log2(rank + 1)
    got = ranked.filter(F.col("rank") <= k).join(relevant, ["query", "doc"], "left").groupBy("query").agg(F.sum(F.coalesce(gain(F.col("rank")), F.lit(0.0))).alias("dcg"))
    ideal = relevant.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc"))).filter(F.col("r") <= k)
    ideal = ideal.groupBy("query").agg(F.sum(gain(F.col("r"))).alias("idcg"))
    return got.join(ideal, "query", "left").select("query", F.round(F.coalesce(F.try_divide(F.col("dcg"), F.col("idcg")), F.lit(0.0)), 6).alias("ndcg"))


def hit_curve(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """k, hit_rate for 1 .. k."""
    first = ranked.join(relevant, ["query", "doc"], "left_semi").groupBy("query").agg(F.min("rank").alias("first"))
    per = ranked.select("query").distinct().join(first, "query", "left")
    at = per.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return at.groupBy("k").agg(F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("hit_rate"))


def confusion(rows: DataFrame, guess: str, truth: str) -> DataFrame:
    """One row: tp, fp, fn, tn, skipped, accuracy (null without rows to compare)."""
    g, t = F.col(guess), F.col(truth)
    known = g.isNotNull() & t.isNotNull()
    n = lambda c: F.count_if(known & c)
    return rows.agg(
        n((g == 1) & (t == 1)).alias("tp"),
        n((g == 1) & (t == 0)).alias("fp"),
        n((g == 0) & (t == 1)).alias("fn"),
        n((g == 0) & (t == 0)).alias("tn"),
        F.count_if(~known).alias("skipped"),
        F.round(F.try_divide(n(g == t), F.count_if(known)), 6).alias("accuracy"),
    )


def label_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """item, status over two passes of (item): gold in both, else disputed."""
    a, b = first.select("item", F.lit(1).alias("a")), second.select("item", F.lit(1).alias("b"))
    both = a.join(b, "item", "full")
    return both.select("item", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "gold").otherwise("disputed").alias("status"))


def run_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, n over (query, hit) of two runs."""
    both = old.select("query", F.col("hit").alias("h0")).join(new.select("query", F.col("hit").alias("h1")), "query", "full")
    change = (
        F.when(F.col("h1").isNull(), "missing")
        .when(F.col("h0").isNull(), "new")
        .when(F.col("h0") > F.col("h1"), "regressed")
        .when(F.col("h0") < F.col("h1"), "recovered")
        .otherwise("same")
    )
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def flag_matrix(rows: DataFrame, flags: list[str]) -> DataFrame:
    """A row for each combination of flags, those without rows included, with n."""
    spark = rows.sparkSession
    cells = spark.range(1 << len(flags)).select(*(((F.col("id") / (1 << i)).cast("long") % 2 == 1).alias(f) for i, f in enumerate(flags)))
    return cells.join(rows.groupBy(*flags).agg(F.count("*").alias("n")), flags, "left").select(*flags, F.coalesce("n", F.lit(0)).alias("n"))


def threshold_grid(signals: DataFrame, scores: list[float], overlaps: list[float]) -> DataFrame:
    """score_at, overlap_at, accepted, good: what each profile accepts of (top_score, overlap, good); profiles are literals in each row."""
    grid = F.array(*(F.struct(F.lit(s).alias("score_at"), F.lit(o).alias("overlap_at")) for s in scores for o in overlaps))
    at = signals.withColumn("g", F.explode(grid)).select("top_score", "overlap", "good", "g.*")
    ok = (F.col("top_score") >= F.col("score_at")) & (F.col("overlap") >= F.col("overlap_at"))
    return at.groupBy("score_at", "overlap_at").agg(F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("good")).alias("good"))
