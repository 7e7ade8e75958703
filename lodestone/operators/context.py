"""The context of a question: what its passages refer to, in which order it is kept, what fits.

Passages are (query, ord from 1, source, chunk, text, score and, where known,
page, bbox and section): a question has a short list of them. The corpus is (source,
chunk, text and the same optional columns); only joins touch it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import appended, strings
from lodestone.functions.references import contains_unit, references
from lodestone.functions.text import scrub, token_estimate
from lodestone.operators.retrieval import top_k
from lodestone.operators.settle import settle

# How chunks name and open units, what a numbered list's element looks like (Java spelling).
CLAUSE_OPENS, CLAUSE_NAMED = r"(?mU)^\s*(\d+)\.(?=\s)", r"(?iuU)\bпункт\w*\s+(\d+)\b"
ARTICLE_NAMED, SUBPARA_OPENS = r"(?iuU)\bстать\w+\s+(\d+)\b", r"(?miuU)^\s*([а-яё])\)"
LIST_ELEMENT, LIST_START = r"(?iuU)^\s*(\d+)\.\s+[а-яё]\)", r"(?iuU)^(\d+)\.\s+[а-яё]\)"
# How much each way of expansion may add, and the score of what it adds.
FIRST_REFERRED, MOST_REFERRED, LEXICAL, MOST_LISTED, MOST_BESIDE, ADDED_SCORE = 5, 15, 30, 10, 10, 0.35
# Limits of the packed context and the least cost of a passage's header in tokens.
MOST_PASSAGES, TOKEN_BUDGET, HEADER_TOKENS, SECTION_CHARS = 30, 60_000, 48, 120
# The search in an anchor's section.
ANCHORS, SECTION_CHUNKS = 3, 50

OPTIONAL = {"page": "int", "bbox": "string", "section": "string"}


def _whole(rows: DataFrame) -> DataFrame:
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def unit_index(corpus: DataFrame) -> DataFrame:
    """source, kind, num, chunk, text, ...: the units that each chunk opens or names, a row each."""
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    of = lambda kind, nums: F.transform(nums, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("num")))
    units = F.concat(of("clause", F.concat(found(CLAUSE_OPENS), found(CLAUSE_NAMED))), of("article", found(ARTICLE_NAMED)), of("subpara", F.transform(found(SUBPARA_OPENS), F.lower)))
    return corpus.filter("text <> ''").select("source", "chunk", "text", "page", "bbox", "section", F.explode(F.array_distinct(units)).alias("u")).select("source", "u.kind", "u.num", "chunk", "text", "page", "bbox", "section")


def _first_of_each(pairs: DataFrame, most: int) -> DataFrame:
    """Of the chunks found for a passage one for each text, and the first ``most`` of them."""
    rest = [c for c in pairs.columns if c not in ("query", "ord", "at", "key")]
    one = pairs.withColumn("key", F.md5("text")).groupBy("query", "ord", "key").agg(F.min_by(F.struct("at", *rest), "at").alias("r"))
    return top_k(one.select("query", "ord", "key", "r.*"), ["query", "ord"], [F.asc("at")], most).drop("rank")


def expand_references(passages: DataFrame, corpus: DataFrame, lexical: DataFrame | None = None) -> DataFrame:
    """The passages and what belongs to them: query, ord, source, chunk, text, score, page, bbox, section, cross_ref.

    Four ways, each with its bound, add chunks of the passages' own sources whose
    text the question does not have yet: units that a passage refers to (by
    passage and in all), the best of a lexical list (query, rank, source, chunk,
    text), other elements of a numbered list, and chunks of the same page and
    box. The last stand right behind each passage they belong to, the others at
    the end. The ways take turns, passages and chunks in order; since what one takes is lost to the next, a question's
    candidates are folded in that order. Of each passage and way only as many are kept as could be
    taken if all others were already there, so lists stay short whatever a source's size.
    """
    passages, corpus = settle(_whole(passages), "passages"), _whole(corpus)
    widest = passages.groupBy("query").count().agg(F.max("count")).first()[0] or 0
    own = passages.select("query", "ord", "source", "score", "page", "bbox", "text").filter("source <> ''")
    corpus = settle(corpus.join(own.select("source").distinct(), "source", "left_semi"), "sources")  # three ways read it, and only in these sources
    body = [F.col(f"c.{x}").alias(x) for x in ("source", "chunk", "text", "page", "bbox", "section")]
    at = F.col("c.chunk").alias("at")

    asked = own.select("query", "ord", "source", references(F.col("text")).alias("rs"))
    asked = asked.select("query", "ord", "source", F.exists("rs", lambda r: r["kind"] == "clause").alias("clause"), F.explode("rs").alias("r")).filter("clause or r.kind <> 'subpara'")
    asked = asked.select("query", "ord", "source", "r.kind", F.lower("r.num").alias("num")).distinct()
    referred = asked.alias("a").join(unit_index(corpus).alias("c"), ["source", "kind", "num"])
    ways = [_first_of_each(referred.select("query", "ord", at, "source", *body[1:], F.lit(ADDED_SCORE).alias("score")), widest + FIRST_REFERRED + MOST_REFERRED).withColumn("way", F.lit(1))]
    room = widest + MOST_REFERRED + LEXICAL
    if lexical is not None:
        near = lexical.filter(F.col("rank") <= LEXICAL).join(own.select("query", "source").distinct(), ["query", "source"], "left_semi").filter("text <> ''")
        near = near.select("query", F.lit(0).alias("ord"), F.md5("text").alias("key"), F.col("rank").cast("long").alias("at"), "source", "chunk", "text", *(F.lit(None).cast(k).alias(x) for x, k in OPTIONAL.items()), F.lit(ADDED_SCORE).alias("score"))
        ways.append(near.withColumn("way", F.lit(2)))
    element = own.select("query", "ord", "source", F.regexp_extract("text", LIST_ELEMENT, 1).alias("num")).filter("num <> ''")
    elements = corpus.withColumn("num", F.regexp_extract("text", LIST_START, 1)).filter("num <> ''")
    listed = element.alias("a").join(elements.alias("c"), ["source", "num"])
    ways.append(_first_of_each(listed.select("query", "ord", at, "source", *body[1:], F.lit(ADDED_SCORE).alias("score")), room + MOST_LISTED).withColumn("way", F.lit(3)))
    boxed = own.filter("page is not null and bbox <> ''").select("query", "ord", "source", "page", "bbox", F.coalesce("score", F.lit(ADDED_SCORE)).alias("__score"))
    beside = boxed.alias("a").join(corpus.filter("text <> ''").alias("c"), ["source", "page", "bbox"])
    beside = beside.select("query", "ord", at, "source", F.col("c.chunk").alias("chunk"), F.col("c.text").alias("text"), "page", "bbox", F.col("c.section").alias("section"), F.col("__score").alias("score"))
    ways.append(_first_of_each(beside, room + MOST_LISTED + MOST_BESIDE).withColumn("way", F.lit(4)))

    columns = ["way", "ord", "at", "key", "source", "chunk", "text", "page", "bbox", "section", "score"]
    found = ways[0].select("query", *columns)
    for w in ways[1:]:
        found = found.unionByName(w.select("query", *columns))
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("cs"))
    lists = lists.join(passages.groupBy("query").agg(F.collect_set(F.md5("text")).alias("has")), "query")
    kind = lists.schema["cs"].dataType

    def take(acc: Column, c: Column) -> Column:
        way, same = c["way"], (c["way"] == 1) & (c["ord"] == acc["last"])
        n = lambda k: F.size(F.filter(acc["taken"], lambda t: t["way"] == k))
        of_passage = F.when(same, acc["of"]).otherwise(0)
        free = F.when(way == 1, (n(1) < MOST_REFERRED) & (of_passage < FIRST_REFERRED)).when(way == 3, n(3) < MOST_LISTED).when(way == 4, n(4) < MOST_BESIDE).otherwise(True)
        ok = free & ~F.array_contains(acc["seen"], c["key"])
        return F.struct(
            F.when(ok, appended(acc["seen"], c["key"])).otherwise(acc["seen"]).alias("seen"),
            F.when(ok, appended(acc["taken"], c)).otherwise(acc["taken"]).alias("taken"),
            F.when(way == 1, c["ord"]).otherwise(acc["last"]).alias("last"),
            (of_passage + F.when(ok & (way == 1), 1).otherwise(0)).alias("of"),
        )

    start = F.struct(F.col("has").alias("seen"), F.array().cast(kind).alias("taken"), F.lit(-1).alias("last"), F.lit(0).alias("of"))
    taken = settle(lists.select("query", F.posexplode(F.aggregate("cs", start, take, lambda acc: acc["taken"])).alias("n", "c")).select("query", "n", "c.*"), "taken")

    kept = passages.select("query", F.lit(0).alias("part"), "ord", F.lit(-1).alias("n"), "source", "chunk", "text", "score", "page", "bbox", "section", F.lit(False).alias("cross_ref"))
    rest = ["source", "chunk", "text", "score", "page", "bbox", "section"]
    tail = taken.filter("way < 4").select("query", F.lit(1).alias("part"), F.lit(0).alias("ord"), "n", *rest, F.lit(True).alias("cross_ref"))
    behind = taken.filter("way = 4").drop("ord").join(boxed.select("query", "ord", "source", "page", "bbox"), ["query", "source", "page", "bbox"])
    behind = behind.select("query", F.lit(0).alias("part"), "ord", "n", *rest, F.lit(True).alias("cross_ref"))
    every = kept.unionByName(tail).unionByName(behind)
    place = F.row_number().over(Window.partitionBy("query").orderBy("part", "ord", "n"))
    return every.withColumn("ord", place).drop("part", "n")


def closing_order(base: DataFrame, expanded: DataFrame, first: int = 5) -> DataFrame:
    """The base in its order, then what ``expanded`` adds: first, greedily, passages that close most open references of the base's first ones, then the rest in order.

    A reference of a source is closed by a passage of that source that holds the
    unit; a unit named by several sources is open until each has it. Of equally
    good passages the first goes first; when none closes anything, the order stays.
    """
    base, expanded = settle(_whole(base), "base"), settle(_whole(expanded), "expanded")
    has = base.select("query", "source", "text").distinct()
    tail = expanded.join(has, ["query", "source", "text"], "left_anti")
    marks = base.filter(F.col("ord") <= first).select("query", "source", F.explode(references(F.col("text"))).alias("r")).select("query", "source", "r.kind", "r.num").distinct()
    unit, marker = F.concat_ws("|", "kind", "num", "source"), F.concat_ws("|", "kind", "num")
    holds = contains_unit(F.col("kind"), F.col("num"), F.col("text"))
    closed = base.select("query", "source", "text").join(marks, ["query", "source"]).filter(holds).groupBy("query").agg(F.collect_set(unit).alias("closed"))
    asked = marks.groupBy("query").agg(F.array_sort(F.collect_set(F.struct(unit.alias("unit"), marker.alias("marker")))).alias("asked"))
    closes = tail.select("query", "ord", "source", "text").join(marks, ["query", "source"]).filter(holds).groupBy("query", "ord").agg(F.collect_set(unit).alias("closes"))
    work = closes.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "closes"))).alias("cs")).join(asked, "query").join(closed, "query", "left")

    def open_(done: Column) -> Column:
        return F.size(F.array_distinct(F.transform(F.filter("asked", lambda a: ~F.array_contains(done, a["unit"])), lambda a: a["marker"])))

    def pick(acc: Column, _: Column) -> Column:
        left = F.filter("cs", lambda c: ~F.array_contains(acc["order"], c["ord"]))
        best = F.array_min(F.transform(left, lambda c: F.struct(open_(F.concat(acc["done"], c["closes"])).alias("open"), c["ord"].alias("ord"), c["closes"].alias("closes"))))
        better = F.coalesce(best["open"] < open_(acc["done"]), F.lit(False))
        return F.struct(F.when(better, appended(acc["order"], best["ord"])).otherwise(acc["order"]).alias("order"), F.when(better, F.concat(acc["done"], best["closes"])).otherwise(acc["done"]).alias("done"))

    start = F.struct(F.array().cast("array<int>").alias("order"), F.coalesce("closed", strings()).alias("done"))
    chosen = work.select("query", F.posexplode(F.aggregate("asked", start, pick, lambda acc: acc["order"])).alias("__n", "ord"))
    columns = ["query", "source", "chunk", "text", "score", "page", "bbox", "section"]
    late = tail.join(chosen, ["query", "ord"], "left").select(*columns, F.when(F.col("__n").isNotNull(), 1).otherwise(2).alias("part"), F.coalesce("__n", "ord").alias("at"))
    every = base.select(*columns, F.lit(0).alias("part"), F.col("ord").alias("at")).unionByName(late)
    return every.select(*columns, F.row_number().over(Window.partitionBy("query").orderBy("part", "at")).alias("ord"))


def header(source: Column, section: Column, score: Column) -> Column:
    """The line above a passage, as it is counted."""
    level = F.when(score >= 0.6, "HIGH").when(score >= 0.4, "MED").otherwise("LOW")
    name = F.trim(F.replace(F.get(F.split(F.coalesce(source.cast("string"), F.lit("")), " - ", -1), F.lit(0)), F.lit(".pdf"), F.lit("")))
    label = F.trim(F.coalesce(section, F.lit("")))
    short = F.when(F.length(label) > SECTION_CHARS, F.concat(F.substring(label, 1, SECTION_CHARS), F.lit("…"))).otherwise(label)
    fields = F.concat_ws("; ", F.concat(F.lit("Источник: "), F.when(name == "", "Unknown source").otherwise(name)), F.when(short != "", F.concat(F.lit("Раздел: "), short)))
    return F.concat(F.lit("[1] ("), F.coalesce(level, F.lit("LOW")), F.lit(") ["), fields, F.lit("]"))


@dataclass(frozen=True)
class Limits:
    passages: int = MOST_PASSAGES
    tokens: int = TOKEN_BUDGET

    def __post_init__(self) -> None:
        if self.passages <= 0 or self.tokens <= 0:
            raise ValueError("limits are positive")


def pack_context(base: DataFrame, expanded: DataFrame | None = None, limits: Limits = Limits(), replace=None) -> tuple[DataFrame, DataFrame]:
    """What a question's context holds (query, ord, source, chunk, text, score, cost) and a report (query, status, kept, dropped).

    The base's passages, then what expansion added, in ``closing_order``;
    ``replace``, if given, puts windows in place of chunks (a function from
    query, ord, source, chunk, text, score to the same); texts are scrubbed; then the passage limit cuts, and the token budget stops at the first
    passage that does not fit, even if it is the first. ``expanded`` None means
    that expansion failed: the base is packed and the status is degraded.
    """
    base = _whole(base)
    rows = base if expanded is None else closing_order(base, expanded)
    rows = rows.select("query", "ord", "source", "chunk", "text", "score", "section")
    if replace is not None:
        rows = _whole(replace(rows))
    text = scrub(F.coalesce(F.col("text"), F.lit("")))
    cost = token_estimate(text) + F.greatest(F.lit(HEADER_TOKENS), token_estimate(header(F.col("source"), F.col("section"), F.col("score"))) + 1)
    clean = settle(rows.withColumn("text", text).withColumn("cost", cost), "clean")
    spent = F.sum("cost").over(Window.partitionBy("query").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    kept = clean.filter(F.col("ord") <= limits.passages).withColumn("__spent", spent).filter(F.col("__spent") <= limits.tokens)
    kept = kept.select("query", "ord", "source", "chunk", "text", "score", "cost")
    counts = clean.groupBy("query").agg(F.count("*").alias("n")).join(kept.groupBy("query").agg(F.count("*").alias("kept")), "query", "left")
    report = counts.select("query", F.lit("degraded" if expanded is None else "ok").alias("status"), F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))
    return kept, report


def fetch_sections(passages: DataFrame, corpus: DataFrame, anchors: int = ANCHORS, most: int = SECTION_CHUNKS) -> DataFrame:
    """The passages, then chunks of the sections of the first ``anchors``, at most ``most`` of each section, without texts that are there already.

    Sections are told apart by name and source and searched once, in the order of
    the anchors. Only chunks of sections that some question asks for are ranked.
    """
    passages, corpus = settle(_whole(passages), "passages"), _whole(corpus)
    named = passages.filter(F.col("ord") <= anchors).select("query", "ord", "source", F.trim("section").alias("section")).filter("section <> '' and source <> ''")
    named = named.groupBy("query", "source", "section").agg(F.min("ord").alias("anchor"))
    inside = corpus.withColumn("section", F.trim("section")).join(named.select("source", "section").distinct(), ["source", "section"], "left_semi")
    inside = top_k(inside, ["source", "section"], [F.asc("chunk")], most).drop("rank")
    found = named.join(inside, ["source", "section"]).withColumn("key", F.md5("text"))
    found = found.join(passages.select("query", F.md5("text").alias("key")).distinct(), ["query", "key"], "left_anti")
    place = F.struct("anchor", "chunk")
    one = found.groupBy("query", "key").agg(F.min_by(F.struct("source", "chunk", "text", "page", "bbox", "section", place.alias("place")), place).alias("r"))
    new = one.select("query", "r.*").withColumns({"part": F.lit(1), "score": F.lit(None).cast("double")})
    columns = ["query", "source", "chunk", "text", "score", "page", "bbox", "section"]
    old = passages.select(*columns, F.lit(0).alias("part"), F.struct(F.col("ord").alias("anchor"), F.lit(0).cast(dict(corpus.dtypes)["chunk"]).alias("chunk")).alias("place"))
    every = old.unionByName(new.select(*columns, "part", "place"))
    return every.select(*columns, (F.col("part") == 1).alias("fetched"), F.row_number().over(Window.partitionBy("query").orderBy("part", "place")).alias("ord"))
