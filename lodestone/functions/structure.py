"""The structure of regulations, row by row: paragraphs to units, units to chunks.

A document is one row with an array of paragraphs; everything here is an
expression over that row, so nothing is exchanged and a long document is as
local as a short one. Explode units or chunks afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.arrays import appended, indices, let, strings

# How paragraphs of regulations open units, parts and lists, and where sentences end (Java spelling).
ARTICLE = r"(?U)^Статья\s+(\d+(?:\.\d+)*(?:-\d+)?)\.\s*(.*)$"
ITEM = r"(?U)^(\d+(?:\(\d+\))?(?:\.\d+)*)\\?\.\s+\S"
SUBITEM = r"(?U)^(?:[а-яё]|\d+)\)\s"
HEADING = r"(?U)^(?:Раздел|РАЗДЕЛ|Глава|ГЛАВА|[IVXLC]+\.)\s+\S.{0,150}$"
SENTENCE_END = r"(?U)(?<=[.;:!?])\s+(?=[А-ЯЁ«\"(0-9])"
BARE_NUMBER = r"\d+(?:\(\d+\))?(?:\.\d+)*\."
PART_ONE, PART_MANY, ARTICLE_NAME, ITEM_NAME, CRUMB = "часть ", "части ", "Статья ", "п. ", " › "
#: The least room for the sentences of a paragraph that is cut beside a repeated introduction.
LEAST_ROOM = 200


def sentences(text: Column) -> Column:
    """The sentences of a text with single spaces; a bare number ("44.") stays with what follows it."""
    squeezed = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    # no newline is left in the text, so it can stand for the cuts
    marked = F.regexp_replace(squeezed, SENTENCE_END, "\n")
    return F.filter(F.split(F.regexp_replace(marked, rf"(^|\n)({BARE_NUMBER})\n", "$1$2 "), "\n", -1), lambda s: s != "")


def split_sentences(text: Column, limit: Column) -> Column:
    """Sentences packed to pieces of at most ``limit`` characters; a longer sentence is a piece of its own."""

    def add(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(s) > limit)
        alone = full | (acc["cur"] == "")
        return F.struct(F.when(full, appended(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(alone, s).otherwise(F.concat(acc["cur"], F.lit(" "), s)).alias("cur"))

    start = F.struct(strings().alias("done"), F.lit("").alias("cur"))
    return F.aggregate(sentences(text), start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(appended(acc["done"], acc["cur"])))


def pack(paragraphs: Column, limit: int, intro: Column | None = None) -> Column:
    """Paragraphs joined to bodies of at most ``limit`` characters; a paragraph that is too long is cut at sentences. ``intro``, where not null, opens every body."""
    intro = F.lit(None).cast("string") if intro is None else intro
    base = F.coalesce(F.length(intro), F.lit(0))
    fits = lambda p: F.length(p) + base <= limit
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(fits(p), F.array(p)).otherwise(split_sentences(p, F.greatest(F.lit(limit) - base, F.lit(LEAST_ROOM))))))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["n"] > 0) & (acc["size"] + 1 + F.length(s) > limit)
        opens = full | (acc["n"] == 0)
        return F.struct(
            F.when(full, appended(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(opens, F.concat_ws("\n", intro, s)).otherwise(F.concat(acc["cur"], F.lit("\n"), s)).alias("cur"),
            F.when(opens, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            (F.when(opens, base).otherwise(acc["size"]) + 1 + F.length(s)).alias("size"),
        )

    start = F.struct(strings().alias("done"), F.coalesce(intro, F.lit("")).alias("cur"), F.lit(0).alias("n"), base.alias("size"))
    return F.aggregate(pieces, start, add, lambda acc: F.when((acc["n"] > 0) | (F.size(acc["done"]) == 0), appended(acc["done"], acc["cur"])).otherwise(acc["done"]))


def parse_units(paragraphs: Column) -> Column:
    """array<struct<kind, number, title, heading, paragraphs>>: articles where a document has two or more, top items elsewhere; what stands before is the preamble.

    A heading belongs to the unit before it and names those after it.
    """
    head = lambda p: F.rlike(p, F.lit(HEADING)) & ~F.rlike(p, F.lit(ITEM))
    seen = lambda p: F.struct(p.alias("p"), head(p).alias("head"), F.rlike(p, F.lit(ARTICLE)).alias("article"), F.rlike(p, F.lit(ITEM)).alias("item"))

    def marked(xs: Column) -> Column:
        by_article = F.size(F.filter(xs, lambda x: x["article"])) >= 2
        opens = lambda x: ~x["head"] & F.when(by_article, x["article"]).otherwise(x["item"])
        at = lambda test: F.filter(indices(F.size(xs)), lambda i: test(F.get(xs, i)))
        return F.struct(xs.alias("xs"), by_article.alias("by_article"), at(opens).alias("opens"), at(lambda x: x["head"]).alias("heads"))

    def units(y: Column) -> Column:
        edges = F.filter(F.array_distinct(F.concat(F.array(F.lit(0)), y["opens"])), lambda e: e < F.size(y["xs"]))

        def unit(e: Column, k: Column) -> Column:
            end = F.coalesce(F.get(edges, k + 1), F.size(y["xs"]))
            first, plain = F.get(y["xs"], e)["p"], ~F.array_contains(y["opens"], e)
            heading = F.get(y["xs"], F.array_max(F.filter(y["heads"], lambda h: h < e)))["p"]
            return F.struct(
                F.when(plain, "preamble").when(y["by_article"], "article").otherwise("item").alias("kind"),
                F.when(plain, "").when(y["by_article"], F.regexp_extract(first, ARTICLE, 1)).otherwise(F.regexp_extract(first, ITEM, 1)).alias("number"),
                F.when(plain | ~y["by_article"], "").otherwise(F.regexp_extract(first, ARTICLE, 2)).alias("title"),
                F.when(plain, "").otherwise(F.coalesce(F.substring(heading, 1, 100), F.lit(""))).alias("heading"),
                F.transform(F.slice(y["xs"], e + 1, end - e), lambda x: x["p"]).alias("paragraphs"),
            )

        return F.transform(edges, unit)

    return let(let(F.transform(paragraphs, seen), marked), units)


def _label(nums: Column) -> Column:
    return let(F.filter(nums, lambda n: n != ""), lambda ns: F.when(F.size(ns) == 0, "").when(F.size(ns) == 1, F.concat(F.lit(PART_ONE), F.get(ns, F.lit(0)))).otherwise(F.concat(F.lit(PART_MANY), F.get(ns, F.lit(0)), F.lit("–"), F.element_at(ns, -1))))


def _parts(unit: Column, content: Column) -> Column:
    """array<struct<num, lines>>: an article's content from each numbered paragraph on; an item is one part."""

    def cut(xs: Column) -> Column:
        edges = F.filter(indices(F.size(xs)), lambda i: (i == 0) | F.rlike(F.get(xs, i), F.lit(ITEM)))
        part = lambda e, k: F.struct(F.regexp_extract(F.get(xs, e), ITEM, 1).alias("num"), F.slice(xs, e + 1, F.coalesce(F.get(edges, k + 1), F.size(xs)) - e).alias("lines"))
        return let(edges, lambda es: F.transform(es, part))

    return F.when(unit["kind"] == "article", let(content, cut)).otherwise(F.array(F.struct(unit["number"].alias("num"), content.alias("lines"))))


def chunk_unit(unit: Column, limit: int) -> Column:
    """array<struct<label, body>> of an article or item: whole if it fits, else its parts packed to the limit.

    A part that is too long is cut by itself; if it is a list, its first line is repeated in each body.
    """
    paragraphs = unit["paragraphs"]
    headed = (unit["kind"] == "article") & F.rlike(F.get(paragraphs, F.lit(0)), F.lit(ARTICLE))
    content = F.when(headed, F.slice(paragraphs, F.lit(2), F.greatest(F.size(paragraphs) - 1, F.lit(0)))).otherwise(paragraphs)
    piece = lambda label, body: F.struct(label.alias("label"), body.alias("body"))

    def worked(part: Column) -> Column:
        lines, text = part["lines"], F.array_join(part["lines"], "\n")
        listed = (F.size(lines) > 1) & F.rlike(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), F.lit(SUBITEM))
        intro = F.when(listed, F.get(lines, F.lit(0)))
        rest = F.when(listed, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        label = F.when((unit["kind"] == "article") & (part["num"] != ""), F.concat(F.lit(PART_ONE), part["num"])).otherwise("")
        own = F.when(F.length(text) > limit, F.transform(pack(rest, limit, intro), lambda b: piece(label, b)))
        return F.struct(part["num"].alias("num"), text.alias("text"), own.alias("own"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["done"]).otherwise(appended(acc["done"], piece(_label(acc["nums"]), acc["buf"])))

    def add(acc: Column, part: Column) -> Column:
        long = part["own"].isNotNull()
        full = (acc["buf"] != "") & (F.length(acc["buf"]) + 1 + F.length(part["text"]) > limit)
        alone = full | (acc["buf"] == "")
        return F.struct(
            F.when(long, F.concat(flushed(acc), part["own"])).when(full, flushed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(long, "").when(alone, part["text"]).otherwise(F.concat(acc["buf"], F.lit("\n"), part["text"])).alias("buf"),
            F.when(long, strings()).when(alone, F.array(part["num"])).otherwise(appended(acc["nums"], part["num"])).alias("nums"),
        )

    def split(xs: Column) -> Column:
        whole = F.array_join(xs, "\n")
        start = F.struct(F.array().cast("array<struct<label: string, body: string>>").alias("done"), F.lit("").alias("buf"), strings().alias("nums"))
        folded = F.aggregate(F.transform(_parts(unit, xs), worked), start, add, flushed)
        alone = lambda body: F.array(piece(F.lit(""), body))
        return F.when(F.size(xs) == 0, alone(F.get(paragraphs, F.lit(0)))).when(F.length(whole) <= limit, alone(whole)).otherwise(folded)

    return let(content, split)


def chunk_structural(paragraphs: Column, doc: Column, limit: int) -> Column:
    """array<struct<prefix, body>>: chunks that follow units and their parts, each with the path of names that leads to it."""

    def of_unit(unit: Column) -> Column:
        name = F.when(unit["kind"] == "article", F.trim(F.concat(F.lit(ARTICLE_NAME), unit["number"], F.lit(". "), unit["title"]))).when(unit["kind"] == "item", F.concat(F.lit(ITEM_NAME), unit["number"]))
        path = lambda part: F.concat_ws(CRUMB, doc, F.nullif(unit["heading"], F.lit("")), name, F.nullif(part, F.lit("")))
        named = F.transform(chunk_unit(unit, limit), lambda c: F.struct(path(c["label"]).alias("prefix"), c["body"].alias("body")))
        return F.when(unit["kind"] == "preamble", F.transform(pack(unit["paragraphs"], limit), lambda b: F.struct(doc.alias("prefix"), b.alias("body")))).otherwise(named)

    return F.flatten(F.transform(parse_units(paragraphs), of_unit))


def chunk_paragraphs(paragraphs: Column, least: int = 200, limit: int = 3000) -> Column:
    """Neighbouring paragraphs joined until ``least`` characters are reached; what is longer than ``limit`` is cut at sentences."""

    def add(acc: Column, p: Column) -> Column:
        cur = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n"), p))
        cut = F.when(F.length(cur) > limit, split_sentences(cur, F.lit(limit))).otherwise(F.array(cur))
        enough = F.length(cur) >= least
        return F.struct(F.when(enough, F.concat(acc["done"], cut)).otherwise(acc["done"]).alias("done"), F.when(enough, "").otherwise(cur).alias("cur"))

    start = F.struct(strings().alias("done"), F.lit("").alias("cur"))
    return F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(appended(acc["done"], acc["cur"])))


def grown_window(paragraphs: Column, words_of: Column, target: Column, cap: int = 3000) -> Column:
    """The window of a unit around the paragraph that shares most words with ``target``, grown by turns to the left and right while it fits ``cap``.

    ``words_of``: each paragraph's word set. A unit that fits stays whole; of a
    paragraph beyond the cap the piece with most shared words is taken.
    """
    from lodestone.functions.text import word_set

    whole = F.array_join(paragraphs, "\n")
    shared = lambda ws: F.size(F.array_intersect(ws, target))
    first_best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int") - 1

    def grow(first: Column) -> Column:
        length = lambda i: F.length(F.get(paragraphs, i)) + 1

        def turn(acc: Column, _: Column) -> Column:
            left = (acc["lo"] > 0) & (acc["size"] + length(acc["lo"] - 1) <= cap)
            lo, size = F.when(left, acc["lo"] - 1).otherwise(acc["lo"]), F.when(left, acc["size"] + length(acc["lo"] - 1)).otherwise(acc["size"])
            right = (acc["hi"] < F.size(paragraphs)) & (size + length(acc["hi"]) <= cap)
            return F.struct(lo.alias("lo"), F.when(right, acc["hi"] + 1).otherwise(acc["hi"]).alias("hi"), F.when(right, size + length(acc["hi"])).otherwise(size).alias("size"))

        start = F.struct(first.alias("lo"), (first + 1).alias("hi"), F.length(F.get(paragraphs, first)).alias("size"))
        grown = F.aggregate(indices(F.size(paragraphs)), start, turn)
        return let(grown, lambda g: F.array_join(F.slice(paragraphs, g["lo"] + 1, g["hi"] - g["lo"]), "\n"))

    def fragment(p: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(p), F.lit(cap)), lambda at: F.substring(p, at, F.lit(cap)))
        return let(pieces, lambda xs: F.get(xs, first_best(F.transform(xs, lambda x: shared(word_set(x))))))

    best = let(F.transform(words_of, shared), first_best)
    chosen = let(best, lambda i: F.when(F.length(F.get(paragraphs, i)) > cap, fragment(F.get(paragraphs, i))).otherwise(grow(i)))
    return F.when(F.length(whole) <= cap, whole).otherwise(chosen)
