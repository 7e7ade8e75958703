"""What headings carry on: articles that open inside a text, and parts that go on in the next chunk.

Chunks are doc, ord (from 0, ascending), headings (array, outermost first) and
text. Carries run over a document's chunks as prefix scans in blocks, so no
document is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrays import appended, let
from lodestone.operators.scan import BLOCK, carry_last

# How articles and parts open (Java spelling), and how long a title may be.
ARTICLE_HEADING = r"(?U)^Статья\s+\d+(?:\.\d+)*\.\s+\S"
ARTICLE_BARE = r"(?U)^Статья\s+\d+(?:\.\d+)*\.$"
ARTICLE_NUMBER = r"(?U)Статья\s+(\d+(?:\.\d+)*)\."
PART = r"(?mU)^(\d+(?:\.\d+)*)\.[ \t]*\n?[ \t]*(?=[А-ЯЁ])"
PART_FIRST = r"(?U)^(\d+(?:\.\d+)*)\.[ \t]*\n?[ \t]*(?=[А-ЯЁ])"
PART_BARE = r"(?U)(?:^|\n)(\d+(?:\.\d+)*)\.\s*$"
TITLE_CHARS = 200


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_article_heading(text: Column) -> Column:
    return F.coalesce(F.rlike(_squeezed(text), F.lit(ARTICLE_HEADING)), F.lit(False))


def inline_title(line: Column) -> Column:
    """A line as a title: cut at the last space within its length if it is too long."""

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, TITLE_CHARS)
        whole_words = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
        return F.when(F.length(s) <= TITLE_CHARS, s).otherwise(F.concat(F.when(F.contains(head, F.lit(" ")), whole_words).otherwise(head), F.lit("…")))

    return let(_squeezed(line), cut)


def resolve_articles(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``headings`` with the article a chunk belongs to, and ``opens``: whether its first line is that article's.

    An article met inside a text goes on for the later chunks under the same
    headings, until the next one is met there; it takes the place of an article
    that ends the headings.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    opening = lambda line: is_article_heading(line) | F.rlike(F.trim(_squeezed(line)), F.lit(ARTICLE_BARE))
    met = let(F.filter(lines, opening), lambda xs: F.when(F.size(xs) > 0, inline_title(F.element_at(xs, -1))))
    first = F.get(lines, F.lit(0))
    marked = chunks.withColumns({"opens": is_article_heading(first), "__met": met, "__own": inline_title(first), "__key": F.col("headings")})
    carried = carry_last(marked, ["doc", "__key"], "ord", "__before", F.col("__met"), inclusive=False, block=block)
    current = F.when(F.col("opens"), F.col("__own")).otherwise(F.col("__before"))
    last = F.get("headings", F.size("headings") - 1)
    rest = F.when(is_article_heading(last), F.slice("headings", F.lit(1), F.greatest(F.size("headings") - 1, F.lit(0)))).otherwise(F.col("headings"))
    return carried.withColumn("headings", F.when(current.isNull(), F.col("headings")).otherwise(appended(rest, current))).drop("__met", "__own", "__key", "__before")


def annotate_parts(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds article, part, part_inherited and part_end from doc, ord, heading_path and text; all null where no article is known.

    The article is the last one the path names. In articles that have numbered
    parts at all, a chunk that does not open one is in the last part met before
    it in the same article.
    """
    numbers = F.regexp_extract_all(F.coalesce("heading_path", F.lit("")), F.lit(ARTICLE_NUMBER), F.lit(1))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    body = F.when(is_article_heading(F.get(lines, F.lit(0))), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")).otherwise(F.array_join(lines, "\n"))
    found = lambda b: F.concat(F.regexp_extract_all(b, F.lit(PART), F.lit(1)), F.filter(F.array(F.regexp_extract(b, PART_BARE, 1)), lambda n: n != ""))
    rows = chunks.withColumn("article", F.when(F.size(numbers) > 0, F.element_at(numbers, -1))).withColumn("__body", body)
    rows = rows.withColumns({"__marks": found(F.col("__body")), "__start": F.nullif(F.regexp_extract("__body", PART_FIRST, 1), F.lit(""))})
    rows = rows.withColumn("__last", F.when(F.size("__marks") > 0, F.element_at("__marks", -1)))
    rows = carry_last(rows, ["doc", "article"], "ord", "__before", F.col("__last"), inclusive=False, block=block)
    parted = rows.filter("article is not null and __last is not null").select(F.col("doc").alias("__doc"), F.col("article").alias("__article")).distinct()
    rows = rows.join(parted.withColumn("__parted", F.lit(True)), F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("article") == F.col("__article")), "left")
    part = F.when(F.col("__parted"), F.coalesce("__start", "__before"))
    out = rows.withColumn("part", part)
    some = F.col("part").isNotNull()
    return out.withColumns({"part_inherited": F.when(some, F.col("__start").isNull()), "part_end": F.when(some, F.coalesce("__last", "part"))}).select(*chunks.columns, "article", "part", "part_inherited", "part_end")
