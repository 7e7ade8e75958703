"""References between the clauses and articles of regulations, and what a question asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How texts name clauses, articles and subparagraphs, and the words that point to another act (Java spelling).
REFERENCES = (
    ("clause", r"(?iuU)(?:пункт\w*|пп\.?)\s+(\d+)"),
    ("article", r"(?iuU)стать\w+\s+(\d+)"),
    ("subpara", r"(?iuU)(?:подпункт\w*|пп\.?)\s+[«\"]([а-яё])[»\"]"),
)
OTHER_ACT = r"(?iuU)\b(?:(настоящ\w*)\s+)?(?:кодекс\w*|закон(?:а|у|ом|е|ы|ов|ам|ами)?|постановлени\w*|приказ\w*)\b"
TAIL = r"[^.;:()]{0,80}"
TAIL_WORDS = 6

# What stands before and after a unit's number where its text begins; an article needs both (Java spelling).
HEADINGS = {
    "clause": ((r"(?m)^\s*", r"\.(?=\s)"),),
    "article": ((r"(?miuU)^\s*(?:стать\w+\s+)?", r"[.\s]"), (r"(?iuU)стать\w+\s+", r"\b")),
    "subpara": ((r"(?miuU)^\s*(?:\d+\.\s+)?", r"\)"),),
}
# Questions that ask for a complete list (Java spelling).
ENUMERATION = (
    r"\bкто\s+проходит\b",
    r"\bкто\s+обязан\b",
    r"\bкакие\s+категори[яи]\b",
    r"\bв\s+каких\s+случаях\b",
    r"\bкогда\s+не\s+требуется\b",
    r"\bкому\s+не\s+требуется\b",
    r"\bкто\s+освобождается\b",
    r"\bперечислите\b",
    r"\bкакие\s+работники\b",
    r"\bкаким\s+работникам\b",
)


def wants_all(question: Column) -> Column:
    """Whether a question asks for a complete list; null does not."""
    return F.coalesce(F.rlike(F.lower(question), F.lit("(?uU)" + "|".join(ENUMERATION))), F.lit(False))


def references(text: Column) -> Column:
    """Distinct array<struct<kind, num>> of what a text refers to inside its own act, by kind, then first place.

    A number whose next six words name another act, up to a stop, is left out,
    unless the act is called the present one.
    """
    text = F.coalesce(text, F.lit(""))
    found = []
    for kind, pattern in REFERENCES:
        marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if kind == "subpara":
            found.append(F.transform(marks, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("num"))))  # noqa: B023
            continue
        # what follows the k-th mark stands behind the k-th cut of the text
        behind = F.split(text, pattern, -1)

        def outside(k: Column, behind: Column = behind) -> Column:
            tail = F.regexp_extract(F.get(behind, k + 1), "^" + TAIL, 0)
            near = F.array_join(F.slice(F.filter(F.split(tail, r"\s+"), lambda w: w != ""), 1, TAIL_WORDS), " ")
            return F.rlike(near, F.lit(OTHER_ACT)) & (F.regexp_extract(near, OTHER_ACT, 1) == "")

        pairs = F.transform(marks, lambda n, k: F.struct(F.lit(kind).alias("kind"), n.alias("num"), outside(k).alias("out")))  # noqa: B023
        found.append(F.transform(F.filter(pairs, lambda x: ~x["out"]), lambda x: F.struct(x["kind"].alias("kind"), x["num"].alias("num"))))
    return F.array_distinct(F.concat(*found))


def contains_unit(kind: Column, num: Column, text: Column) -> Column:
    """Whether a text holds the unit itself, by its heading; a text that only names it does not."""
    heads = lambda name: [F.rlike(text, F.concat(F.lit(before), num, F.lit(after))) for before, after in HEADINGS[name]]
    (clause,), (begins, named), (subpara,) = heads("clause"), heads("article"), heads("subpara")
    article = begins & named
    return F.coalesce(F.when(kind == "clause", clause).when(kind == "article", article).when(kind == "subpara", subpara), F.lit(False))
