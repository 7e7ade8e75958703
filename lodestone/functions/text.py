"""Column expressions over text: tokens, keys, scrubbing, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that try to change a prompt (Java spelling).
INJECTIONS = (
    r"(?i)ignore\s+(previous|above|all)\s+(instructions?|prompts?)",
    r"(?i)system\s*:\s*",
    r"(?i)you\s+are\s+now\s+",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)forget\s+(everything|all)",
)

# Fixed value: the mark by which an answer cites a passage.
FRAGMENT = r"(?iu)\[Фрагмент\s+(\d+):\s*([^,\]]+?)(?:,\s*п\.\s*([^\]]+?)|,\s*без\s+пункта)?\s*\]"

# Whole lines of page furniture, and codes of standards.
FURNITURE = r"(?iuU)(?:Скачано с.*|Премиальная версия.*|Страница\s+\d+(?:\s+(?:из|/)\s*\d+)?|https?://\S*|\d{2}\.\d{2}\.\d{4},?\s+\d{2}:\d{2})"
STANDARDS = r"\b((?:ISO|EN|IEC|ГОСТ|СП|СНиП)\s?[0-9][0-9.\-]*[0-9])"


def prefix_stems(text: Column, size: int = 5, least: int = 2) -> Column:
    """Lower-cased alphanumeric tokens of at least ``least`` characters, cut to ``size``; repeats stay."""
    head = f"{{{least},{size}}}" if least <= size else f"{{{size}}}(?=[а-яёa-z0-9]{{{least - size}}})"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([а-яёa-z0-9]{head})[а-яёa-z0-9]*+"), F.lit(1))


def word_set(text: Column, least: int = 4) -> Column:
    """Distinct tokens of at least ``least`` characters, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([а-яёa-z0-9]{{{least},}})"), F.lit(1))
    return F.sort_array(F.array_distinct(found))


def identity_key(source: Column, chunk: Column, page: Column, text: Column) -> Column:
    """``source#chunk``; without a chunk number, source, page and the text's first 80 characters."""
    return F.coalesce(F.concat(source, F.lit("#"), chunk.cast("string")), F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(page.cast("string"), F.lit("")), F.substring(text, 1, 80)))


def scrub(text: Column) -> Column:
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, pattern, "[FILTERED]")
    return text


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def strip_tags(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags go, five entities are resolved."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return squeeze(body)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def quote_holds(text: Column, quote: Column) -> Column:
    """The quote stands in the text, white space and case aside; an empty quote does not."""
    norm = lambda c: F.lower(squeeze(c))
    return (norm(quote) != "") & F.contains(norm(text), norm(quote))


def citations(answer: Column) -> Column:
    """Numbers of ``[cite: 1, 2]`` marks, in order, repeats kept."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[cite:\s*([0-9, ]+)\]"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"([0-9]+)"), F.lit(1))))
    return F.transform(numbers, lambda n: n.cast("int"))


def fragments(answer: Column) -> Column:
    """array<struct<n, doc, section>> of ``[Фрагмент N: document, п. X]`` marks; the section is empty where none is given."""
    parts = [F.regexp_extract_all(answer, F.lit(FRAGMENT), F.lit(k)) for k in (1, 2, 3)]
    zipped = F.arrays_zip(parts[0].alias("n"), parts[1].alias("doc"), parts[2].alias("section"))
    return F.transform(zipped, lambda x: F.struct(x["n"].try_cast("int").alias("n"), F.trim(x["doc"]).alias("doc"), F.trim(F.coalesce(x["section"], F.lit(""))).alias("section")))


def normalised(text: Column) -> Column:
    """Lower case, words only, single spaces: the key of texts that say the same."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^0-9a-zа-яё\s]+", ""), r"\s+", " "))


def without_noise(text: Column) -> Column:
    """Whole lines of page furniture go, dashes are made one, runs of spaces become one."""
    lines = F.filter(F.split(F.replace(text, F.lit("–"), F.lit("—")), r"\r\n|\n|\r"), lambda s: ~F.rlike(F.trim(s), F.lit("^" + FURNITURE + "$")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), " {2,}", " "))


def doc_identifiers(text: Column) -> Column:
    """Codes of standards, such as ``ISO 9001`` or ``EN 50-2018``, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(STANDARDS), F.lit(1))))


def public_id(raw: Column) -> Column:
    """``source::rest`` -> struct<source, rest>, parted at the last ``::``; without one the source is null."""
    at = F.length(F.regexp_extract(raw, r"(?s)^(.*)::", 1))
    return F.when(F.contains(raw, F.lit("::")), F.struct(F.substring(raw, F.lit(1), at).alias("source"), F.substring_index(raw, "::", -1).alias("rest"))).otherwise(F.struct(F.lit(None).cast("string").alias("source"), raw.alias("rest")))


def address(raw: Column) -> Column:
    """``table 1 item 18`` -> struct<tbl, item>; missing parts are null."""
    part = lambda p: F.nullif(F.regexp_extract(F.lower(raw), p, 1), F.lit(""))
    return F.struct(part(r"(?:table|табл\.?)\s*([0-9.]*[0-9])").alias("tbl"), part(r"(?:item|п\.?)\s*([0-9.]*[0-9])").alias("item"))
