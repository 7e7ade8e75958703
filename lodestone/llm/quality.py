"""Quality rules by distribution divergence.

Each document's histogram over character classes, and over the common words of
its language, is compared with the language's reference by Jensen-Shannon
distance (base 2, so 0 to 1). A reference is the mean histogram of the
language's long-enough documents over the whole corpus; a language with too few
of them, or none given, falls back to the reference of all (every language, in
proportion to its documents). Documents shorter
than the guards are judged by the counting rules alone, as a short text's
histogram says little.

Counting rules: too few words, or more than half of the words inside 3-word
windows that repeat.

Null and empty texts have no words and fail the counting rule. Repeated rows
are judged each for itself, and so are ties. A long text is judged whole. Columns
that clash with outputs are replaced. An empty table gives an empty result. Common
words of a language without a list here are counted by the English one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import materialize
from lodestone.llm.text import BLANKS, indices, let, words

# Common words by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"),
}
# What makes up most of a text and is counted by lengths, and the classes of the rest (Java spelling).
COMMON_CHARS = r"[a-z\x20\x80-\x{10FFFF}]+"
CLASSES = {
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "stop": r"[^.,;:'\"?()-]+",
    "mark": r"[^#*$%&|<>!=+@\[\]{}\\^_`~/]+",
}
MARKS = r"[^#*$%&|<>]+"

MIN_WORDS = 50
#: Largest share of words, in hundredths, that may stand in repeated windows.
MAX_REPEATED = 50
#: Guards of the two distances and their thresholds.
GUARD_CHARS, GUARD_WORDS = 300, 80
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.28
#: Documents that a language needs for a reference of its own.
MIN_REFERENCE = 20


def _char_histogram(text: Column, word_chars: Column, residue: Column) -> Column:
    """Counts by class: those of CLASSES, code points beyond ASCII, white space, and all others (lower-case letters, in the main)."""
    n = F.length(text)
    wide = F.when(n == F.octet_length(text), F.lit(0)).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")))
    counts = F.array(*(F.length(F.regexp_replace(residue, outside, "")) for outside in CLASSES.values()), wide, n - word_chars)
    rest = lambda cs: n - F.aggregate(cs, F.lit(0), lambda a, c: a + c)
    return let(counts, lambda cs: F.transform(F.concat(cs, F.array(rest(cs))), lambda c: c.cast("double")))


def _word_histogram(ws: Column, lang: Column) -> Column:
    """Counts of the language's common words and, last, of all others; a language without a list takes the English one."""
    every = sorted({w for ws_ in COMMON.values() for w in ws_})
    bins = F.lit(None).cast("array<string>")
    for name, common in COMMON.items():
        bins = F.when(lang == name, F.array(*map(F.lit, common))).otherwise(bins)
    width = max(map(len, COMMON.values()))
    bins = F.coalesce(bins, F.array(*map(F.lit, COMMON["en"])))
    spelled = every + [w.capitalize() for w in every] + [w.upper() for w in every]
    hits = F.transform(F.filter(ws, lambda w: w.isin(spelled)), lambda w: F.lower(w))

    def count(x: Column) -> Column:
        counts = F.transform(x["b"], lambda b: F.size(F.filter(x["h"], lambda w: w == b)).cast("double"))
        others = lambda cs: F.array(F.size(ws) - F.aggregate(cs, F.lit(0.0), lambda a, c: a + c))
        return let(counts, lambda cs: F.concat(cs, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(cs)), others(cs)))

    return let(F.struct(bins.alias("b"), hits.alias("h")), count)


def _shares(counts: Column) -> Column:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return let(counts, lambda xs: let(F.struct(xs.alias("x"), total(xs).alias("t")), lambda y: F.when(y["t"] > 0, F.transform(y["x"], lambda x: x / y["t"]))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays; null if one is null."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    halves = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(halves, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _repeated(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Most texts hold no window twice, which a set of the windows' hashes tells.
    For the others windows are sorted by hash and place; equal neighbours
    repeat. Of each repeated window its words count once, also where windows
    overlap.
    """
    n = F.size(ws)
    windows = F.transform(F.arrays_zip(ws.alias("a"), F.slice(ws, F.lit(2), n - 1).alias("b"), F.slice(ws, F.lit(3), n - 2).alias("c")), lambda x: F.xxhash64(x))

    def places(x: Column) -> Column:
        same = lambda i, j: F.get(x, i)["h"] == F.get(x, j)["h"]
        twice = F.filter(indices(F.size(x)), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda i: F.get(x, i)["i"]))

    def cover(starts: Column) -> Column:
        gaps = F.transform(indices(F.size(starts)), lambda k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(hs: Column) -> Column:
        numbered = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(F.sort_array(numbered), places), cover))

    return F.when(n < 4, F.lit(0)).otherwise(let(F.slice(windows, F.lit(1), n - 2), count))


def features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts that the rules need, from one pass over the texts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the
    histograms ``__chars`` and ``__common`` (as shares) with ``__lang`` and
    ``__guarded``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col in docs.columns else F.lit("")
    ws = F.col("__words")
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("__words", words(text, BLANKS)).withColumn("__lang", lang).withColumn("__residue", F.regexp_replace(text, COMMON_CHARS, ""))
    out = out.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    out = out.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "n_symbols": F.length(F.regexp_replace("__residue", MARKS, "")).cast("long"),
            "n_dup_lines": F.when(F.contains(text, F.lit("\n")), dup).otherwise(0).cast("long"),
            "n_repeat_words": _repeated(ws).cast("long"),
            "__chars": _shares(_char_histogram(text, F.col("word_chars").cast("int"), F.col("__residue"))),
            "__common": _shares(_word_histogram(ws, F.col("__lang"))),
            "__guarded": (F.size(ws) < GUARD_WORDS) | (F.length(text) < GUARD_CHARS),
        }
    )
    return out.drop("__words", "__residue")


WIDTHS = {"__chars": len(CLASSES) + 3, "__common": max(map(len, COMMON.values())) + 1}


def _sums(found: DataFrame) -> DataFrame:
    """By language: documents that pass the guards and sums of their shares, from ``features``.

    Sums of whole millionths, so that the order in which partitions are added
    changes nothing.
    """
    total = lambda c, k: F.sum(F.round(F.get(F.col(c), F.lit(k)) * 1_000_000).cast("long"))
    parts = [total(c, k).alias(f"{c}{k}") for c, n in WIDTHS.items() for k in range(n)]
    return found.filter(~F.col("__guarded")).groupBy(F.col("__lang").alias("lang")).agg(F.count("*").alias("n"), *parts)


def references(sums: DataFrame) -> DataFrame:
    """Mean share histograms by language: lang, n, chars, common; from ``_sums``."""
    back = lambda c: _shares(F.array(*(F.col(f"{c}{k}").cast("double") for k in range(WIDTHS[c]))))
    return sums.select("lang", "n", back("__chars").alias("chars"), back("__common").alias("common"))


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    Texts are read once: what the rules need of them is written to the shared
    folder, and both the references and the verdicts come from there. The
    references are a row per language; the driver takes them if they are
    ``MAX_LANGS`` at most, otherwise they are joined by language, each language
    dealt to ``SALTS`` keys.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    found = features(docs, text_col, lang_col)
    found = materialize(found.select(*carry, *(c for c in found.columns if c.startswith("__") or c in OUTPUTS)), "features")
    sums = materialize(_sums(found), "sums")
    own = references(sums).filter(F.col("n") >= MIN_REFERENCE)
    rows = own.limit(MAX_LANGS + 1).collect()
    every = references(sums.agg(F.lit(None).alias("lang"), *(F.sum(c).alias(c) for c in sums.columns if c != "lang"))).first()

    literal = lambda xs: F.array(*(F.lit(float(x)) for x in xs))

    def pick(field: str) -> Column:
        if every["n"] is None:
            return F.lit(None).cast("array<double>")
        out = literal(every[field])
        if len(rows) > MAX_LANGS:
            return F.coalesce(F.col(f"__own.{field}"), out)
        for r in rows:
            out = F.when(F.col("__lang") == r["lang"], literal(r[field])).otherwise(out)
        return out

    if len(rows) > MAX_LANGS:
        found = found.withColumn("__salt", F.monotonically_increasing_id() % SALTS)
        salted = own.select(F.col("lang").alias("__lang"), F.struct("chars", "common").alias("__own"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("__salt"))
        found = found.join(salted, ["__lang", "__salt"], "left")
    out = found.withColumn("char_distance", distance(F.col("__chars"), pick("chars"))).withColumn("word_distance", distance(F.col("__common"), pick("common")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED))
    far = F.coalesce((F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("__guarded") | ~far)).select(*carry, *OUTPUTS)


MAX_LANGS, SALTS = 200, 32
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
