"""Glossary terms in texts, whatever their endings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.arrays import indices

# Words longer than this lose so many letters and may get so many others; what stands before and after the found terms.
LONG, CUT, ENDING = 4, 2, 3
# Fixed value: the end or the beginning of a word of ASCII letters, digits and underscores; Java's own one takes other letters in.
ASCII_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
OPENS, CLOSES = "\n\n[Глоссарий: ", "]"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """ord, term (lower case), official, from a YAML file ``terms: {short: {official: ...}}``; entries without an official term go, a missing file is an empty glossary."""
    import yaml

    lines = spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []
    terms = ((yaml.safe_load(bytes(lines[0]["content"])) or {}).get("terms") or {}) if lines else {}
    rows = [(n, k.lower(), v["official"]) for n, (k, v) in enumerate(terms.items()) if "official" in v]
    return spark.createDataFrame(rows, "ord int, term string, official string")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _stem(word: Column) -> Column:
    return F.when(F.length(word) > LONG, F.substring(word, F.lit(1), F.length(word) - CUT)).otherwise(word)


def term_pattern(term: Column, ascii: bool = False) -> Column:
    """A term as a pattern: whole words in order, long ones with another ending. With ``ascii`` only ASCII letters, digits and underscores are parts of words, as in RE2."""
    edge, letter, space, flags = (ASCII_EDGE, "[0-9A-Za-z_]", r"[\t\n\f\r ]+", "") if ascii else (r"\b", r"\w", r"\s+", "(?iuU)")
    # a look to one side is enough, and much faster, where the term itself has a letter on the other
    opens = lambda w: F.when(F.rlike(w, F.lit("^[0-9a-z_]")), "(?<![0-9A-Za-z_])").otherwise(edge) if ascii else F.lit(edge)
    closes = lambda w: F.when(F.rlike(w, F.lit("[0-9a-z_]$")), "(?![0-9A-Za-z_])").otherwise(edge) if ascii else F.lit(edge)
    word = lambda w: F.concat(opens(w), F.lit(r"\Q"), _stem(w), F.when(F.length(w) > LONG, F.concat(F.lit(rf"\E{letter}{{0,{ENDING}}}"), closes(_stem(w)))).otherwise(F.concat(F.lit(r"\E"), closes(w))))
    return F.concat(F.lit(flags), F.array_join(F.transform(F.filter(F.split(F.lower(term), r"\s+"), lambda w: w != ""), word), space))


def find_terms(texts: DataFrame, glossary: DataFrame, ascii: bool = False) -> DataFrame:
    """texts: id, text; glossary: ord, term, official -> id and the entries found in it; ``ascii`` as in ``term_pattern``.

    With ``ascii``, terms of one or two plain words are looked up by the words that stand in a text, or side by side in it,
    which needs no pattern. All others are looked up by their first words and then matched with their patterns.
    """
    words = F.filter(F.split(F.lower("term"), r"\s+"), lambda w: w != "")
    entries = glossary.withColumn("__ws", words).filter(F.size("__ws") > 0)
    plain = (F.size("__ws") <= 2) & F.forall("__ws", lambda w: F.rlike(w, F.lit("^[0-9a-z_]+$")))
    entries = entries.withColumn("__looked", F.when(F.lit(ascii) & plain, F.size("__ws")).otherwise(0))
    # the kinds that a glossary has, at most three
    kinds = sorted(r[0] for r in entries.select("__looked").distinct().collect())
    of = lambda kind: entries.filter(F.col("__looked") == kind)
    parts = [_in_pairs(texts, of(k), k) if k else _by_pattern(texts, of(0), ascii) for k in kinds or [0]]
    return reduce(DataFrame.unionByName, parts)


def _in_pairs(texts: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """``find_terms`` of plain terms of ``n`` words, 1 or 2; what no word has between them, but for white space, stands side by side."""
    # texts are dealt first, as a file of one row group is read by one task
    text = F.lower("text")
    dealt = texts.select("id", "text").repartition("id")
    if n == 1:
        rows = dealt.select("id", F.explode(F.split(text, r"\W+")).alias("t0"))
    else:
        # what white space parts, and of each the word at the end next to it
        ws = dealt.select("id", F.split(text, r"[\t\n\f\r ]+").alias("ws"))
        pairs = F.arrays_zip(F.col("ws").alias("t0"), F.slice("ws", F.lit(2), F.size("ws")).alias("t1"))
        rows = ws.select("id", F.explode(pairs).alias("p")).select("id", F.regexp_extract("p.t0", r"(\w+)\z", 1).alias("t0"), F.regexp_extract("p.t1", r"^(\w+)", 1).alias("t1"))
    # the first letters of a found word are those of the term's, as a stem has at least so many
    opens = LONG + 1 - CUT
    terms = entries.select("ord", "term", "official", *(F.get("__ws", F.lit(k)).alias(f"w{k}") for k in range(n)))
    terms = terms.select("*", *(F.substring(f"w{k}", 1, opens).alias(f"o{k}") for k in range(n)))
    test = F.lit(True)
    for k in range(n):
        t, w = F.col(f"t{k}"), F.col(f"w{k}")
        bent = F.startswith(t, _stem(w)) & (F.length(t) <= F.length(w) - CUT + ENDING)
        test = test & (F.substring(t, 1, opens) == F.col(f"o{k}")) & F.when(F.length(w) > LONG, bent).otherwise(t == w)
    return rows.join(terms, test).select("id", "ord", "term", "official").distinct()


def _by_pattern(texts: DataFrame, entries: DataFrame, ascii: bool) -> DataFrame:
    """``find_terms`` by patterns.

    A term's first word is looked up by what is left of it: each word of a text
    goes in whole and without its last letters, at most ENDING and CUT of them.
    Only pairs that meet there are matched with the term's pattern, so the work
    does not grow with texts times terms.
    """
    entries = entries.select("ord", "term", "official", _stem(F.get("__ws", F.lit(0))).alias("key"), term_pattern(F.col("term"), ascii).alias("pattern"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([0-9A-Za-z_]+)" if ascii else r"(?U)(\w+)"), F.lit(1)))
    # a term's first word may open with a sign; such terms are looked up by the letters in it
    entries = entries.withColumn("key", F.coalesce(F.nullif(F.regexp_extract("key", r"(?U)(\w+)\W*$", 1), F.lit("")), "key"))
    shorter = lambda w: F.transform(indices(F.least(F.lit(ENDING + 1), F.length(w))), lambda k: F.substring(w, F.lit(1), F.length(w) - k))
    keys = F.array_distinct(F.flatten(F.transform(found, shorter)))
    texts = texts.select("id", F.lower("text").alias("text")) if ascii else texts
    met = texts.select("id", "text", F.explode(keys).alias("key")).join(entries, "key").filter(F.rlike("text", F.col("pattern")))
    return met.select("id", "ord", "term", "official").distinct()


def expand(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """id, text: the official terms of all entries found are appended, in the glossary's order; other texts stay as they are."""
    entry = F.struct("ord", F.concat("term", F.lit(" → "), F.col("official")).alias("said"))
    per = find_terms(texts, glossary).groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    said = F.array_join(F.transform("es", lambda e: e["said"]), "; ")
    return texts.join(per, "id", "left").select("id", F.when(F.col("es").isNotNull(), F.concat("text", F.lit(OPENS), said, F.lit(CLOSES))).otherwise(F.col("text")).alias("text"))
