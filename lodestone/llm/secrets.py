"""Secret scan by a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: what every
match must hold. The index lists, for each of the queries' trigrams, the texts
that hold it: posting lists of text hashes, parted into buckets of about
``BUCKET`` texts so that no list grows with the corpus. In each bucket a rule's
query is answered from the lists alone, an AND by intersecting and an OR by
uniting them. The answers, a set of rules for each candidate text, are joined
with the documents, and only those rules' regexes are run there. A rule without
mandatory trigrams scans every document in full.

Spans are counted in code points, end exclusive. Null and empty texts have no
spans. Repeated rows are scanned each for itself and share one posting. A long
text is one posting and one row as any other. Extra columns pass through; one
named ``found`` is replaced. An empty table gives an empty result. Ties, spans of
several rules that start together, stand in the order of the rules.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import materialize
from lodestone.llm.text import ascii_lower, indices, let, prefix_sums

ALL = ("all",)


@dataclass(frozen=True)
class Rule:
    """``least``: code points that group ``group`` of a match needs; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The patterns of the scan; base rules first.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{2,20}://[^\s/:@]*+:[^\s/:@]{3,}+@"),
)


# ---- regex -> Boolean query; a query is ALL, ("tri", t), ("and", qs) or ("or", qs)


def _and(qs: list) -> tuple:
    flat = sorted({q for x in qs for q in (x[1] if x[0] == "and" else (x,)) if q != ALL}, key=repr)
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(qs: list) -> tuple:
    if not qs or ALL in qs:
        return ALL
    flat = sorted({q for x in qs for q in (x[1] if x[0] == "or" else (x,))}, key=repr)
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of_strings(strings: set[str]) -> tuple:
    """One of these strings stands in every match."""
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings])


LIMIT = 64


def _walk(items) -> tuple[set[str] | None, tuple]:
    """(all strings that the sequence can match, or None if too many; the query that every match fulfils)."""
    run: set[str] = {""}
    queries, exact = [], True

    def flush() -> None:
        nonlocal run
        queries.append(_of_strings(run))
        run = {""}

    for op, arg in items:
        strings, query = _node(op, arg)
        queries.append(query)
        if strings is None:
            flush()
            exact = False
        elif len(run) * len(strings) > LIMIT:
            flush()
            exact = False
            run = strings if len(strings) <= LIMIT else {""}
        else:
            run = {a + b for a in run for b in strings}
    if exact:
        return run, _and(queries)
    flush()
    return None, _and(queries)


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}, ALL
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        union = set().union(*(s for s, _ in parts if s is not None))
        if all(s is not None for s, _ in parts) and len(union) <= LIMIT:
            return union, ALL
        return None, _or([q if s is None else _and([q, _of_strings(s)]) for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _walk(inner)
        if least == 0:
            return ({"", *strings}, ALL) if most == 1 and strings is not None else (None, ALL)
        return None, query if strings is None else _and([query, _of_strings(strings)])
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a regex, over lower-cased text."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else _and([query, _of_strings(strings)])


def trigrams(query: tuple) -> set[str]:
    return set() if query == ALL else {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


# ---- index

#: Texts of a bucket, the most that a posting list holds on average.
BUCKET = 4096


def build_index(docs: DataFrame, grams: list[str], text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The inverted index: bucket, gram (its number) and postings, the hashes of the texts that hold it, each once."""
    n_buckets = max(1, -(-docs.count() // bucket))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("k"), ascii_lower(text).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    rows = rows.select("k", F.pmod("k", F.lit(n_buckets)).alias("bucket"), F.explode(held).alias("gram"))
    return rows.groupBy("bucket", "gram").agg(F.collect_set("k").alias("postings"))


def _answer(query: tuple, grams: list[str], lists: Column) -> Column:
    """The texts of a bucket that fulfil a query; ``lists``: map of a trigram's number to its postings."""
    if query[0] == "tri":
        return F.coalesce(F.try_element_at(lists, F.lit(grams.index(query[1]))), F.array().cast("array<long>"))
    out, *rest = (_answer(q, grams, lists) for q in query[1])
    for x in rest:
        out = F.array_intersect(out, x) if query[0] == "and" else F.array_union(out, x)
    return out


def candidates(index: DataFrame, queries: list[tuple], grams: list[str]) -> DataFrame:
    """k, rules: for each text that some query finds the numbers of the queries, as bits."""
    buckets = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("gram", "postings"))).alias("lists"))
    asked = [(i, q) for i, q in enumerate(queries) if q != ALL]
    # inside a lambda, so that Spark does not generate code for it: the queries' many intersections would make too large a method
    found = let(F.col("lists"), lambda m: F.array(*(F.struct(F.lit(1 << i).cast("long").alias("rule"), _answer(q, grams, m).alias("ks")) for i, q in asked)))
    rows = buckets.select(F.explode(found).alias("f")).select("f.rule", F.explode("f.ks").alias("k"))
    return rows.groupBy("k").agg(F.bit_or("rule").alias("rules"))


# ---- columns


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<s, o, e, kind>> of a rule's matches; positions come from the lengths of matches and of what lies between."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)

    def span(x: Column, i: Column) -> Column:
        start = F.get(x["h"], i) + F.length(F.get(x["b"], i))
        whole_span = F.struct(start.alias("s"), F.lit(order).alias("o"), (start + F.length(F.get(x["m"], i))).alias("e"), F.lit(rule.kind).alias("kind"))
        return F.when(F.length(F.get(x["g"], i)) >= rule.least, whole_span)

    def build(m: Column) -> Column:
        lengths = F.transform(indices(F.size(m["m"])), lambda i: F.length(F.get(m["b"], i)) + F.length(F.get(m["m"], i)))
        return let(
            F.struct(m["m"].alias("m"), m["g"].alias("g"), m["b"].alias("b"), prefix_sums(lengths).alias("h")),
            lambda x: F.array_compact(F.transform(indices(F.size(x["m"])), lambda i: span(x, i))),
        )

    return let(F.struct(whole.alias("m"), part.alias("g"), between.alias("b")), build)


def scan_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = (*BASE_RULES, *MORE_RULES), bucket: int = BUCKET) -> DataFrame:
    """Adds ``found``: array<struct<s, o, e, kind>> by start, then rule order; replaces a column of that name."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(trigrams, queries)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*(c for c in docs.columns if c != "found"))
    always = F.lit(sum(1 << i for i, q in enumerate(queries) if q == ALL)).cast("long")
    if grams:
        index = materialize(build_index(docs, grams, text_col, bucket), "postings")
        asked = materialize(candidates(index, queries, grams), "candidates")
        asked = asked.select(F.col("k").alias("__k"), F.col("rules").alias("__found"))
        out = out.withColumn("__k", F.xxhash64(text)).join(asked, "__k", "left").drop("__k")
        out = out.withColumn("__rules", F.coalesce("__found", F.lit(0)).bitwiseOR(always)).drop("__found")
    else:
        out = out.withColumn("__rules", always)
    none = F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    spans = []
    for k, rule in enumerate(rules):
        ok = (F.col("__rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0) & text.rlike(rule.pattern)
        spans.append(F.when(ok, _spans(text, rule, k)).otherwise(none))
    return out.withColumn("found", F.when(F.col("__rules") != 0, F.array_sort(F.concat(*spans))).otherwise(none)).drop("__rules")


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
