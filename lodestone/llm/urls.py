"""URL filter: a trie over reversed host labels and path segments.

Rules are (verdict, "host/path"). A rule fits its host and all subdomains, if
the url's path starts with the rule's path; the longest match wins: more host
labels first, then the longer path. A rule given as allow and as block blocks.
Where no rule fits, the trie's wildcard node blocks hosts with an unwanted word
in a label; its root allows all others.

The trie is broadcast after its size has been checked; a larger rule set goes
another way with the same answers: each url lists the (host suffix, path prefix)
keys it could match, which are joined with the rules by Spark.

Null urls, and urls without ``://``, have an empty host and path and match no
rule. Repeated rows are judged each for itself; a long url is walked once, as far
as the trie goes. An empty table gives an empty result. Extra columns pass
through; columns named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.store import bound_batches
from lodestone.llm.text import ascii_lower

# The rules that the query is asked to apply.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Words of host labels that block where no rule fits.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "xxx")

TRIE_LIMIT = 64 << 20


ANY = ("any label",)  # no host has it


class Trie:
    """Nodes by reversed host labels; at a host's end, nodes by path segments.

    The last segment of a rule is a prefix of the url's segment there, so
    ``/en`` fits ``/english`` and ``/en/`` does not fit ``/en``. Under the
    root's wildcard stand words that block as a label's part, whatever labels
    are around it; the root itself allows. Both are shorter than any rule, so
    they decide only where no rule fits.
    """

    __slots__ = ("hosts",)

    def __init__(self, rules: Iterable[tuple[str, str]], unwanted: Iterable[str] = ()) -> None:
        self.hosts: dict = {ANY: dict.fromkeys(unwanted, (None, "block"))}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.hosts
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            *whole, last = (slash + path).split("/")
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, ("", "allow"))[1] != "block":
                ends[last] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict) of the longest match; a word's or the root's rule is None."""
        node, labels, found = self.hosts, host.split(".") if host else [], [self.hosts.get(None)]
        for label in reversed(labels):
            node = node.get(label)
            if node is None:
                break
            found.append(node.get(None))
        for paths in reversed(found):
            if paths is not None and (hit := self._path(paths, path)):
                return hit
        words = self.hosts[ANY]
        return next((words[part] for label in labels for part in label.split("-") if part in words), (None, "allow"))

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = node.get(None)
            if ends:
                fits = [e for e in ends if segment.startswith(e)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return best


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = RULES,
    url_col: str = "url",
    unwanted: Iterable[str] = UNWANTED,
    limit: int = TRIE_LIMIT,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row; existing columns of these names are replaced."""
    rules, unwanted = list(rules), sorted(set(unwanted))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    parted = (
        pages.select(*kept, F.coalesce(rest, F.lit("")).alias("__rest"))
        .withColumn("host", ascii_lower(F.regexp_extract("__rest", r"^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )
    if sum(len(v) + len(r) + 200 for v, r in rules) + sum(len(w) + 200 for w in unwanted) > limit:
        return _by_join(parted, rules, unwanted)
    bound_batches(parted.sparkSession)
    trie = parted.sparkSession.sparkContext.broadcast(Trie(rules, unwanted))
    schema = T.StructType([*parted.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            hits = [match(host, path) for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return parted.mapInArrow(judge, schema)


def _by_join(parted: DataFrame, rules: list[tuple[str, str]], unwanted: list[str]) -> DataFrame:
    """For rule sets that are too large to broadcast: join on the keys that a url could match.

    The best rule of a distinct (host, path) is found first, so that a hot
    page weighs once; then it is joined back. Path prefixes are cut at the
    lengths that rules' own paths have, so a url gives a key for each of its
    host suffixes and each such length, not for each of its characters.
    """
    spark = parted.sparkSession
    table = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    table = table.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block over allow
    lengths = F.array(*(F.lit(n) for n in sorted({len(r) - len(r.partition("/")[0]) for _, r in rules})))
    urls = parted.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    hosts = F.concat(
        F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))),
        F.array(F.lit("")),
    )
    keys = (
        urls.select("host", "path", F.posexplode(hosts).alias("depth", "suffix"))
        .select("host", "path", "depth", "suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
        .select("host", "path", "depth", "n", F.concat("suffix", F.expr("substr(path, 1, n)")).alias("rule"))
    )
    best = keys.join(table, "rule").groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(F.col("depth"), -F.col("n"))).alias("best"))
    words = spark.createDataFrame([(w,) for w in unwanted], "word string")
    parts = parted.select("host").distinct().select("host", F.explode(F.split("host", r"[.\-]", -1)).alias("word"))
    bad = parts.join(words, "word", "left_semi").select("host", F.lit(True).alias("__bad")).distinct()
    return parted.join(best, ["host", "path"], "left").join(bad, "host", "left").select(
        *parted.columns,
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("__bad"), "block"), F.lit("allow")).alias("verdict"),
    )
