"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that hold a word. A k-gram is the least
run of lines, from a given one on, with ``gram_words`` words. A window is the
least run with ``run_words`` words from a given line on, or up to a given line;
of all k-grams inside, the one with the smallest hash is its fingerprint. Equal
windows therefore always share a fingerprint.

Only windows whose fingerprint stands in several places are compared further.
They are joined, by (fingerprint, hash of the window), with the first place, in
(doc_id, text hash, line) order, of the window itself: one partner each, never
pairs within a group. A window whose first place is elsewhere is deleted. Every
line of a repeated run is in the window from the run's first line or in one up
to itself, so whole runs go, wherever their parts occurred first.

Lines without a
word are never deleted. Rows equal in doc_id and text are one document: all of
them keep what it keeps. Null doc_ids come first in order; null texts stay null.
Documents with fewer than ``run_words`` words are left alone. Extra columns pass
through; an existing ``n_removed`` is replaced. A line's words are the runs
between blanks. A text of any length is one row of arrays; of equal runs in one
document the first stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import materialize, release
from lodestone.llm.text import BLANK_SET, BLANKS, indices, let, prefix_sums

RUN_WORDS, GRAM_WORDS = 50, 25


def _kept(x: Column) -> Column:
    return F.trim(x, F.lit(BLANK_SET)) != ""


def _line_words(line: Column) -> Column:
    """Runs between blanks; where single spaces are the only blanks, as mostly, lengths tell."""
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    plain = lambda s: ~F.rlike(s, F.lit(r"[\x09-\x0D]|\x20\x20"))
    return let(F.trim(line, F.lit(BLANK_SET)), lambda s: F.when(plain(s), spaces(s) + 1).otherwise(F.size(F.split(s, BLANKS, -1))))


def _measured(text: Column) -> Column:
    """struct<l, n, before>: the lines that hold a word, their words, and the words before each."""
    lines = F.filter(F.split(text, "\n", -1), _kept)
    counted = lambda x: F.struct(x.alias("l"), F.transform(x, _line_words).alias("n"))
    return let(let(lines, counted), lambda x: F.struct(x["l"].alias("l"), x["n"].alias("n"), prefix_sums(x["n"]).alias("before")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """A row per window: id, __t (text hash), key and at (its fingerprint and that one's first line), h (hash of the window), a, b (first and last line)."""
    def end(x: Column, i: Column, least: int) -> Column:
        """The last line of the least run from line i with so many words; null if the document ends before."""

        def reach(here: Column) -> Column:
            short = lambda n: F.size(F.filter(F.slice(x["before"], i + 1, F.lit(n)), lambda c: c - here < least))
            few = F.coalesce(F.get(x["before"], i + 3) - here >= least, F.lit(False))  # mostly a few lines are enough
            return F.when(x["total"] - here >= least, i - 1 + F.when(few, short(4)).otherwise(short(least)))

        return let(F.get(x["before"], i), reach)

    def ends(x: Column) -> Column:
        at = lambda least: F.transform(indices(F.size(x["h"])), lambda i: end(x, i, least))
        return F.struct(x["h"].alias("h"), at(gram_words).alias("k"), at(run_words).alias("w"))

    def grams(x: Column) -> Column:
        gram = lambda i, b: F.struct(F.xxhash64(F.slice(x["h"], i + 1, b - i + 1)).alias("key"), i.alias("a"), b.alias("b"))
        every = F.transform(indices(F.size(x["h"])), lambda i: let(F.get(x["k"], i), lambda b: F.when(b.isNotNull(), gram(i, b))))
        return F.struct(x["h"].alias("h"), x["w"].alias("w"), every.alias("g"))

    def windows(x: Column) -> Column:
        """The least runs from every line on and up to every line, each with the gram with the smallest hash inside."""
        inside = lambda i, j: F.array_min(F.filter(F.slice(x["g"], i + 1, j - i + 1), lambda g: g["b"] <= j))

        def window(i: Column, j: Column) -> Column:
            h = F.xxhash64(F.slice(x["h"], i + 1, j - i + 1))
            return let(inside(i, j), lambda g: F.struct(g["key"].alias("key"), g["a"].alias("at"), h.alias("h"), i.alias("a"), j.alias("b")))

        def of(i: Column) -> Column:
            # up to a line that no window from a line ends at, the least run is from the last line whose window ends before
            last = lambda w: F.greatest(w, F.coalesce(F.get(x["w"], i + 1), F.size(x["h"])) - 1)
            return let(F.get(x["w"], i), lambda w: F.when(w.isNotNull(), F.transform(F.sequence(w, last(w)), lambda j: window(i, j))))

        return F.flatten(F.array_compact(F.transform(indices(F.size(x["h"])), of)))

    def start(m: Column) -> Column:
        total = F.get(m["before"], F.size(m["n"]) - 1) + F.get(m["n"], F.size(m["n"]) - 1)
        seed = F.struct(F.transform(m["l"], lambda s: F.xxhash64(s)).alias("h"), m["before"].alias("before"), total.alias("total"))
        return F.when(total >= run_words, let(seed, lambda x: let(ends(x), lambda y: let(grams(y), windows))))

    found = let(_measured(F.coalesce(F.col(text_col), F.lit(""))), start)
    out = docs.select(id_col, F.xxhash64(text_col).alias("__t"), F.explode(found).alias("f"))
    return out.select(id_col, "__t", "f.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """id, __t, a, b: windows that have a place before this one."""
    prints = materialize(fingerprints(docs, id_col, text_col, run_words, gram_words), "prints")
    place = lambda line: F.struct(F.col(id_col), F.col("__t"), F.col(line).alias("line"))
    # rows equal in id and text give equal fingerprints; a place counts once
    shared = prints.groupBy("key").agg(F.min(place("at")).alias("first"), F.max(place("at")).alias("last"))
    shared = materialize(shared.filter("first <> last").select("key"), "shared")
    found = materialize(prints.join(shared, "key").select("key", "h", id_col, "__t", "a", "b"), "found")
    first = found.groupBy("key", "h").agg(F.min(place("a")).alias("first"), F.max(place("a")).alias("last"))
    first = materialize(first.filter("first <> last").select("key", "h", "first"), "first")
    release(prints, shared)
    later = found.join(first, ["key", "h"]).filter(~place("a").eqNullSafe(F.col("first")))
    return later.select(id_col, "__t", "a", "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """The rows of ``docs`` with later repeated runs cut out of the text; adds n_removed (lines that hold a word)."""
    runs = repeated_runs(docs, id_col, text_col, run_words, gram_words)
    runs = runs.groupBy(id_col, "__t").agg(F.collect_set(F.struct("a", "b")).alias("__runs"))
    runs = runs.select(F.col(id_col).alias("__id"), F.col("__t").alias("__t2"), "__runs")
    kept = [c for c in docs.columns if c != "n_removed"]
    out = docs.select(*kept, F.xxhash64(text_col).alias("__t"))
    out = out.join(runs, out[id_col].eqNullSafe(runs["__id"]) & (out["__t"] == runs["__t2"]), "left")

    def cut(x: Column) -> Column:
        """struct<text, n> without the lines of the runs that are long enough."""
        m = x["m"]
        words_in = lambda r: F.get(m["before"], r["b"]) + F.get(m["n"], r["b"]) - F.get(m["before"], r["a"])
        long_enough = F.filter(x["r"], lambda r: words_in(r) >= run_words)
        gone = F.array_distinct(F.flatten(F.transform(long_enough, lambda r: F.sequence(r["a"], r["b"]))))
        numbered = F.filter(indices(F.size(x["e"])), lambda i: _kept(F.get(x["e"], i)))
        drop = let(F.struct(numbered.alias("k"), gone.alias("g")), lambda y: F.transform(y["g"], lambda k: F.get(y["k"], k)))

        def left(d: Column) -> Column:
            keep = F.array_except(indices(F.size(x["e"])), d)
            text = F.when(F.size(d) > 0, F.array_join(F.transform(keep, lambda i: F.get(x["e"], i)), "\n"))
            return F.struct(text.alias("text"), F.size(d).cast("long").alias("n"))

        return let(drop, left)

    parts = F.struct(_measured(F.col(text_col)).alias("m"), F.split(F.col(text_col), "\n", -1).alias("e"), F.col("__runs").alias("r"))
    out = out.withColumn("__cut", F.when(F.col("__runs").isNotNull(), let(parts, cut)))
    return out.withColumns({text_col: F.coalesce("__cut.text", text_col), "n_removed": F.coalesce("__cut.n", F.lit(0))}).select(*kept, "n_removed")
