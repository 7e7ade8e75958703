"""Texts matched by the words they share: labels to a new snapshot, quotes to units.

Words meet through postings (source, word), never texts with all texts; words
that stand in many chunks of a source are left out first where that is the rule.
Shares are compared as whole numbers. The postings of a source of usual size meet in the task
that holds its chunks, so each chunk's words are exchanged once; those of a longer
source are dealt by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import squeeze, word_set
from lodestone.operators.groups import codes, lists, starts, whole_groups
from lodestone.operators.retrieval import top_k
from lodestone.operators.settle import settle

# Shares as (of, per), and the least number of a split chunk's words.
COVER, CONTAIN, COMMON, LEAST_WORDS = (6, 10), (8, 10), (1, 10), 5
MATCHED, MARGIN = (3, 5), (1, 10)

#: Characters of a source's chunks, old and new, that one task takes; pairs of postings that meet at once.
WHOLE, MEETING = 1 << 23, 1 << 21
REMAPPED = "source {source}, num {num}, targets array<bigint>, kind string"


def remap_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: source, num, text -> source, num (of old), targets (nums of new, ascending), kind.

    kind is exact (the same text up to white space; the nearest number, then the
    smaller one), split (all new chunks whose rare words lie mostly in the old
    one), merge (the new chunk with most of the old one's rare words, if it has enough),
    no-words (nothing rare in the old one) or unmapped. Words of more than a
    tenth of a source's new chunks are common. Equal rows of ``old`` are mapped once.
    A source of more than ``WHOLE`` characters, or with a row without source or number, has its words dealt by word.
    """
    both = [x.select("source", F.length("text").alias("chars"), F.col("num").isNull().alias("odd")) for x in (old, new)]
    sizes = both[0].unionByName(both[1]).groupBy("source").agg(F.sum("chars").alias("chars"), F.max("odd").alias("odd"))
    large = settle(sizes.filter(F.col("source").isNull() | F.col("odd") | (F.col("chars") > WHOLE)).select(F.col("source").alias("__source")), "large")
    if large.isEmpty():
        return _remap_whole(old, new)
    parted = lambda x, how: x.join(large, F.col("source").eqNullSafe(F.col("__source")), how)
    return _remap_whole(parted(old, "left_anti"), parted(new, "left_anti")).unionByName(_remap_dealt(parted(old, "left_semi"), parted(new, "left_semi")))


def _remap_whole(old: DataFrame, new: DataFrame) -> DataFrame:
    """``remap_labels`` of sources whose chunks one task can hold."""
    kinds, meeting = dict(old.dtypes), MEETING

    def part(x: DataFrame, side: int) -> DataFrame:
        return x.select("source", F.lit(side).alias("side"), F.col("num").cast("long").alias("num"), F.md5(squeeze(F.coalesce("text", F.lit("")))).alias("h"), word_set(F.col("text")).alias("ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "source"):
            yield _remapped(whole, meeting)

    rows = part(old, 0).unionByName(part(new, 1)).repartition("source").sortWithinPartitions("source")
    out = rows.mapInArrow(run, REMAPPED.format(source=kinds["source"], num="long"))
    return out.withColumn("num", F.col("num").cast(kinds["num"]))


def _nearest(asked: np.ndarray, num: np.ndarray, held: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each asked key with its number the row of the held one with the same key and the nearest number (of two the smaller), or -1."""
    key, value, side = np.r_[held, asked], np.r_[to, num], np.r_[np.zeros(len(held), np.int8), np.ones(len(asked), np.int8)]
    order = np.lexsort((side, value, key))
    place, here = np.arange(len(order)), side[order] == 0
    before = np.maximum.accumulate(np.where(here, place, -1))
    after = np.minimum.accumulate(np.where(here, place, len(order))[::-1])[::-1]
    at = np.flatnonzero(~here)
    rows = order[at]
    out = np.full(len(asked), -1)
    gaps, names = [], []
    for side_ in (before[at], after[at]):
        row = order[np.clip(side_, 0, len(order) - 1)]
        fits = (side_ >= 0) & (side_ < len(order)) & (key[row] == key[rows])
        gaps.append(np.where(fits, np.abs(value[row] - value[rows]), np.iinfo(np.int64).max))
        names.append(np.where(fits, row, -1))
    out[rows - len(held)] = np.where(gaps[0] <= gaps[1], names[0], names[1])
    return out


def _remapped(whole: pa.Table, meeting: int) -> pa.RecordBatch:
    """Results of the old chunks of a table of whole sources."""
    group = np.zeros(len(whole), np.int64)
    group[starts(whole["source"])[1:]] = 1
    group, side, num = np.cumsum(group), whole["side"].to_numpy(), whole["num"].to_numpy()
    (h,), n_h = codes(whole["h"])
    flat, lengths = lists(whole["ws"])
    (word,), n_w = codes(flat)
    row = np.repeat(np.arange(len(whole)), lengths)
    word = group[row] * n_w + word
    text = group * n_h + h

    new = np.flatnonzero(side == 1)
    old = np.flatnonzero(side == 0)
    order = old[np.lexsort((num[old], text[old]))]
    old = order[np.r_[True, (text[order][1:] != text[order][:-1]) | (num[order][1:] != num[order][:-1])]] if len(order) else order
    same = _nearest(text[old], num[old], text[new], num[new])

    # words of more than a tenth of their source's new chunks are common
    fresh = side[row] == 1
    kinds, back = np.unique(word, return_inverse=True)
    df = np.bincount(back[fresh], minlength=len(kinds))
    chunks = np.bincount(group[new], minlength=group[-1] + 1)
    rare = ~(df * COMMON[1] > chunks[kinds // max(1, n_w)] * COMMON[0])[back]
    target = np.full(len(whole), -1)
    at = np.lexsort((num[new], group[new]))
    first = np.r_[True, (num[new][at][1:] != num[new][at][:-1]) | (group[new][at][1:] != group[new][at][:-1])] if len(new) else np.zeros(0, bool)
    target[new[at]] = np.cumsum(first) - 1
    to = num[new][at][first]  # of each target, ascending within a source
    place = np.full(len(whole), -1)
    place[old[same < 0]] = np.flatnonzero(same < 0)
    posted = np.flatnonzero(fresh & rare)
    posted = posted[np.argsort(back[posted], kind="stable")]
    mine = np.flatnonzero(~fresh & rare & (place[row] >= 0))
    mine = mine[np.argsort(place[row[mine]], kind="stable")]
    n_new = np.bincount(target[row[posted]], minlength=len(to))
    n_old = np.bincount(place[row[mine]], minlength=len(old))

    # postings meet, some old chunks at a time
    keys = back[posted]
    lo, hi = np.searchsorted(keys, back[mine]), np.searchsorted(keys, back[mine], "right")
    many, who = hi - lo, place[row[mine]]
    upto = np.r_[0, np.cumsum(np.bincount(who, many, len(old)))].astype(np.int64)
    edge = np.searchsorted(who, np.arange(len(old) + 1))
    best, best_n, splits, a = np.full(len(old), -1), np.zeros(len(old), np.int64), [], 0
    while a < len(old):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + meeting, "right")) - 1)
        s = slice(edge[a], edge[b])
        ends = np.cumsum(many[s])
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[s] - ends + many[s], many[s])
        pair, n = np.unique(np.repeat(who[s], many[s]) * max(1, len(to)) + target[row[posted[entry]]], return_counts=True)
        i, j = np.divmod(pair, max(1, len(to)))
        ranked = np.lexsort((j, -n, i))
        lead = ranked[np.r_[True, i[ranked][1:] != i[ranked][:-1]]] if len(ranked) else ranked
        best[i[lead]], best_n[i[lead]] = j[lead], n[lead]
        inside = (n_new[j] >= LEAST_WORDS) & (n * COVER[1] >= n_new[j] * COVER[0])
        splits.append((i[inside], j[inside]))
        a = b
    i, j = (np.concatenate([x[k] for x in splits]) if splits else np.zeros(0, np.int64) for k in (0, 1))
    n_split = np.bincount(i, minlength=len(old))
    merged = (best >= 0) & (best_n * CONTAIN[1] >= n_old * CONTAIN[0])
    kind = np.select([same >= 0, n_old == 0, n_split > 0, merged], ["exact", "no-words", "split", "merge"], "unmapped").astype(object)
    single = (kind == "exact") | (kind == "merge")
    lone = np.where(kind == "exact", num[new][np.maximum(same, 0)] if len(new) else 0, to[np.maximum(best, 0)] if len(to) else 0)
    size = np.where(kind == "split", n_split, single.astype(np.int64))
    keep = kind[i] == "split"
    values, owner = np.r_[to[j[keep]], lone[single]], np.r_[i[keep], np.flatnonzero(single)]
    values = values[np.argsort(owner, kind="stable")]
    targets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(values, pa.int64()))
    return pa.RecordBatch.from_arrays([whole["source"].combine_chunks().take(pa.array(old)), pa.array(num[old], pa.int64()), targets, pa.array(kind.tolist(), pa.string())], ["source", "num", "targets", "kind"])


def _remap_dealt(old: DataFrame, new: DataFrame) -> DataFrame:
    """``remap_labels`` with words dealt by source and word."""
    olds = old.select("source", "num", F.md5(squeeze(F.coalesce("text", F.lit("")))).alias("h"), word_set(F.col("text")).alias("ws")).dropDuplicates(["source", "num", "h"])
    news = settle(new.select("source", F.col("num").alias("to"), F.md5(squeeze(F.coalesce("text", F.lit("")))).alias("h"), word_set(F.col("text")).alias("ws")), "new")
    gap = F.struct(F.abs(F.col("to") - F.col("num")).alias("gap"), F.col("to").alias("to"))
    exact = olds.join(news.select("source", "to", "h"), ["source", "h"]).groupBy("source", "num", "h").agg(F.min(gap)["to"].alias("same"))
    olds = settle(olds.join(exact, ["source", "num", "h"], "left"), "old")

    sizes = news.groupBy("source").agg(F.count("*").alias("chunks"))
    posted = news.select("source", "to", F.explode("ws").alias("w"))
    common = posted.groupBy("source", "w").agg(F.count("*").alias("df")).join(sizes, "source").filter(F.col("df") * COMMON[1] > F.col("chunks") * COMMON[0]).select("source", "w")
    rare_new = settle(posted.join(common, ["source", "w"], "left_anti"), "rare")
    rare_old = olds.filter("same is null").select("source", "num", "h", F.explode("ws").alias("w")).join(common, ["source", "w"], "left_anti")
    n_new = rare_new.groupBy("source", "to").agg(F.count("*").alias("n_new"))
    n_old = rare_old.groupBy("source", "num", "h").agg(F.count("*").alias("n_old"))
    pairs = rare_old.join(rare_new, ["source", "w"]).groupBy("source", "num", "h", "to").agg(F.count("*").alias("n")).join(n_new, ["source", "to"])
    inside = (F.col("n_new") >= LEAST_WORDS) & (F.col("n") * COVER[1] >= F.col("n_new") * COVER[0])
    found = pairs.groupBy("source", "num", "h").agg(F.array_sort(F.collect_list(F.when(inside, F.col("to")))).alias("split"), F.max(F.struct("n", (-F.col("to")).alias("to"))).alias("best"))
    out = olds.join(n_old, ["source", "num", "h"], "left").join(found, ["source", "num", "h"], "left")
    enough = F.col("best.n") * CONTAIN[1] >= F.col("n_old") * CONTAIN[0]
    kind = F.when(F.col("same").isNotNull(), "exact").when(F.col("n_old").isNull(), "no-words").when(F.size("split") > 0, "split").when(enough, "merge").otherwise("unmapped")
    targets = F.when(kind == "exact", F.array("same")).when(kind == "split", F.col("split")).when(kind == "merge", F.array(-F.col("best.to"))).otherwise(F.array().cast("array<long>"))
    return out.select("source", "num", targets.cast("array<long>").alias("targets"), kind.alias("kind"))


def match_units(texts: DataFrame, units: DataFrame) -> DataFrame:
    """texts: id, doc, text; units: doc, unit, text -> id, doc, unit (null with a reason), score, second, reason.

    The unit of the same document that holds most of the text's words, if it
    holds three fifths of them and leads the next one by a tenth. Of equals the
    shorter unit leads, then the smaller name. reason: empty_words,
    below_threshold, ambiguous. A unit without a shared word has score 0.
    A document of more than ``WHOLE`` characters, or without a number, has its words dealt by word.
    """
    both = texts.select("doc", F.length("text").alias("chars")).unionByName(units.select("doc", F.length("text").alias("chars")))
    large = settle(both.groupBy("doc").agg(F.sum("chars").alias("chars")).filter(F.col("doc").isNull() | (F.col("chars") > WHOLE)).select(F.col("doc").alias("__doc")), "large")
    if large.isEmpty():
        return _match_whole(texts, units)
    parted = lambda x, how: x.join(large, F.col("doc").eqNullSafe(F.col("__doc")), how)
    return _match_whole(parted(texts, "left_anti"), parted(units, "left_anti")).unionByName(_match_dealt(parted(texts, "left_semi"), parted(units, "left_semi")))


def _match_whole(texts: DataFrame, units: DataFrame) -> DataFrame:
    """``match_units`` of documents whose texts one task can hold: texts are exchanged once, as they are, and their words never."""
    kinds, names, meeting = dict(texts.dtypes), dict(units.dtypes), MEETING
    none = lambda kind: F.lit(None).cast(kind)
    left = texts.select("doc", F.lit(0).alias("side"), "id", none(names["unit"]).alias("unit"), "text")
    right = units.select("doc", F.lit(1).alias("side"), none(kinds["id"]).alias("id"), "unit", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "doc"):
            yield _two_best(whole, meeting)

    # units come last and in the order in which equals lead
    rows = left.unionByName(right).repartition("doc").withColumn("size", F.length("text")).sortWithinPartitions("doc", "side", "size", "unit")
    rows = rows.select("doc", "side", "id", "unit", "size", word_set(F.col("text")).alias("ws"))
    out = rows.mapInArrow(run, f"id {kinds['id']}, doc {kinds['doc']}, best {names['unit']}, n long, m long, nw long, units long")
    return _matched(out)


def _two_best(whole: pa.Table, meeting: int) -> pa.RecordBatch:
    """For each text of a table of whole documents its best unit, how many words that and the next one share with it, its words and the document's units."""
    group = np.zeros(len(whole), np.int64)
    group[starts(whole["doc"])[1:]] = 1
    group, side = np.cumsum(group), whole["side"].to_numpy()
    flat, lengths = lists(whole["ws"])
    (word,), n_w = codes(flat)
    row = np.repeat(np.arange(len(whole)), lengths)
    word = group[row] * max(1, n_w) + word
    asked, held = np.flatnonzero(side == 0), side[row] == 1
    posted, mine = np.flatnonzero(held), np.flatnonzero(~held)
    posted = posted[np.argsort(word[posted], kind="stable")]
    keys = word[posted]
    lo, hi = np.searchsorted(keys, word[mine]), np.searchsorted(keys, word[mine], "right")
    place = np.full(len(whole), -1)
    place[asked] = np.arange(len(asked))
    many, who = hi - lo, place[row[mine]]
    upto = np.r_[0, np.cumsum(np.bincount(who, many, len(asked)))].astype(np.int64)
    edge = np.searchsorted(who, np.arange(len(asked) + 1))
    best, n, m, a = np.full(len(asked), -1), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), 0
    while a < len(asked):  # postings meet, some texts at a time
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + meeting, "right")) - 1)
        s = slice(edge[a], edge[b])
        ends = np.cumsum(many[s])
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[s] - ends + many[s], many[s])
        pair, shared = np.unique(np.repeat(who[s], many[s]) * len(whole) + row[posted[entry]], return_counts=True)
        i, j = np.divmod(pair, len(whole))
        ranked = np.lexsort((j, -shared, i))  # rows of units ascend as equals lead
        i, j, shared = i[ranked], j[ranked], shared[ranked]
        lead = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        best[i[lead]], n[i[lead]] = j[lead], shared[lead]
        after = lead + 1
        after = after[(after < len(i)) & (i[np.minimum(after, len(i) - 1)] == i[np.maximum(after - 1, 0)])] if len(i) else after
        m[i[after]] = shared[after]
        a = b
    units = np.bincount(group[side == 1], minlength=group[-1] + 1)
    take = lambda c, at, known=None: whole[c].combine_chunks().take(pa.array(at, pa.int64(), mask=known))
    named = take("unit", np.maximum(best, 0), best < 0)
    return pa.RecordBatch.from_arrays([take("id", asked), take("doc", asked), named, pa.array(n), pa.array(m), pa.array(lengths[asked]), pa.array(units[group[asked]])], ["id", "doc", "best", "n", "m", "nw", "units"])


def _matched(two: DataFrame) -> DataFrame:
    n, m, of = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)), F.col("nw")
    close = (F.coalesce("units", F.lit(0)) > 1) & ((n - m) * MARGIN[1] < of * MARGIN[0])
    reason = F.when(of == 0, "empty_words").when(n * MATCHED[1] < of * MATCHED[0], "below_threshold").when(close, "ambiguous")
    share = lambda x: F.when(of == 0, 0.0).otherwise(x / F.greatest(of, F.lit(1)))
    return two.select("id", "doc", F.when(reason.isNull(), F.col("best")).alias("unit"), share(n).alias("score"), share(m).alias("second"), reason.alias("reason"))


def _match_dealt(texts: DataFrame, units: DataFrame) -> DataFrame:
    """``match_units`` with words dealt by document and word."""
    asked = texts.select("id", "doc", word_set(F.col("text")).alias("ws"))
    held = settle(units.select("doc", "unit", F.length("text").alias("size"), word_set(F.col("text")).alias("ws")), "units")
    pairs = asked.select("id", "doc", F.explode("ws").alias("w")).join(held.select("doc", "unit", "size", F.explode("ws").alias("w")), ["doc", "w"])
    counts = pairs.groupBy("id", "doc", "unit", "size").agg(F.count("*").alias("n"))
    two = top_k(counts, ["id", "doc"], [F.desc("n"), F.asc("size"), F.asc("unit")], 2)
    first = two.groupBy("id", "doc").agg(F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("unit"))).alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0)).alias("m"))
    many = held.groupBy("doc").agg(F.count("*").alias("units"))
    return _matched(asked.join(first, ["id", "doc"], "left").join(many, "doc", "left").withColumn("nw", F.size("ws")))
