"""SimHash near duplicates by pigeonhole blocks.

A text's fingerprint has 64 bits; each is the majority of that bit over the
XXH64 hashes of its word shingles, repeats included. Two fingerprints link when
they differ in ``BITS`` bits or fewer.

Fingerprints are cut into ``BLOCKS`` blocks of bits. A pair that differs in BITS bits differs in
at most as many blocks, so it agrees in one of the choices of BLOCKS - BITS
blocks: with six blocks and three bits, in one of 20 keys of 31 to 33 bits, of which few
are shared by chance even among billions of fingerprints. What happens then:

1. Equal fingerprints are one node, whatever the number of copies.
2. Nodes meet on their keys; those that no other node has go at once. Each
   node takes an edge to the least node of its bucket if they link.
3. Only buckets that still hold several components stay. A bucket beyond
   ``REFINE`` members is split again by the same principle over the bits that its key
   leaves open, which bounds what shares a key at 2**16 nodes. Members are dealt to pairs of blocks of ``BLOCK``;
   a task compares what is in different components and gives back a spanning
   forest, never all its pairs. Every close pair meets in some task, so no link is lost.

Null texts and texts without words have the fingerprint zero, which links like
any other; fewer words than a shingle's are one shingle. A bit set in exactly half of the hashes
is 0. Repeated rows are rows of their own; a component's id is the smallest id
in it, null only if all its ids are. Long texts are hashed in pieces of ``PIECE`` words.
``fingerprints`` passes other columns on and replaces one named
``fingerprint``; ``near_duplicates`` returns its own columns only. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices, texts_of
from lodestone.llm.graph import components
from lodestone.llm.store import bound_batches, materialize, release

WORDS, SEED = 3, 42
BITS, BLOCKS = 3, 6
BLOCK, REFINE, PIECE = 2048, 32_768, 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    total = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, PIECE):
        part = found[at : at + PIECE + words - 1]
        joined = b" ".join(part)
        starts = np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)  # of each word; the last one ends a space before the next start
        many = min(PIECE, total - at)
        ends = starts[min(words, len(part)) :][:many] - 1
        hashes = np.fromiter([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[:many].tolist(), ends.tolist(), strict=True)], np.uint64, many)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Adds ``fingerprint``, a long of the 64 bits."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__text"):
            prints = np.array([fingerprint(t, words) for t in texts_of(piece, "__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(prints)], names=[*kept, "fingerprint"])

    rows = docs.select(*kept, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, docs.select(*kept).schema.add("fingerprint", "long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def key_masks(places: list[int], blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """One mask for each choice of blocks of these bit places in which two fingerprints may agree."""
    parts = [sum(1 << int(p) for p in part) for part in np.array_split(np.array(places), blocks)]
    return [sum(c) for c in combinations(parts, blocks - bits)]


def _keys(fp: Column, masks: list[int]) -> Column:
    """array of struct<t, key>: the choice's number and the bits under its mask."""
    return F.array(*(F.struct(F.lit(t).cast("short").alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))


def spanning_edges(prints: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all components that links connect; of two sides, links across them only. Fewer edges than components.

    Members of the largest component are only compared with the others.
    """
    across = side.min() != side.max()
    _, first, number, many = np.unique(comp, return_index=True, return_inverse=True, return_counts=True)
    root = np.arange(len(first))
    rest = np.flatnonzero(number != many.argmax())
    for at in range(0, len(rest), 256):
        rows, whose = rest[at : at + 256], root[number]
        close = np.bitwise_count(prints[rows][:, None] ^ prints[None, :]) <= bits
        close &= whose[rows][:, None] != whose[None, :]
        if across:
            close &= side[rows][:, None] != side[None, :]
        i, j = np.nonzero(close)
        pairs = np.unique(whose[rows[i]] * len(first) + whose[j])
        a, b = pairs // len(first), pairs % len(first)
        while (root[a] != root[b]).any():  # least roots along links, then roots of roots
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return first[moved], first[root[moved]]


def _tile_edges(members: DataFrame, bits: int, block: int) -> DataFrame:
    """members: t, key, many, fp, comp -> edges a, b that connect what links in the tiles."""
    blocks = F.ceil(F.col("many") / F.lit(block)).cast("int")
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("t", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "fp", "comp")
    dealt = dealt.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        fp, comp, side = (table.column(c).to_numpy() for c in ("fp", "comp", "mine"))
        if len(fp) > 1 and comp.min() != comp.max():
            i, j = spanning_edges(fp.view(np.uint64), comp, side, bits)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in range(4)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                now = tuple(int(k[s]) for k in keys)
                if held and now != last:
                    yield from solve(held)
                    held = []
                last = now
                held.append(batch.slice(s, e - s))
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, "a long, b long")


def _finer(tiles: DataFrame, masks: list[int], bits: int, blocks: int) -> DataFrame:
    """Tiles split again by blocks of the bits that their keys leave open."""
    inner = [key_masks([p for p in range(64) if not m >> p & 1], blocks, bits) for m in masks]
    fixed = lambda t, m, k: F.struct(F.lit(t * len(inner[t]) + k + len(masks)).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m | inner[t][k]))).alias("key"))
    which = F.lit(None).cast("array<struct<t: short, key: long>>")
    for t, m in enumerate(masks):
        which = F.when(F.col("t") == t, F.array(*(fixed(t, m, k) for k in range(len(inner[t]))))).otherwise(which)
    return tiles.select("fp", "comp", F.explode(which).alias("at")).select("at.t", "at.key", "fp", "comp")


def linked(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, block: int = BLOCK, refine: int = REFINE) -> DataFrame:
    """nodes: distinct fp -> fp, root of all that are linked with another one."""
    masks = key_masks(list(range(64)), blocks, bits)
    size = nodes.count()
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("at")).select("at.t", "at.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).filter("pivot <> last").select("t", "key", "pivot")
    members = materialize(keyed.join(shared, ["t", "key"]), "members", len(masks) * size)
    close = (F.col("fp") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= bits)
    links = materialize(members.filter(close).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), "links", len(masks) * size)
    roots = components(links)

    placed = members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("t", "key", "fp", F.coalesce("root", "fp").alias("comp"))
    placed = materialize(placed, "placed", len(masks) * size)
    release(members)

    def still(tiles: DataFrame) -> DataFrame:
        """Tiles with several components, and how many members they have."""
        seen = tiles.groupBy("t", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many"))
        return materialize(seen.filter("lo <> hi").select("t", "key", "many"), "open", len(masks) * size)

    unsolved = still(placed)
    inside = placed.join(unsolved, ["t", "key"])
    if unsolved.filter(F.col("many") > refine).limit(1).count():
        finer = materialize(_finer(inside.filter(F.col("many") > refine), masks, bits, blocks), "finer")
        inside = inside.filter(F.col("many") <= refine).select("t", "key", "fp", "comp", "many").union(finer.join(still(finer), ["t", "key"]).select("t", "key", "fp", "comp", "many"))
    more = materialize(_tile_edges(inside, bits, block), "edges")
    return components(links.union(more)) if more.limit(1).count() else roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, **sizes: int) -> DataFrame:
    """A row per row of ``docs``: id, fingerprint (long) and component_id."""
    rows = fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows = materialize(rows.select("id", F.col("fingerprint").alias("fp")), "prints")
    size = rows.count()
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes", size)
    roots = linked(nodes.select("fp"), bits, **sizes)
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named", size)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    whose = materialize(named.join(least, "root").select("fp", "component_id"), "whose", size)
    release(nodes, named)
    return rows.join(whose, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
