"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles are hashed into
groups; the group counts are a point. For two points the summed coordinate
minima bound the overlap from above, and for two boxes of points the summed
minima of their upper corners bound that of every pair inside.

One tree over all documents would not do: texts of one length lie close
together, so boxes of unrelated documents overlap and the search tends to all
pairs. The tree's root is therefore dealt by group content: a linked pair
differs in at most D shingles, so of G > D groups some hold the same shingles in
both, and the two meet in the tile of such a group. G is fixed by size class,
and documents near a class's lower end join the class above too, so each pair
that may link has a class in common. If a document has so many empty groups that
the agreement may be on empty ones, it enters the tiles of its empty groups too:
no link is lost.

What happens in tiles:
1. Equal sets are one node, whatever the number of copies.
2. Every node takes one edge, to the least node of the tiles it shares most
   often, which is verified on the texts. Components of the links follow.
3. Only tiles with members of several components stay. Their members are packed
   into an R-tree, which is joined with itself from the root down; pairs of
   boxes, then of points, whose bound is too small are pruned. Tiles beyond BLOCK members are
   dealt to pairs of blocks. In two rounds each component's pair with the
   highest bound is verified; then whatever pair still parts two components.

Verification counts common shingles of the texts themselves.

Null and empty texts have no shingles, are linked with nothing and are their own
component. Repeated rows, and rows with one doc_id and several texts, are
documents of their own; a component's id is its smallest doc_id. Long texts are
hashed whole, in a batch of their own. ``jaccard_join`` returns its own columns
only, ``one_of_each`` those of its input, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.shingles import U, mix, shingle_sets
from lodestone.llm.store import bound_batches, materialize, release

#: Coordinates of a point, those of the folded point that boxes are made of, points of a leaf, children of an inner node, members of a tile's block.
DIMS, FOLDED, LEAF, FAN, BLOCK = 256, 32, 32, 4, 2048
ROWS, BYTES = 256, 1 << 20
_SET, _GROUP, _PART, _POINT = U(0x1B873593CC9E2D51), U(0x52DCE729DA3B1F2D), U(0x38495AB5C2B2AE35), U(0xA1B5F3C7E9D80B61)


class Classes:
    """Size classes and, for each, the number of groups; similarity is over / 100."""

    def __init__(self, over: int) -> None:
        self.over = over
        self.low, self.groups, self.differ = [1], [], []
        while self.low[-1] < 1 << 31:
            high = max(self.low[-1] + 1, -(-3 * self.low[-1] // 2))
            d = (100 - over) * 2 * (high - 1) // (100 + over)  # most shingles that are not in both
            self.differ.append(d)
            self.groups.append(d + 1 + max(1, d // 10))
            self.low.append(high)
        self.low = np.array(self.low)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1


def needed(n: np.ndarray, m: np.ndarray, over: int) -> np.ndarray:
    """The least overlap of two sets of these sizes that links them."""
    return -(-(n + m) * over // (100 + over))


def _pieces(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows and, but for single rows, BYTES bytes of text."""
    for batch in batches:
        sizes = sum(np.array(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(t))), 0), np.int64) for t in texts)
        at = 0
        while at < batch.num_rows:
            n = max(1, min(ROWS, int(np.searchsorted(np.cumsum(sizes[at : at + ROWS]), BYTES, side="right"))))
            yield batch.slice(at, n)
            at += n


def describe(texts: pa.Array, k: int, over: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Set sizes, node ids, signatures of tiles, and points."""
    rows, sh = shingle_sets(texts, k)
    count = len(texts)
    n = np.bincount(rows, minlength=count)
    with np.errstate(over="ignore"):
        node = np.zeros(count, U)
        np.add.at(node, rows, mix(sh ^ _SET))
        node = mix(node + n.astype(U) * _PART)
        points = np.bincount(rows * DIMS + (mix(sh ^ _POINT) % U(DIMS)).astype(np.int64), minlength=count * DIMS).reshape(count, DIMS).astype(np.uint32)
        classes = _classes(over)
        own = classes.of(np.maximum(n, 1))
        found, owners = [], []
        hashed, part = mix(sh ^ _GROUP) >> U(20), mix(sh ^ _PART)
        reach = 0
        while True:
            c = own + reach
            use = (n > 0) & ((100 * n >= over * classes.low[c]) if reach else True)
            if not use.any():
                break
            groups = np.where(use, np.array(classes.groups)[c], 0)
            base = np.concatenate([[0], np.cumsum(groups)])
            of = use[rows]
            slot = base[rows[of]] + (hashed[of] % groups[rows[of]].astype(U)).astype(np.int64)
            content = np.zeros(base[-1], U)
            np.add.at(content, slot, part[of])
            filled = np.bincount(slot, minlength=base[-1])
            owner = np.repeat(np.arange(count), groups)
            group = np.arange(base[-1]) - base[owner]
            empty = np.bincount(owner, weights=filled == 0, minlength=count)
            admit = (filled > 0) | (empty >= groups - np.array(classes.differ)[c])[owner]
            place = mix(c[owner].astype(U) * U(1 << 32) + group.astype(U) + _GROUP)
            found.append(mix(content + place + filled.astype(U) * _SET)[admit])
            owners.append(owner[admit])
            reach += 1
        sigs, who = (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, U), np.zeros(0, int))
        order = np.argsort(who, kind="stable")
        parts = np.split(sigs[order], np.cumsum(np.bincount(who, minlength=count))[:-1]) if count else []
    return n, node, parts, points


_made: dict[int, Classes] = {}


def _classes(over: int) -> Classes:
    if over not in _made:
        _made[over] = Classes(over)
    return _made[over]


def _describe(docs: DataFrame, k: int, over: int) -> DataFrame:
    """id, n, node, h and, where the partition meets the node for the first time, sigs and point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in _pieces(batches, "text"):
            n, node, sigs, points = describe(piece.column(1), k, over)
            node = node.view(np.int64)
            first = []
            for x, size in zip(node.tolist(), n.tolist(), strict=True):
                first.append(size > 0 and x not in seen)
                seen.add(x)
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.int64(), mask=n == 0),
                    pa.array([s.view(np.int64) if f else None for s, f in zip(sigs, first, strict=True)], pa.list_(pa.int64())),
                    pa.array([_written(p) if f else None for p, f in zip(points, first, strict=True)], pa.binary()),
                    piece.column(2),
                ],
                names=["id", "n", "node", "sigs", "point", "h"],
            )

    return docs.mapInArrow(run, "id long, n long, node long, sigs array<long>, point binary, h long")


def _written(point: np.ndarray) -> bytes:
    """A byte a coordinate where that is enough."""
    return (point.astype(np.uint8) if point.max() < 256 else point.astype(np.uint32)).tobytes()


def _points(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == DIMS for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, DIMS).astype(np.int32)
    return np.array([np.frombuffer(r, np.uint8 if len(r) == DIMS else np.uint32) for r in rows], np.int32)


def _bounded(pairs: DataFrame, points: DataFrame, over: int) -> DataFrame:
    """Of (a, b) pairs those whose bound is high enough."""
    left = points.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    right = points.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                bound = np.minimum(_points(col("p_a")), _points(col("p_b"))).sum(axis=1)
                ok = bound >= needed(col("n_a").to_numpy(), col("n_b").to_numpy(), over)
                yield pa.RecordBatch.from_arrays([col("a").filter(pa.array(ok)), col("b").filter(pa.array(ok))], names=["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, over: int) -> DataFrame:
    """Of (a, b) pairs those that link, by the shingles of their texts."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, "text_a", "text_b"):
            a, b = piece.column(piece.schema.get_field_index("a")), piece.column(piece.schema.get_field_index("b"))
            row_a, sh_a = shingle_sets(piece.column(piece.schema.get_field_index("text_a")), k)
            row_b, sh_b = shingle_sets(piece.column(piece.schema.get_field_index("text_b")), k)
            n, m = np.bincount(row_a, minlength=len(a)), np.bincount(row_b, minlength=len(a))
            rows, sh = np.r_[row_a, row_b], np.r_[sh_a, sh_b]
            order = np.lexsort((sh, rows))
            rows, sh = rows[order], sh[order]
            twice = (rows[1:] == rows[:-1]) & (sh[1:] == sh[:-1])
            common = np.bincount(rows[1:][twice], minlength=len(a))
            ok = pa.array(100 * common >= over * (n + m - common))
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class RTree:
    """A packed R-tree of count vectors: nodes of FAN children over leaves of LEAF points, in order of size and first coordinate.

    A node keeps the upper corner of its box and the least and largest size
    below it: all that the bound of a pair of nodes needs.
    """

    def __init__(self, n: np.ndarray, points: np.ndarray) -> None:
        starts = np.arange(0, len(n), LEAF)
        upper, small, large = np.maximum.reduceat(points, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        self.levels = [(upper, small, large)]  # leaves first, root last
        while len(upper) > 1:
            starts = np.arange(0, len(upper), FAN)
            upper, small, large = np.maximum.reduceat(upper, starts), np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts)
            self.levels.append((upper, small, large))

    def leaf_pairs(self, over: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs x <= y of leaves that the descent from (root, root) reaches: no pair of boxes on the way is bounded below what a link needs."""
        x = y = np.zeros(1, int)
        for level in range(len(self.levels) - 1, -1, -1):
            upper, small, large = self.levels[level]
            keep = []
            for at in range(0, len(x), 1 << 14):  # in blocks: a pair of boxes takes FOLDED numbers
                p, q = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                least = needed(small[p], small[q], over)
                ok = np.minimum(upper[p], upper[q]).sum(axis=1) >= least
                ok &= (100 * large[p] >= over * small[q]) & (100 * large[q] >= over * small[p])
                keep.append(ok)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            x, y = x[keep], y[keep]
            if level:
                below = len(self.levels[level - 1][0])
                grid = np.arange(FAN)
                x, y = ((FAN * x)[:, None, None] + grid[:, None] + 0 * grid).ravel(), ((FAN * y)[:, None, None] + 0 * grid[:, None] + grid).ravel()
                inside = (x <= y) & (y < below)
                x, y = x[inside], y[inside]
        return x, y


def rtree_pairs(n: np.ndarray, points: np.ndarray, comp: np.ndarray, block: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components whose bound admits a link: (i, j, bound). Of two blocks only pairs across them.

    Boxes and a first look at pairs use folded points, whose coordinates are
    sums of some of the point's; what is left is held against the whole points.
    """
    across = block.min() != block.max()
    folded = points.reshape(len(points), FOLDED, -1).sum(axis=2)
    order = np.lexsort((folded[:, 0], n))
    n, points, folded, comp, block = n[order], points[order], folded[order], comp[order], block[order]
    out_i, out_j, out_bound = [], [], []
    for x, y in zip(*RTree(n, folded).leaf_pairs(over), strict=True):
        s, t = slice(x * LEAF, (x + 1) * LEAF), slice(y * LEAF, (y + 1) * LEAF)
        ok = comp[s][:, None] != comp[t][None, :]
        if across:
            ok &= block[s][:, None] != block[t][None, :]
        if not ok.any():
            continue
        least = needed(n[s][:, None], n[t][None, :], over)
        ok &= np.minimum(folded[s][:, None, :], folded[t][None, :, :]).sum(axis=2) >= least
        i, j = np.nonzero(ok)
        if x == y:
            i, j = i[i < j], j[i < j]
        bound = np.minimum(points[i + s.start], points[j + t.start]).sum(axis=1)
        good = bound >= least[i, j]
        out_i.append(order[i[good] + s.start])
        out_j.append(order[j[good] + t.start])
        out_bound.append(bound[good])
    none = np.zeros(0, int)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), np.concatenate([none, *out_bound])


def best_of_each(ca: np.ndarray, cb: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Of every component the pair with the highest bound, by number."""
    order = np.argsort(-bound, kind="stable")
    return np.unique(np.concatenate([order[np.unique(c[order], return_index=True)[1]] for c in (ca, cb)]))


def _tile_pairs(members: DataFrame, over: int, every: bool) -> DataFrame:
    """members: sig, many (of the tile), node, comp, n, point -> sig, a < b, more.

    Unless ``every``, a block gives each component's best pair only, and
    ``more`` says whether it has others.
    """
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("sig", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "comp", "n", "point")
    dealt = dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows < 2:
            return
        col = lambda c: t.column(c).to_numpy()
        node, comp = col("node"), col("comp")
        if comp.min() == comp.max():
            return
        i, j, bound = rtree_pairs(col("n"), _points(t.column("point")), comp, col("mine"), over)
        more = False
        if not every and len(i) > 1:
            best = best_of_each(comp[i], comp[j], bound)
            more, i, j = len(best) < len(i), i[best], j[best]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        sig = np.full(len(a), col("sig")[0])
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), more))], names=["sig", "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                now = tuple(int(k[s]) for k in keys)
                if held and now != key:
                    yield from solve(held)
                    held = []
                key = now
                held.append(batch.slice(s, e - s))
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, "sig long, a long, b long, more boolean")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, over: int = 85) -> DataFrame:
    """A row per row of ``docs``: id, n_shingles, component_id. Documents link at a Jaccard similarity of ``over`` / 100."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return _joined(texts, k, over).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, over: int = 85) -> DataFrame:
    """The rows of ``docs``, of each component one only.

    It is the document with the smallest id (null ids last), of several texts
    with that id the one with the smallest hash, and of rows equal in both the
    least by their other columns. Documents that are linked with nothing stay,
    also where another one has the same id; so do null and empty texts, once
    for each id.
    """
    h = F.xxhash64(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), h.alias("h"))
    kept = _joined(texts, k, over).filter(F.col("first").isNull() | (_place() == F.col("first")))
    kept = materialize(kept.select(F.col("id").alias("__id"), F.col("h").alias("__kept")).distinct(), "kept")
    rows = docs.select(F.col(id_col).cast("long").alias("__own"), h.alias("__h"), F.struct(*(F.col(c) for c in docs.columns)).alias("__row"))
    rows = rows.join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kept")), "left_semi")
    return rows.groupBy("__own", "__h").agg(F.min("__row").alias("__row")).select("__row.*")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))


def _joined(texts: DataFrame, k: int, over: int) -> DataFrame:
    """texts: id, text, h -> id, h, n, component_id and first, the component's least place; null for a text without shingles."""
    bound_batches(texts.sparkSession)
    sets = materialize(_describe(texts, k, over), "sets")
    least = F.min(_place()).alias("first")
    nodes = sets.filter("node is not null").groupBy("node").agg(least, F.max("n").alias("n"), F.max("point").alias("point"))
    nodes = materialize(nodes, "nodes")
    sigs = sets.filter("sigs is not null").select("node", F.explode("sigs").alias("sig"))
    tiles = sigs.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last").select("sig", "pivot")
    tiles = materialize(tiles, "tiles")
    members = materialize(sigs.join(tiles, "sig"), "members")
    whole, sets = sets, materialize(sets.select("id", "h", "n", "node"), "documents")
    release(tiles, whole)

    # every node's edge to the pivot of most of its tiles
    star = members.filter("node <> pivot").groupBy("node", "pivot").count()
    star = star.groupBy("node").agg(F.max(F.struct("count", "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("node").alias("b"))
    points = nodes.select("node", "n", "point")
    star = materialize(_bounded(star, points, over), "star")
    alive = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    whose = alive.select(F.col("first.id").alias("rep"), F.col("first.h").alias("rep_h"), "node")
    body = texts.join(whose, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))).select("node", "text")
    body = materialize(body.dropDuplicates(["node"]), "bodies")
    links = materialize(_verified(star, body, k, over), "links")
    roots = components(links)

    # tiles that still hold several components: best pairs first, and at last all that are left
    tested = star
    base, read = members.select("sig", "node").distinct(), [members]
    for every in (False, False, True):
        placed = base.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("comp"))
        placed = materialize(placed, "placed")
        release(*read)
        still = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).filter("lo <> hi").select("sig", "many")
        inside = placed.join(materialize(still, "open"), "sig").join(points, "node")
        found = materialize(_tile_pairs(inside, over, every), "found")
        pairs = materialize(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = materialize(_verified(pairs, body, k, over), "links")
        if more.limit(1).count():
            links = links.union(more)
            roots = components(links)
        open_sigs = materialize(found.filter("more").select("sig").distinct(), "more")
        if not open_sigs.limit(1).count():
            break
        tested = tested.union(pairs)
        base, read = placed.select("sig", "node").join(open_sigs, "sig", "left_semi"), [placed, found, open_sigs]

    named = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = named.join(materialize(named.groupBy("root").agg(F.min("first").alias("least")), "least"), "root")
    named = materialize(named.select("node", F.col("least").alias("first")), "named")
    out = sets.select("id", "h", "n", "node").join(named, "node", "left")
    return out.select("id", "h", "n", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"), "first")

