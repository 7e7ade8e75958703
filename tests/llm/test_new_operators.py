"""SimHash, vector codes and periodic runs: against brute force, on the tables and on odd rows."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash

from lodestone.llm import codes, periods, queries, simhash
from tests.llm import brute
from tests.llm.test_operators import words

ODD = [None, "", " \t\n", "one", "One two", "a b c", "a b c d", "x " * 3000, "\x0b".join(["é", "É"] * 40), " ".join(["p q r s t"] * 9) + " tail " + words(3000, 5)]


# --- fingerprints


def plain_fingerprint(text, k=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOW))
    shingles = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints, bits=3):
    """Least member of each print's class, every pair compared."""
    at = sorted(set(prints))
    root = {x: x for x in at}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    array = np.array(at, np.uint64)
    for x in at:
        for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(x)) <= bits):
            a, b = find(x), find(at[j])
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in at}


def expected_components(rows):
    """(id, text) -> sorted (id, print, component)."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root, least = classes([p for _, p in prints]), {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=repr)


def test_simhash_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_simhash(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_components(rows)


def test_simhash_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    base = words(200, 3).split(" ")
    rows = [(n, t) for n, t in enumerate(ODD)] + [(7, ODD[7]), (None, ODD[7]), (None, "alone among the null ids")]
    for i in range(60):
        rows.append((100 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp long, component_id long")
    got = simhash.near_duplicates(docs)
    found = sorted(((r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()), key=repr)
    want = expected_components(rows)
    assert found == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.fingerprints(docs).columns == ["doc_id", "text", "fp", "component_id", "fingerprint"]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "refine": 10_000}, {"block": 16, "refine": 40}])
def test_dense_clusters_lose_no_link(spark, sizes):
    """Chains and clouds of prints inside one bucket, solved whole, in blocks and after a finer split."""
    rng = np.random.default_rng(11)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(4):  # clouds: a few free bits, so that many share every key
        center, free = int(rng.integers(0, 1 << 62)), rng.choice(64, 14, replace=False)
        for _ in range(120):
            prints.add(center ^ sum(1 << int(b) for b in free if rng.random() < 0.4))
    x = int(rng.integers(0, 1 << 62))
    for b in range(0, 60, 3):  # a chain of steps of three bits
        prints.add(x)
        x ^= 7 << b
    prints.add(x)
    for _ in range(200):
        prints.add(int(rng.integers(0, 1 << 62)))
    want = classes(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    got = {r.node & (1 << 64) - 1: r.root for r in simhash.linked(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), **sizes).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(got.get(p, signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(2)
    masks = simhash.key_masks(list(range(64)))
    for _ in range(500):
        x = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        t = next(t for t, m in enumerate(masks) if not m & x)
        inner = simhash.key_masks([p for p in range(64) if not masks[t] >> p & 1])
        assert any(not m & x for m in inner)
    assert len(masks) == 20 and all(31 <= m.bit_count() <= 33 for m in masks)


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(id, vector, label) -> sorted (id, code, error, label error), and the codebooks' digest."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, w)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for at in range(rounds + 1):
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        for p in range(parts if at < rounds else 0):
            for e in set(code[:, p]):
                mine = cut[code[:, p] == e, p].tolist()
                books[p, e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    error = d.min(axis=2).sum(axis=1).tolist()
    total = {}
    for (_, _, label), x in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + x
    out = [(r[0], "".join(f"{c:02x}" for c in cs), x, total[r[2]]) for r, cs, x in zip(kept, code, error, strict=True)]
    return sorted(out, key=repr), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(frame, **how):
    out, books = codes.compress(frame, **how)
    rows = sorted(((r.vec_id, "".join(f"{c:02x}" for c in r.code), r.error, r.label_error) for r in out.collect()), key=repr)
    return rows, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def test_codes_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = plain_codes(rows)
    got = queries.op12_vector_codes(spark, sf)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((*r, digest) for r in want), key=repr)


def test_codes_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES["op12_vector_codes"]).fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.op12_vector_codes(spark, sf).collect()), key=repr) == want


def test_codes_odd_rows(spark):
    rng = np.random.default_rng(4)
    grid = rng.integers(-2, 3, (300, 12)) / 1024  # few values: many ties
    rows = [(int(i), [float(x) for x in v], None if i % 5 == 0 else int(i) % 3) for i, v in enumerate(grid)]
    rows += [(None, rows[3][1], 1), (7, rows[8][1], 1), (7, rows[8][1], 1), (900, None, 1), (901, [None] * 12, 1), (902, [float("nan")] * 12, 1), (903, [float("-inf")] + [0.0] * 11, 1), (904, [-3.75] * 12, None)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    for entries in (256, 1000, 3):
        assert coded(frame, entries=entries) == plain_codes(rows, entries=entries)
    assert coded(frame.limit(0))[0] == [] and coded(frame.filter("vec_id between 900 and 903"))[0] == []
    none = spark.createDataFrame([(1, [], 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert coded(none)[0] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame(bad, "vec_id long, embedding array<double>, label int"))


@pytest.mark.parametrize("width", [1, 2, 3, 5, 16, 64])
def test_bounds_are_conservative(width):
    rng = np.random.default_rng(width)
    centers = rng.normal(0, 3000, (12, width))
    v = np.rint(centers[rng.integers(0, 12, 700)] + rng.normal(0, 300, (700, width))).astype(np.int64)
    book = np.concatenate([v[:200], v[:20], np.zeros((1, width), np.int64)])
    index, distance, exact = codes.nearest(v, book)
    d = ((v[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    a, b = codes.Bounds(v), codes.Bounds(book)
    bounds = [codes._bound(a, b, k) for k in range(len(a.levels))]
    assert all((x <= d).all() for x in bounds)
    assert width == 1 or exact < 0.5 * d.size


# --- periodic runs


def plain_runs(ws, least=24, times=3):
    """(start, length, period) by definition: for each period the maximal stretches that match themselves."""
    found = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(ws)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in dropped))


def test_runs_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in rows)


def test_runs_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = list(enumerate(ODD)) + [(None, "a b " * 30), (5, "a b " * 30), (5, "a b " * 30)]
    rows += [(100 + n, " ".join(rng.choice(["a", "b"], 60 + n))) for n in range(60)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, runs int, start int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_row(*r) for r in rows), key=repr)
    out = periods.find_runs(docs)
    assert out.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    assert [r.collapsed for r in out.filter("text is null").collect()] == [None]
    assert periods.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, times=1)


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (9, 4), (2, 2)])
def test_runs_of_many_documents_at_once(least, times):
    rng = np.random.default_rng(least)
    documents = [[], ["x"], ["x"] * 50]
    for n in range(150):
        unit = rng.choice(list("abc"[: 1 + n % 3]), 1 + n % 17).tolist()
        documents.append([*rng.choice(list("abcd"), n % 11).tolist(), *(unit * (2 + n % 9)), *unit[: n % 5], *rng.choice(list("abcd"), n % 7).tolist()])
    got = periods.runs_of(documents, least, times)
    assert [[tuple(r) for r in x.tolist()] for x in got] == [plain_runs(d, least, times) for d in documents]


def test_a_very_long_text():
    rng = np.random.default_rng(1)
    ws = rng.integers(0, 5000, 200_000).tolist()
    ws[50_000:110_000] = (ws[50_000:70_000] * 3)[:60_000]
    ws[150_000:150_100] = [7] * 100
    got = [tuple(r) for r in periods.runs_of([ws, ws[:100]])[0].tolist()]
    assert len(got) == 2 and got[0][2] == 20_000 and got[0][1] >= 60_000 and got[1][2] == 1 and got[1][1] >= 100
