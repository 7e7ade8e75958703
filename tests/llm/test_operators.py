"""Operators that move rows: against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint, graph, jaccard, lines, mixing, pieces, queries, shards
from tests.llm import brute

SCHEMA = "doc_id long, text string, shard int, n_removed int"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = words(120, 1).split(" ")
    for i in range(40):  # near copies, some beyond the threshold
        edited = list(base)
        for at in rng.choice(len(base), i % 5, replace=False):
            edited[at] = f"x{i}"
        rows.append((10_000 + i, " ".join(edited)))
    rows += [(20_000 + i, base_text) for i, base_text in enumerate([" ".join(base)] * 30)]
    rows += [(None, "one"), (30_000, None), (30_001, ""), (30_002, " \t\n"), (30_003, "Two words"), (30_004, "two\tWORDS"), (30_005, "A b c d"), (30_006, "a b c d e")]
    rows += [(30_007, words(5000, 7)), (30_007, words(5000, 7)), (5, "other text of a known id")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in texts], SCHEMA)


def shingles(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOW))
    return frozenset(tuple(ws[j : j + 4]) for j in range(len(ws) - 3)) if len(ws) >= 4 else frozenset([tuple(ws)] if ws else [])


def joined(texts):
    """(id, text) -> (n, component), by comparing every pair of sets that share a shingle."""
    sets = {(i, t): shingles(t) for i, t in texts}
    node = defaultdict(list)
    for (i, _), s in sets.items():
        node[s].append(i)
    keys = [s for s in node if s]
    parent = {s: s for s in keys}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    held = defaultdict(list)
    for s in keys:
        for t in s:
            held[t].append(s)
    for s in keys:
        for o, n in Counter(o for t in s for o in held[t] if o is not s).items():
            if 100 * n >= 85 * (len(s) + len(o) - n):
                parent[find(s)] = find(o)
    least = defaultdict(list)
    for s in keys:
        least[find(s)] += [i for i in node[s] if i is not None]
    return {k: (len(s), min(least[find(s)], default=None) if s else k[0]) for k, s in sets.items()}


def test_jaccard_join(docs, texts):
    want = Counter((i, *joined(texts)[i, t]) for i, t in texts)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect())
    assert got == want


def test_jaccard_join_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    want = Counter((i, *joined(texts)[i, t]) for i, t in texts)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()) == want
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    far = [words(60, s) for s in (41, 42, 43)]
    rows = [
        (1, far[0], "b"), (1, far[0], "a"),  # rows equal in id and text: the least of them
        (2, far[0], "a"), (None, far[0] + " end", "a"),  # copies with larger ids, or none
        (1, far[1], "c"),  # another text of the same id
        (None, far[2], "a"), (None, words(60, 44), "a"),  # different texts without an id
        (7, None, "a"), (8, "", "a"), (8, "", "a"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_shingles int")
    got = Counter((r.doc_id, r.text, r.lang) for r in jaccard.one_of_each(df).collect())
    assert got == Counter([rows[1], rows[4], rows[5], rows[6], rows[7], rows[8]])
    assert jaccard.one_of_each(df.limit(0)).count() == 0 and jaccard.one_of_each(df).columns == df.columns


def test_bound_is_a_bound():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 40, 200)
    points = np.array([np.bincount(rng.integers(0, jaccard.DIMS, k), minlength=jaccard.DIMS) for k in n], np.int32)
    i, j, bound = jaccard.rtree_pairs(n, points, np.arange(200), np.zeros(200, int), 85)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    exact = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if exact[a, b] >= -(-(n[a] + n[b]) * 85 // 185)}
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 9), (9, 8), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 7)}, 8: 8, 9: 8, 10: 8, 7: 7}


@pytest.mark.parametrize("part_bytes", [shards.PART_BYTES, 2000])
def test_shards(docs, texts, part_bytes):
    out = shards.shard(docs, 8, payload=["doc_id", "text"], part_bytes=part_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(texts)
    by = defaultdict(list)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 1
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    largest = max(r.size for r in out)
    mean = sum(r.size for r in out) / 8
    assert all(abs(sum(r.size for r in by[s]) - mean) <= 2 * largest + 0.02 * mean for s in range(8))
    assert shards.shard(docs.limit(0)).count() == 0


def test_shards_split_one_hot_text(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    counts = [r["count"] for r in shards.shard(df).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 20
    same = df.withColumn("doc_id", F.lit(7))  # rows that are equal in all
    assert shards.shard(same).groupBy("shard").count().count() == 8


def test_shard_query(spark, sf):
    got = {r.doc_id: r.text_crc32 for r in queries.op6_shards(spark, sf).collect()}
    assert got == {r.doc_id: zlib.crc32((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_fingerprints(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", 20_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-5, None), (100_000, ""), (100_001, "ab"), (100_002, words(4000, 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint.neighbour_fingerprints(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(out) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        tail = len(t) // 4
        edited = t[: len(t) - tail] + following[:tail]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(fingerprint.sketch, (t, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.written(a), fingerprint.written(b))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    assert fingerprint.neighbour_fingerprints(df.limit(0)).count() == 0
    one = fingerprint.neighbour_fingerprints(df.filter("doc_id = 100001")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_tell_edits_and_order():
    text = words(400, 4)
    ws = text.split(" ")
    few = " ".join(ws[:200] + ["new"] + ws[201:])
    moved = " ".join(ws[200:] + ws[:200])
    f = lambda t: fingerprint.likeness(fingerprint.sketch(text), fingerprint.sketch(t))
    assert f(text) == 1 and f(few) > 0.8 and f(moved) < f(few) - 0.2 and f(words(400, 5)) < 0.1


def plain_sketch(text):
    """Order MinHash over all k-mers, numbered by occurrence in the whole text."""
    data, m = text.encode(), 1 << 64

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % m
        return x ^ (x >> 31)

    gold, seen, h = 0x9E3779B97F4A7C15, Counter(), []
    for i in range(len(data) - fingerprint.K + 1):
        gram = data[i : i + fingerprint.K]
        h.append(mix((mix((int.from_bytes(gram, "little") + gold) % m) + seen[gram] * gold) % m))
        seen[gram] += 1
    out = []
    for f, t in zip(fingerprint._FACTORS.tolist(), fingerprint._TERMS.tolist(), strict=True):
        x = 0
        for i in sorted(sorted(range(len(h)), key=lambda i: (h[i] * f + t) % m)[: fingerprint.PICKED]):
            x = mix((x * 0xBF58476D1CE4E5B9 + h[i]) % m)
        out.append(x >> 48 | 1)
    return out


def test_fingerprints_of_repetitive_long_texts(monkeypatch):
    same = "=" * 3000
    text, other = same + words(300, 61), same + words(300, 62)
    monkeypatch.setattr(fingerprint, "BLOCK", 700)
    for t in (text, words(300, 63) + same, "ab" * 2000 + words(20, 64), words(2, 65), words(400, 66)):
        assert fingerprint.sketch(t).tolist() == plain_sketch(t)
    long = words(14_000, 67) + " " + same  # beyond 2**16 k-mers
    assert fingerprint.sketch(long).tolist() == plain_sketch(long)
    f = lambda a, b: fingerprint.likeness(fingerprint.sketch(a), fingerprint.sketch(b))
    table = (words(20, 40) + " ") * 60  # four fifths of the text; few k-mers
    assert f(text, text) == 1 and f(text, other) < 0.5 and f(table + words(300, 61), table + words(300, 62)) < 0.6


def test_sentencepiece_matches_the_library(spark, sf):
    proto = pieces.read_model(pieces.public_model())
    model = pieces.Model(proto)
    rng = np.random.default_rng(1)
    odd = ["".join(rng.choice(list("ab cde▁éüñ字\n\t the  \x07😀12=--"), rng.integers(0, 60))) for _ in range(800)] + [" " * n + "x" for n in range(40)] + ["", "a" * 5000, "漢字" * 900]
    for t in odd:
        assert model.encode(t) == model.library.encode(t), t
        assert model.decode(model.encode(t)) == model.library.decode(model.library.encode(t)), t
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*odd[:50], None])], "doc_id long, text string, n_ids int")
    out = pieces.decode_ids(pieces.encode_texts(df, proto), proto).collect()
    assert all((r.ids is None) == (r.text is None) for r in out)
    assert all(r.decoded == r.text for r in out if r.text is not None and "▁" not in r.text)
    assert pieces.encode_texts(df.limit(0), proto).count() == 0


def test_streaming_search_commits_in_a_bounded_window():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pieces.read_model(pieces.public_model())
    text = "▁" + words(2000, 9).replace(" ", "")
    for kind in ("bpe", "unigram"):
        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        if kind == "unigram":
            spec.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        model = pieces.Model(spec.SerializeToString())
        trace = []
        got = list(model.search((text[i : i + 37] for i in range(0, len(text), 37)), trace))
        want = model.library.encode(text[1:], out_type=str)
        if kind == "bpe":
            assert got == want
        else:  # of paths with one score either may be taken
            total = lambda ps: sum(model.scores.get(p, model.floor) for p in ps)  # noqa: B023, E731
            assert "".join(got) == "".join(want) and abs(total(got) - total(want)) < 0.5
        assert max(trace) <= 8 * model.longest


def test_line_dedup(spark):
    passage = [words(12, 100 + i) for i in range(6)]  # 72 words
    long_line = words(60, 50)
    short = [words(5, 200), words(6, 201)]
    rows = [
        (1, "\n".join([words(30, 1), *passage, words(30, 2)])),
        (2, "\n".join([words(30, 3), "", *passage, words(30, 4), *short])),
        (3, "\n".join([*short, *passage[1:], words(30, 5)])),  # 60 words of it
        (4, "\n".join([*passage[:3], words(30, 6)])),  # 36 words: too short
        (5, long_line),
        (6, "\n".join([words(9, 7), long_line, words(9, 8), long_line])),
        (7, None),
        (8, ""),
        (None, "\n".join([words(40, 9), words(40, 10)])),
        (9, "\n".join([words(40, 9), words(40, 10)])),
    ]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_removed int")
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    text = dict(rows)
    assert out[1] == (text[1], 0) and out[4] == (text[4], 0) and out[5] == (text[5], 0) and out[None] == (text[None], 0)
    assert out[2] == ("\n".join([words(30, 3), "", words(30, 4), *short]), 6)
    assert out[3] == ("\n".join([*short, words(30, 5)]), 5)
    assert out[6] == ("\n".join([words(9, 7), words(9, 8)]), 2)
    assert out[7] == (None, 0) and out[8] == ("", 0) and out[9] == ("", 2)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def plain_dedup(rows, run_words=50):
    """(id, text) in order -> the text without the lines that lie in a run of so many words with an earlier place."""
    seen, out = set(), []
    for _, text in rows:
        ls = text.split("\n")
        at = [k for k, x in enumerate(ls) if x.strip()]
        n = [len(ls[k].split()) for k in at]
        gone = set()
        for i in range(len(at)):
            for j in range(i, len(at)):
                if sum(n[i : j + 1]) >= run_words:
                    run = tuple(ls[k] for k in at[i : j + 1])
                    if run in seen:
                        gone.update(at[i : j + 1])
                    seen.add(run)
        out.append("\n".join(x for k, x in enumerate(ls) if k not in gone))
    return out


def test_line_dedup_where_parts_occur_first_elsewhere(spark):
    frequent, second, third = words(30, 500), words(30, 501), words(8, 502)
    rows = [(i, "\n".join([words(30, 600 + i), frequent, words(30, 700 + i)])) for i in range(20)]
    rows += [(20, "\n".join([words(30, 620), second, words(30, 720)]))]
    rows += [(21, "\n".join([words(30, 621), frequent, second, words(9, 721)])), (22, "\n".join([words(30, 622), frequent, second, third, words(9, 722)]))]
    rows += [(23, "\n".join([words(9, 623), second, frequent, second, third, words(9, 723)])), (24, "\n".join([third, second, third, frequent, second, third]))]
    rng = np.random.default_rng(4)
    pool = [words(int(rng.integers(3, 32)), 800 + k) for k in range(12)]
    rows += [(100 + i, "\n".join(pool[k] for k in rng.integers(0, 12, 9))) for i in range(120)]
    rows += [(300, "\n".join([pool[0]] * 40)), (301, "\n".join(["a b"] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert frequent not in out[22] and second not in out[22] and third in out[22]
    assert [out[i] for i, _ in rows] == plain_dedup(rows)


def test_line_dedup_counts_words_between_all_blanks(spark):
    tabbed, other = words(60, 900).replace(" ", "\t"), words(55, 901).replace(" ", "\x0b \r")
    spaced = words(20, 902).replace(" ", "   ")  # 20 words, 57 spaces
    rows = [(1, tabbed), (2, "\n".join([words(9, 903), tabbed, "\t \r"])), (3, other + "\r\n" + words(9, 904)), (4, words(9, 905) + "\n" + other + "\r")]
    rows += [(5, "\n".join([spaced, words(40, 906)])), (6, "\n".join([spaced, words(40, 907)]))]
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (tabbed, 0), 2: (words(9, 903) + "\n\t \r", 1), 3: (rows[2][1], 0), 4: (words(9, 905), 1), 5: (rows[4][1], 0), 6: (rows[5][1], 0)}


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-1, "")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = mixing.mix(docs.withColumn("rate", F.lit(1)), labels).collect()
    assert len(out) == docs.count()
    total = sum(r.n_tokens for r in out)
    for k, want in enumerate(mixing.TARGETS):
        assert abs(sum(r.n_tokens * r.rate * r.posterior[k] for r in out) / total - want) < 0.01
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and abs(sum(r.posterior) - 1) < 1e-9 for r in out)
    assert all(r.rate == 1 for r in mixing.mix(docs, labels.limit(0)).collect())
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_classifier_on_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = mixing.train(docs, labels.filter(~held), "doc_id", "text")
    guess = mixing.posteriors(docs.join(labels.filter(held), "doc_id"), model).select("toxic", "quality", F.array_position("posterior", F.array_max("posterior")).alias("k")).collect()
    good = lambda r: r.toxic == 0 and r.quality == 1
    assert sum((r.k == 1) == good(r) for r in guess) / len(guess) > 0.85


def test_fingerprints_of_null_repeated_and_least_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", 40)
    ids = [None, None, -(1 << 63), -(1 << 63), 0, (1 << 60) + 1, (1 << 60) + 2, (1 << 60) + 2]
    rows = [(i, words(6, 70 + k), 1.0, "x") for k, i in enumerate(ids)] + [(0, words(6, 74), 1.0, "x")]  # a row twice
    df = spark.createDataFrame(rows, "doc_id long, text string, near_next double, fingerprint string")
    out = fingerprint.neighbour_fingerprints(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows)
    by_id = {r.doc_id: r for r in out}
    edited = rows[5][1][: 35 - 35 // 4] + rows[6][1][: 35 // 4], rows[5][1][: 35 - 35 // 4] + rows[7][1][: 35 // 4]
    assert by_id[(1 << 60) + 1].edited_sha256 in {hashlib.sha256(x.encode()).hexdigest() for x in edited}
    assert not (fingerprint.sketch("a") == fingerprint.sketch("a\0")).all() and not (fingerprint.sketch("") == fingerprint.sketch("\0")).all()
    assert fingerprint.fingerprint(df).columns == ["doc_id", "text", "near_next", "fingerprint"]


def plain_loss(p, tokens, goal, rounds=200_000):
    """The least squared residual, in the Gram matrix's metric, by plain projected gradient steps to the end."""
    w = tokens / tokens.sum()
    metric = np.linalg.inv((p * w[:, None]).T @ p)
    r = np.ones(len(p))
    for _ in range(rounds):
        after = np.maximum(0, r - p @ (metric @ ((p * (w * r)[:, None]).sum(axis=0) - goal)))
        if np.abs(after - r).max() < 1e-12:
            break
        r = after
    rest = (p * (w * r)[:, None]).sum(axis=0) - goal
    return rest @ metric @ rest, metric


@pytest.mark.parametrize("goal", [(0.94, 0.04, 0.02), (0.2, 0.3, 0.5), (0.98, 0.015, 0.005)])
def test_rates_are_the_least_squares(spark, goal):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([6, 1, 0.6], 60)
    tokens = rng.integers(1, 900, 60)
    found = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>").coalesce(1).cache()
    rates = np.array([r.rate for r in found.withColumn("rate", mixing._rate(mixing.fit(found, goal))).collect()])
    got = (p * (tokens / tokens.sum() * rates)[:, None]).sum(axis=0) - goal
    want, metric = plain_loss(p, tokens, np.array(goal))
    assert (rates >= 0).all() and got @ metric @ got <= want + 1e-4


def test_posteriors_are_those_of_the_regression(spark):
    """Weights from a plain gradient descent give the same posteriors as the trained ones, whole texts and all words counted."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 2, (90, 5)).astype(float), rng.integers(0, 3, 90)
    w = mixing._regress(x, y, 3, 0.5, rounds=3000)
    ones, v = np.hstack([x, np.ones((90, 1))]), np.zeros((6, 3))
    for _ in range(30_000):
        z = np.exp(ones @ v)
        v -= 0.01 * (ones.T @ (z / z.sum(axis=1, keepdims=True) - np.eye(3)[y]) + 0.5 * v)
    assert np.abs(w - v).max() < 1e-6
    names = [f"w{k}" for k in range(5)]
    text = " ".join(["other"] * 5000 + ["w1", "w3", "w3"])
    model = {n: w[k].tolist() for k, n in enumerate(names)}, w[-1].tolist()
    got = mixing.posteriors(spark.createDataFrame([(text,), (None,)], "text string"), model).collect()
    for r, held in zip(got, ([1, 3], []), strict=True):
        s = np.exp(w[held].sum(axis=0) + w[-1])
        assert np.allclose(r.posterior, s / s.sum())


def test_secret_index_against_plain_search(spark):
    from lodestone.llm import secrets

    rng = np.random.default_rng(12)
    bits = ["token", "tok", "en:", "ghp_", "x" * 40, "://", "me:pw@", "AKIA", "Z" * 20, "sk_live_", "a1" * 20, " ", "secret=", "eyJ", "q" * 9, ".", "é"]
    texts = ["".join(rng.choice(bits, 6)) for _ in range(300)]
    rules = (*secrets.BASE_RULES, *secrets.MORE_RULES)
    df = spark.createDataFrame([(t, 1) for t in [*texts, texts[0], None, ""]], "text string, found int")
    for bucket in (7, 4096):
        for r in secrets.scan_secrets(df, bucket=bucket).collect():
            want = []
            for o, rule in enumerate(rules):
                want += [(m.start(), o, m.end(), rule.kind) for m in re.finditer(rule.pattern, r.text or "") if len(m[rule.group]) >= rule.least]
            assert [(x.s, x.o, x.e, x.kind) for x in r.found] == sorted(want), r.text


def test_secret_candidates_are_the_texts_that_hold_the_trigrams(spark):
    from lodestone.llm import secrets

    queries_ = [secrets.trigram_query(r.pattern) for r in (*secrets.BASE_RULES, *secrets.MORE_RULES)]
    grams = sorted(set().union(*map(secrets.trigrams, queries_)))
    texts = ["a token here", "AKIA1", "nothing", "http://x", "sk_live_", "-----BEGIN PRIVATE KEY-----", "token AKIA"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    holds = lambda q, t: q[1] in t if q[0] == "tri" else (all if q[0] == "and" else any)(holds(x, t) for x in q[1])
    want = {t: sum(1 << i for i, q in enumerate(queries_) if q != secrets.ALL and holds(q, t.lower())) for t in texts}
    found = secrets.candidates(secrets.build_index(df, grams, bucket=2), queries_, grams)
    key = df.select("text", F.xxhash64("text").alias("k"))
    assert {r.text: r.rules for r in key.join(found, "k").collect()} == {t: r for t, r in want.items() if r}


def test_encoding_streams_through_a_bounded_window():
    model = pieces.Model(pieces.read_model(pieces.public_model()))
    text = words(3000, 9).replace(" ", "") + " " + words(50, 10)
    trace = []
    assert model.encode(text, trace) == model.library.encode(text)
    assert len(trace) > 15_000 // model.longest and max(trace) <= 4 * model.longest


def test_tree_decides_candidates(spark, monkeypatch):
    """Without the tree's pairs, near copies that no star edge joins stay apart."""
    rng = np.random.default_rng(21)
    n = rng.integers(60, 90, 300)
    points = np.array([np.bincount(rng.integers(0, jaccard.DIMS, k), minlength=jaccard.DIMS) for k in n], np.int32)
    order = np.lexsort((n,))
    tree = jaccard.RTree(n[order], points[order].reshape(300, jaccard.FOLDED, -1).sum(axis=2))
    assert [len(level[0]) for level in tree.levels] == [10, 3, 1]
    x, y = tree.leaf_pairs(85)
    assert (x <= y).all() and len(set(zip(x.tolist(), y.tolist(), strict=True))) == len(x) < 55
