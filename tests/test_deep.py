"""The slow path on literal rows, and marginal relevance against a plain loop."""

import numpy as np
import pytest

from lodestone.operators import deep, gates, retrieval

P = "query int, ord int, source string, chunk int, text string, score double, dense double"


def test_rerank(spark):
    calls = []

    def model():
        def score(questions, texts):
            assert len(questions) <= 2
            return np.array([float(len(t)) - 3 for t in texts])

        return score

    rows = [(1, 1, "a", 1, "xxx", 0.5, 0.9), (1, 2, "a", 2, "xxxx", 0.4, None), (1, 3, "a", 3, None, 0.3, 0.7), (1, 4, "b", 1, "yyyy", 0.2, 0.6), (2, 1, "a", 1, "x", 0.1, None)]
    passages = spark.createDataFrame(rows, P)
    asked = spark.createDataFrame([(1, "q"), (2, None), (3, "no passages")], "query int, text string")
    got = [tuple(r) for r in deep.rerank(passages, asked, model, 3, 2).orderBy("query", "ord").select("query", "ord", "source", "chunk", "rerank_score", "score", "vector_score").collect()]
    assert got == [(1, 1, "a", 2, 0.7311, 0.7311, None), (1, 2, "b", 1, 0.7311, 0.7311, 0.6), (1, 3, "a", 1, 0.5, 0.5, 0.9), (2, 1, "a", 1, 0.1192, 0.1192, None)]
    loose = deep.rerank(passages, asked, model, 9, 2, dense_only=False)
    assert {(r.query, r.ord): r.vector_score for r in loose.collect()}[1, 1] == 0.4
    assert calls == []
    share = deep.lexical_model()(["Один два", "", "ab"], ["ДВА три", "x", None])
    assert share.tolist() == [0.0, -4.0, -4.0]


def plain_mmr(rows, k, weight=0.7):
    if len(rows) <= k:
        return [r[1] for r in rows]
    left, out = list(rows), []
    for _ in range(k):
        best, top = None, -1.0
        for r in left:
            share = sum(o[2] == r[2] for o in out) / len(out) if out else 0.0
            value = weight * r[3] - (1 - weight) * share
            if value > top:
                best, top = r, value
        if best is None:
            break
        left.remove(best)
        out.append(best)
    return [r[1] for r in out]


def test_mmr_with_a_room_of_its_own(spark):
    rng = np.random.default_rng(2)
    rows, room = [], {}
    for q in range(30):
        room[q] = int(rng.integers(0, 9))
        for o in range(int(rng.integers(1, 15))):
            rows.append((q, o, f"d{o}", f"f{rng.integers(0, 3)}", float(rng.integers(-20, 10)) / 4 if q % 3 else float(rng.integers(0, 3)) / 2, room[q]))
    frame = spark.createDataFrame(rows, "query int, ord int, doc string, family string, relevance double, room int")
    got = {}
    for r in retrieval.mmr(frame, "room").orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.doc)
    for q in room:
        want = plain_mmr([r[1:5] for r in rows if r[0] == q], room[q])
        assert got.get(q, []) == want
    fixed = {}
    for r in retrieval.mmr(frame, 4).orderBy("query", "rank").collect():
        fixed.setdefault(r.query, []).append(r.doc)
    assert fixed == {q: plain_mmr([r[1:5] for r in rows if r[0] == q], 4) for q in room}


def test_anchors_stay_at_the_head(spark):
    simple = spark.createDataFrame([(1, n, "s", n) for n in range(1, 15)] + [(2, 1, "s", 1)], "query int, ord int, source string, chunk int")
    rows = [(1, n, "s" if n % 2 else f"t{n}", 10 + n, 0.9 - n / 100, None, 0.1) for n in range(1, 25)] + [(2, 1, "s", 1, 0.5, None, 0.1)]
    found = spark.createDataFrame(rows, "query int, ord int, source string, chunk int, rerank_score double, vector_score double, score double")
    got = [(r.query, r.source, r.chunk) for r in deep.merge_with_anchors(simple, found, 12, 24).orderBy("query", "ord").collect()]
    assert got[:12] == [(1, "s", n) for n in range(1, 13)] and len(got) == 24 == len(set(got))
    pool = [(n, ("s" if n % 2 else f"t{n}", 10 + n), "s" if n % 2 else f"t{n}", 0.9 - n / 100) for n in range(1, 25) if not (n % 2 and 10 + n <= 12)]
    assert [g[1:] for g in got[12:]] == plain_mmr(pool, 12)


Q, LIST = "альфа бета", "перечислите альфа бета"


@pytest.mark.parametrize(
    "question,candidates,prior,want,rejected",
    [
        # (place, score, number of passages, text of all); what was taken and what was looked at before
        (Q, {0: (0.9, 8, "альфа бета"), 1: (0.9, 9, "альфа бета")}, 8, ("merged", "generate", "complex_sufficient", 8), []),
        (Q, {0: (0.9, 2, "альфа бета"), 1: (0.1, 9, "альфа бета"), 2: (0.9, 8, "альфа бета")}, 8, ("fallback_snapshot", "generate", "complex_fallback_accepted", 8), ["last_attempt", "merged"]),
        (Q, {0: (0.9, 8, "альфа бета пункт 77"), 1: (0.9, 8, "альфа бета")}, 8, ("last_attempt", "generate", "complex_sufficient", 8), ["merged"]),
        (Q, {0: (0.8, 8, "альфа бета пункт 77"), 1: (0.9, 8, "альфа бета пункт 78"), 2: (0.9, 9, "альфа бета пункт 79")}, 8, ("fallback_snapshot", "generate", "refs_best_effort", 9), ["last_attempt", "merged"]),
        (Q, {0: (0.9, 8, "альфа бета пункт 77"), 1: (0.9, 8, "альфа бета пункт 78")}, 8, ("merged", "generate", "refs_best_effort", 8), ["last_attempt"]),
        (LIST, {0: (0.9, 8, "альфа бета перечислите")}, 8, ("merged", "generate", "enumeration_best_effort", 8), []),
        (LIST, {0: (0.9, 9, "альфа бета перечислите")}, 8, ("merged", "generate", "complex_sufficient", 9), []),
        (LIST, {0: (0.9, 9, "альфа бета перечислите")}, 0, ("merged", "generate", "enumeration_best_effort", 9), []),
        (LIST, {0: (0.9, 8, "альфа бета перечислите пункт 77")}, 8, (None, "abstain", "complex_exhausted", 0), ["merged"]),
        (Q, {0: None, 1: (0.9, 8, "гамма")}, 8, (None, "abstain", "complex_exhausted", 0), ["last_attempt", "merged"]),
    ],
)
def test_queue(spark, question, candidates, prior, want, rejected):
    queue = spark.createDataFrame([(5, p, deep.ORIGINS[p], "ok") for p in candidates], "query int, place int, origin string, pack_status string")
    rows = [(5, p, n + 1, f"s{n % 4}", n, c[2] if n == 0 else "прочее", c[0] if n == 1 else None) for p, c in candidates.items() if c for n in range(c[1])]
    contexts = spark.createDataFrame(rows, "query int, place int, ord int, source string, chunk int, text string, score double")
    before = spark.createDataFrame([(5, f"s{n % 4}", n) for n in range(prior)], "query int, source string, chunk int")
    decided, lost = deep.complex_queue(queue, contexts, spark.createDataFrame([(5, question)], "query int, text string"), before)
    assert [tuple(r) for r in decided.collect()] == [(5, *want)]
    assert sorted(r.origin for r in lost.collect()) == rejected


def test_degraded_packing_is_no_best_effort(spark):
    queue = spark.createDataFrame([(1, 0, "merged", "degraded")], "query int, place int, origin string, pack_status string")
    contexts = spark.createDataFrame([(1, 0, n + 1, f"s{n % 4}", n, "альфа бета", 0.9) for n in range(9)], "query int, place int, ord int, source string, chunk int, text string, score double")
    decided, lost = deep.complex_queue(queue, contexts, spark.createDataFrame([(1, Q)], "query int, text string"), contexts.select("query", "source", "chunk"))
    assert decided.first().reason == "complex_exhausted" and lost.first().unmet == [gates.REFS]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_in_blocks_with_ties(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[200:] = x[rng.integers(0, 40, 100)]  # copies: ties go to the smaller document
    x[7] = 0
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.filter("vec_id % 3 = 0")
    want = {}
    for q in range(0, 300, 3):
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
        d = np.linalg.norm(x - x[q], axis=1) if metric == "l2" else 1 - np.divide(x @ x[q], norms, out=np.zeros(300), where=norms > 0)
        want[q] = sorted((round(float(v), 6), i) for i, v in enumerate(np.round(d, 9)))[:5]
    for size in (4096, 30):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", size)
        got = {}
        for r in retrieval.nearest(rows, asked, 5, metric).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((round(r.distance, 6), r.doc))
        assert {q: sorted(v) for q, v in got.items()} == want
    assert retrieval.nearest(rows, asked.limit(0), 5, metric).count() == 0


def test_best_candidate(spark):
    rows = [(1, 0, True, 0.5, 9), (1, 1, True, 0.7, 2), (1, 2, True, 0.7, 3), (1, 3, True, 0.7, 3), (1, 4, False, 0.9, 9), (2, 0, False, 0.9, 9)]
    found = gates.best_candidate(spark.createDataFrame(rows, "query int, place int, accepted boolean, top_score double, n_passages int"))
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
