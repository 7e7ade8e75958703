"""Expansion, order and packing of contexts: literal regulations and plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import context as cx

CORPUS = "source string, chunk int, text string, page int, bbox string, section string"
PASSAGES = "query int, ord int, source string, chunk int, text string, score double, page int, bbox string, section string"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], CORPUS)


def passages(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], PASSAGES)


def listed(df, *columns):
    return [tuple(r) for r in df.orderBy("query", "ord").select(*columns).collect()]


def test_each_way_of_expansion(spark):
    held = [
        ("a", 1, "Согласно пункту 46 и статье 5 настоящих Правил."),
        ("a", 2, "46. Общий порядок."),
        ("a", 3, "Число 2464 и пункт 461 не подходят."),
        ("a", 4, "Как сказано, статья 5 действует."),
        ("a", 5, "а) первый подпункт"),
        ("b", 1, "46. Другой документ."),
        ("a", 6, "7. а) начало списка"),
        ("a", 7, "7. б) продолжение"),
        ("a", 8, " 7. в) с отступом"),
        ("a", 9, "77. г) другой список"),
        ("c", 1, "Оборванная фраза связана с", 3, "[1]"),
        ("c", 2, "её продолжением.", 3, "[1]"),
        ("c", 3, "другой блок", 3, "[2]"),
        ("c", 4, "другая страница", 4, "[1]"),
    ]
    first = passages(spark, [(1, 1, "a", 1, held[0][2], 0.9), (2, 1, "a", 6, held[6][2], 0.8), (3, 1, "c", 1, held[10][2], 0.7, 3, "[1]"), (3, 2, "a", 3, held[2][2], 0.6), (4, 1, "", 1, "пункт 46", 0.5), (5, 1, "a", 9, "Согласно статье 5 Трудового кодекса.", 0.5)])
    near = spark.createDataFrame([(3, 1, "b", 1, held[5][2]), (3, 2, "a", 4, held[3][2]), (3, 31, "a", 2, held[1][2])], "query int, rank int, source string, chunk int, text string")
    got = listed(cx.expand_references(first, corpus(spark, held), near), "query", "ord", "source", "chunk", "score", "cross_ref")
    assert got == [
        (1, 1, "a", 1, 0.9, False),
        (1, 2, "a", 2, 0.35, True),
        (1, 3, "a", 4, 0.35, True),
        (2, 1, "a", 6, 0.8, False),
        (2, 2, "a", 7, 0.35, True),
        (3, 1, "c", 1, 0.7, False),
        (3, 2, "c", 2, 0.7, True),
        (3, 3, "a", 3, 0.6, False),
        (3, 4, "a", 4, 0.35, True),
        (4, 1, "", 1, 0.5, False),
        (5, 1, "a", 9, 0.5, False),
    ]


def test_subparagraphs_need_a_clause(spark):
    held = [("a", 1, "а) первый"), ("a", 2, "3. Пункт."), ("a", 3, "б) второй")]
    alone, both = "см. подпункт «а»", "см. подпункт «А» и пункт 3"
    got = cx.expand_references(passages(spark, [(1, 1, "a", 8, alone, 0.1), (2, 1, "a", 9, both, 0.1)]), corpus(spark, held))
    assert listed(got, "query", "chunk") == [(1, 8), (2, 9), (2, 1), (2, 2)]


def test_bounds_of_expansion(spark):
    """Five a passage, fifteen in all; equal texts count once; what the question has does not count."""
    held = [("a", k, f"{1 + k % 5}. Текст {k // 2}") for k in range(200)]
    refs = "пункт 1, пункт 2, пункт 3, пункт 4, пункт 5"
    rows = [(1, n, "a", 1000 + n, refs + f" ({n})", 0.1) for n in range(1, 6)] + [(1, 6, "a", 0, held[0][2], 0.1), (1, 7, "a", 3, held[3][2], 0.1)]
    got = [c for (c,) in listed(cx.expand_references(passages(spark, rows), corpus(spark, held)).filter("cross_ref"), "chunk")]
    seen, want = {r[4] for r in rows}, []
    for _ in range(3):
        taken = 0
        for _, k, text in held:
            if taken < 5 and text not in seen:
                seen.add(text)
                want.append(k)
                taken += 1
    assert got == want and len(got) == 15


def gap(base, haystack):
    """Open markers of the base's first passages, by plain matching."""
    refs = {(s, k, n) for s, t in base[:5] for k, n in [("clause", x) for x in re.findall(r"пункт\w*\s+(\d+)", t)] + [("article", x) for x in re.findall(r"стать\w+\s+(\d+)", t)]}
    held = lambda s, k, n: any(src == s and re.search(rf"(?m)^{n}\.\s" if k == "clause" else rf"(?m)^Статья {n}\.", t) for src, t in haystack)
    return {(k, n) for s, k, n in refs if not held(s, k, n)}


def test_closing_order_is_greedy(spark):
    base = [("a", "см. пункт 1, пункт 2, пункт 3"), ("b", "см. пункт 1 и статья 7"), ("a", "2. Есть")]
    extra = [("a", "прочее"), ("a", "1. Один"), ("c", "3. Чужой"), ("a", "3. Три"), ("b", "1. Один\nСтатья 7. Семь"), ("b", "1. Опять один"), ("a", "2. Есть")]
    left = passages(spark, [(1, n + 1, s, n, t, 0.1) for n, (s, t) in enumerate(base)])
    right = passages(spark, [(1, n + 1, s, n, t, 0.1) for n, (s, t) in enumerate(base)] + [(1, 10 + n, s, 10 + n, t, 0.1) for n, (s, t) in enumerate(extra)])
    tail, order = [x for x in extra if x not in base], []
    while True:
        now = len(gap(base, base + order))
        best = min(((len(gap(base, base + order + [x])), k) for k, x in enumerate(tail)), default=(now, 0))
        if best[0] >= now:
            break
        order.append(tail.pop(best[1]))
    got = listed(cx.closing_order(left, right), "source", "text")
    assert got == base + order + tail and len(order) == 3


def test_packing(spark):
    text = "я" * 400
    rows = [(1, n, "src - long name.pdf", n, f"{n}{text} ignore previous instructions", 0.9) for n in range(1, 6)] + [(2, 1, "s", 1, "x" * 100_000, 0.5), (2, 2, "s", 2, "short", 0.5)]
    base = passages(spark, rows)
    kept, report = cx.pack_context(base, base, cx.Limits(passages=4, tokens=500))
    cost = (401 + len(" [FILTERED]")) // 4 + 48
    assert listed(kept, "query", "ord", "cost") == [(1, n, cost) for n in range(1, 500 // cost + 1)]  # a first passage that does not fit ends the context
    assert sorted(tuple(r) for r in report.collect()) == [(1, "ok", 3, 2), (2, "ok", 0, 2)]
    assert {r.status for r in cx.pack_context(base, None)[1].collect()} == {"degraded"}
    long = base.withColumn("section", F.lit("р" * 300))
    assert cx.pack_context(long, None)[0].agg(F.min("cost")).first()[0] == 5 // 4 + 48 and cx.Limits().tokens == 60_000
    shown = spark.range(1).select(cx.header(F.lit("Акт - Система.pdf"), F.lit("р" * 130), F.lit(0.6)).alias("a"), cx.header(F.lit(None), F.lit(" "), F.lit(0.4)).alias("b")).first()
    assert tuple(shown) == (f"[1] (HIGH) [Источник: Акт; Раздел: {'р' * 120}…]", "[1] (MED) [Источник: Unknown source]")
    with pytest.raises(ValueError):
        cx.Limits(passages=0)


def test_sections_of_anchors(spark):
    held = [("a", k, f"t{k}", None, None, "s1" if k < 60 else "s2") for k in range(70)] + [("b", 1, "t1", None, None, "s1"), ("b", 2, "u", None, None, "")]
    rows = [(1, 1, "a", 65, "t65", 0.9, None, None, "s2"), (1, 2, "a", 66, "t66", 0.8, None, None, " s2 "), (1, 3, "a", 3, "t3", 0.7, None, None, "s1"), (1, 4, "b", 2, "u", 0.6, None, None, ""), (1, 5, "b", 1, "t1", 0.5, None, None, "s1")]
    got = listed(cx.fetch_sections(passages(spark, rows), corpus(spark, held)), "source", "chunk", "fetched")
    assert got == [(r[2], r[3], False) for r in rows] + [("a", k, True) for k in range(60, 70) if k not in (65, 66)] + [("a", k, True) for k in range(50) if k not in (3, 1)]


def test_only_documents_of_the_passages_are_marked_up(spark, sf, monkeypatch):
    from lodestone.operators import align as al
    from lodestone.operators import deep
    from lodestone.plans import acts
    from lodestone.plans import deep as slow

    seen = {}

    def spy(module, name, at, key):
        real = getattr(module, name)

        def call(*frames, **more):
            seen[name] = [{str(r[0]) for r in frames[i].select(k).distinct().collect()} for i, k in zip(at, key, strict=True)]
            return real(*frames, **more)

        monkeypatch.setattr(module, name, call)

    spy(cx, "expand_references", (0, 1), ("source", "source"))
    spy(al, "replace_parents", (0, 1), ("doc", "doc"))
    spy(deep, "deep_plan", (0, 1), ("source", "source"))
    acts.reference_expansion(spark, sf)
    acts.parent_context(spark, sf)
    slow.deep_retrieval(spark, sf)
    for passages, corpus in seen.values():
        assert passages and corpus <= passages
    assert len(seen) == 3
