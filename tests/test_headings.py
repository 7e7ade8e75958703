"""Articles and parts that are carried on, and matching by words: literal rows and plain loops."""

import re
from fractions import Fraction

import numpy as np
import pytest

from lodestone.operators import headings as hd
from lodestone.operators import matching as mt


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_an_article_goes_on_under_its_headings(spark, block):
    long = "Статья 9. " + "слово " * 60
    rows = [
        (0, ["Глава 1"], "до всех статей"),
        (1, ["Глава 1"], "конец.\nСтатья 5. Пятая\nтело"),
        (2, ["Глава 1"], "продолжение"),
        (3, ["Глава 2"], "другая глава"),
        (4, ["Глава 1", "Статья 1. Первая"], "под заголовком"),
        (5, ["Глава 1"], "Статья  6.  Шестая\nи\nСтатья 7."),
        (6, ["Глава 1"], "всё ещё"),
        (7, ["Глава 1", "Статья 1. Первая"], "текст\nСтатья 2. Вторая тело"),
        (8, ["Глава 1", "Статья 1. Первая"], "далее"),
        (9, [], long),
        (10, [], None),
    ]
    got = {r.ord: (r.headings, r.opens) for r in hd.resolve_articles(spark.createDataFrame([("d", *r) for r in rows], "doc string, ord int, headings array<string>, text string"), block).collect()}
    title = " ".join(long.split())[:200].rsplit(" ", 1)[0] + "…"
    assert got == {
        0: (["Глава 1"], False),
        1: (["Глава 1"], False),
        2: (["Глава 1", "Статья 5. Пятая"], False),
        3: (["Глава 2"], False),
        4: (["Глава 1", "Статья 1. Первая"], False),
        5: (["Глава 1", "Статья 6. Шестая"], True),
        6: (["Глава 1", "Статья 7."], False),
        7: (["Глава 1", "Статья 1. Первая"], False),
        8: (["Глава 1", "Статья 2. Вторая тело"], False),
        9: ([title], True),
        10: ([title], False),
    }


def test_parts_of_articles(spark):
    rows = [
        (0, "Глава 1", "нет статьи\n1. Часть"),
        (1, "Глава 14 Статья 300. > Статья 5. Пять", "Статья 5. Пять\n1. Первая часть\nа) x\n2.  Вторая"),
        (2, "Статья 5. Пять", "продолжение второй"),
        (3, "Статья 6. Шесть", "без частей"),
        (4, "Статья 5. Пять", "и ещё\n3."),
        (5, "Статья 5. Пять", "Текст третьей. 9. а) не часть\n4. международного"),
        (6, "Статья 7.1. Семь", "до первой части"),
        (7, "Статья 7.1. Семь", "2.1.\nТекст"),
        (8, None, None),
    ]
    out = hd.annotate_parts(spark.createDataFrame([("d", *r) for r in rows], "doc string, ord int, heading_path string, text string"), 2)
    assert out.columns == ["doc", "ord", "heading_path", "text", "article", "part", "part_inherited", "part_end"]
    got = {r.ord: (r.article, r.part, r.part_inherited, r.part_end) for r in out.collect()}
    assert got == {
        0: (None, None, None, None),
        1: ("5", "1", False, "2"),
        2: ("5", "2", True, "2"),
        3: ("6", None, None, None),
        4: ("5", "2", True, "3"),
        5: ("5", "3", True, "3"),
        6: ("7.1", None, None, None),
        7: ("7.1", "2.1", False, "2.1"),
        8: (None, None, None, None),
    }


def bag(text):
    return set(re.findall(r"[а-яёa-z0-9]{4,}", (text or "").lower()))


def test_labels_to_a_new_snapshot(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"слово{k}" for k in range(60)]
    old, new = [], []
    for s in range(6):
        texts = [" ".join(rng.choice(vocabulary, 18)) for _ in range(12)]
        old += [(f"s{s}", n, t) for n, t in enumerate(texts)] + [(f"s{s}", 90, "a b"), (f"s{s}", 91, None)]
        for n, t in enumerate(texts):
            ws = t.split()
            new += [[(f"s{s}", n + 3, "  ".join(ws)), (f"s{s}", n + 40, " ".join(ws))], [(f"s{s}", n + 3, " ".join(ws[:9])), (f"s{s}", n + 60, " ".join(ws[9:]))], [(f"s{s}", n + 3, " ".join(ws[:16] + ["прочее"] * 30) + " " + " ".join(f"новое{n}{k}" for k in range(30)))]][n % 3]
    kinds = set()
    want = {}
    for s, num, text in old:
        there = {n: t for x, n, t in new if x == s}
        same = [n for n, t in there.items() if " ".join(t.split()) == " ".join((text or "").split())]
        df = {}
        for t in there.values():
            for w in bag(t):
                df[w] = df.get(w, 0) + 1
        rare = {n: {w for w in bag(t) if df[w] * 10 <= len(there)} for n, t in there.items()}
        own = {w for w in bag(text) if df.get(w, 0) * 10 <= len(there)}
        split = sorted(n for n, b in rare.items() if len(b) >= 5 and Fraction(len(b & own), len(b)) >= Fraction(6, 10))
        best = min(rare, key=lambda n: (-len(rare[n] & own), n))
        if same:
            want[s, num] = ([min(same, key=lambda n: (abs(n - num), n))], "exact")
        elif not own:
            want[s, num] = ([], "no-words")
        elif split:
            want[s, num] = (split, "split")
        else:
            want[s, num] = ([best], "merge") if Fraction(len(rare[best] & own), len(own)) >= Fraction(8, 10) else ([], "unmapped")
        kinds.add(want[s, num][1])
    frame = lambda rows: spark.createDataFrame(rows, "source string, num long, text string")
    got = {(r.source, r.num): (r.targets, r.kind) for r in mt.remap_labels(frame(old + old[:2]), frame(new)).collect()}
    assert got == want and kinds == {"exact", "no-words", "split", "merge", "unmapped"}


def test_units_by_margin(spark):
    units = [("d", "u1", "альфа бета гамма дельта эпсилон"), ("d", "u2", "альфа бета гамма дельта сигма омега длиннее"), ("d", "u3", "прочие слова"), ("e", "v1", "только одна единица")]
    texts = [(1, "d", "альфа бета гамма дельта"), (2, "d", "альфа бета гамма дельта эпсилон"), (3, "d", "до"), (4, "d", "альфа совсем другое"), (5, "e", "только одна единица"), (6, "f", "нигде такого"), (7, "d", "альфа бета гамма дельта эпсилон зета1 эта11 тета1 йота1 сигма")]
    got = {r.id: (r.unit, round(r.score, 3), round(r.second, 3), r.reason) for r in mt.match_units(spark.createDataFrame(texts, "id int, doc string, text string"), spark.createDataFrame(units, "doc string, unit string, text string")).collect()}
    assert got == {1: (None, 1.0, 1.0, "ambiguous"), 2: ("u1", 1.0, 0.8, None), 3: (None, 0.0, 0.0, "empty_words"), 4: (None, 0.333, 0.333, "below_threshold"), 5: ("v1", 1.0, 0.0, None), 6: (None, 0.0, 0.0, "below_threshold"), 7: (None, 0.5, 0.5, "below_threshold")}


def test_remapping_meets_words_in_the_task(spark, monkeypatch):
    """Each chunk's words are exchanged once; long sources, dealt by word, give the same rows."""
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(40)]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 12)))
    old = [(s, k, text()) for s in ("a", "b", "c") for k in range(30)]
    new = [(s, k + int(rng.integers(-1, 2)) * 3, "  " + t if rng.random() < 0.5 else " ".join(t.split()[: int(rng.integers(1, 9))])) for s, k, t in old if rng.random() < 0.8]
    new = list({(s, k): (s, k, t) for s, k, t in new if s != "c"}.values())
    old += old[:3] + [(None, 1, "word1 word2"), ("d", 7, None)]
    frame = lambda rows: spark.createDataFrame(rows, "source string, num int, text string")
    rows = lambda: sorted((repr(tuple(r)) for r in mt.remap_labels(frame(old), frame(new)).collect()))
    whole = rows()
    assert {k for k in ("exact", "split", "merge", "no-words", "unmapped") if any(k in r for r in whole)} == {"exact", "split", "merge", "no-words", "unmapped"}
    known = [r for r in old if r[0]]
    plan = mt.remap_labels(frame(known), frame(new))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    monkeypatch.setattr(mt, "MEETING", 5, raising=False)
    assert rows() == whole
    monkeypatch.setattr(mt, "WHOLE", 300, raising=False)  # some sources are longer
    assert rows() == whole
    monkeypatch.setattr(mt, "WHOLE", -1, raising=False)
    assert rows() == whole


def test_units_meet_texts_in_the_task(spark, monkeypatch):
    """Texts are exchanged once and their words never; long documents, dealt by word, give the same rows."""
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(24)]
    said = lambda n: " ".join(rng.choice(words, int(n)))
    docs = [f"d{k}" for k in range(12)]
    units = [(d, f"u{k}", said(rng.integers(0, 9))) for d in docs[:10] for k in range(7)]
    texts = [(k, d, said(rng.integers(0, 6))) for d in docs for k in range(20)] + [(99, None, "word1 word2"), (98, "d1", None)]
    frames = spark.createDataFrame(texts, "id int, doc string, text string"), spark.createDataFrame(units, "doc string, unit string, text string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    known = frames[0].filter("doc is not null")
    plan = mt.match_units(known, frames[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    got = rows(mt.match_units(*frames))
    monkeypatch.setattr(mt, "WHOLE", 150)
    mixed = rows(mt.match_units(*frames))
    monkeypatch.setattr(mt, "WHOLE", -1)
    monkeypatch.setattr(mt, "MEETING", 5)
    assert got == mixed == rows(mt.match_units(*frames)) and len(got) == 242
    assert {r[5] for r in got} == {None, "empty_words", "below_threshold", "ambiguous"}
