"""Structure of regulations, prefix scans and alignment: against plain loops."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import structure as st
from lodestone.operators import align as al
from lodestone.operators import scan
from lodestone.plans import acts

LIMIT = 300


# --- plain versions, paragraph by paragraph


def py_sentences(text):
    text = " ".join(text.split())
    cuts = [0] + [m.end() for m in re.finditer(r'(?<=[.;:!?])\s+(?=[А-ЯЁ«"(0-9])', text)] + [len(text)]
    out, glue = [], False
    for a, b in itertools.pairwise(cuts):
        s = text[a:b].strip()
        if glue:
            out[-1] += " " + s
            glue = False
        elif s:
            out.append(s)
            glue = bool(re.fullmatch(r"\d+(?:\(\d+\))?(?:\.\d+)*\.", s))
    return out


def py_fill(pieces, fits, sep):
    """Greedy: a piece joins the current group if ``fits`` says so."""
    groups = []
    for p in pieces:
        if groups and fits(groups[-1], p):
            groups[-1].append(p)
        else:
            groups.append([p])
    return [sep.join(g) for g in groups]


def py_split(text, limit):
    return py_fill(py_sentences(text), lambda g, s: len(" ".join(g)) + 1 + len(s) <= limit, " ")


def py_pack(paragraphs, limit, intro=None):
    base = len(intro or "")
    pieces = [s for p in paragraphs for s in ([p] if len(p) + base <= limit else py_split(p, max(limit - base, 200)))]
    bodies = py_fill(pieces, lambda g, s: base + sum(1 + len(x) for x in g) + 1 + len(s) <= limit, "\n")
    return [f"{intro}\n{b}" if intro else b for b in bodies] or [intro or ""]


def py_units(paragraphs):
    article, item = (re.compile(x.removeprefix("(?U)")) for x in (st.ARTICLE, st.ITEM))
    heading = re.compile(st.HEADING.removeprefix("(?U)"))
    by_article = sum(bool(article.match(p)) for p in paragraphs) > 1
    rx, out, above = article if by_article else item, [["preamble", "", "", "", []]], ""
    for p in paragraphs:
        m = None if heading.match(p) and not item.match(p) else rx.match(p)
        if m:
            out.append(["article" if by_article else "item", m[1], m[2] if by_article else "", above, []])
        elif heading.match(p) and not item.match(p):
            above = p[:100]
        out[-1][4].append(p)
    return [u for u in out if u[4]]


def py_chunks(paragraphs, doc, limit):
    item, sub, article = (re.compile(x.removeprefix("(?U)")) for x in (st.ITEM, st.SUBITEM, st.ARTICLE))
    for kind, number, title, heading, ps in py_units(paragraphs):
        path = [doc, *([heading] if heading else [])]
        if kind == "preamble":
            yield from ((doc, b) for b in py_pack(ps, limit))
            continue
        path.append(f"Статья {number}. {title}".strip() if kind == "article" else f"п. {number}")
        content = ps[1:] if kind == "article" and article.match(ps[0]) else ps
        if not content or len("\n".join(content)) <= limit:
            yield " › ".join(path), "\n".join(content) or ps[0]
            continue
        parts = []
        for p in content:
            m = item.match(p)
            if kind == "article" and (m or not parts):
                parts.append((m[1] if m else "", [p]))
            elif kind == "item" and not parts:
                parts.append((number, [p]))
            else:
                parts[-1][1].append(p)
        held = []

        def emptied():
            nums = [n for n, _ in held if n]  # noqa: B023
            label = [] if not nums else [f"часть {nums[0]}"] if len(nums) == 1 else [f"части {nums[0]}–{nums[-1]}"]
            out = [(" › ".join(path + label), "\n".join(t for _, t in held))] if held else []  # noqa: B023
            held.clear()  # noqa: B023
            return out

        for num, lines in parts:
            text = "\n".join(lines)
            if len(text) > limit:
                yield from emptied()
                listed = len(lines) > 1 and sub.match(lines[1])
                label = [f"часть {num}"] if num and kind == "article" else []
                for b in py_pack(lines[1:], limit, lines[0]) if listed else py_pack(lines, limit):
                    yield " › ".join(path + label), b
            else:
                if held and len("\n".join(t for _, t in held)) + 1 + len(text) > limit:
                    yield from emptied()
                held.append((num, text))
        yield from emptied()


WORDS = [w + ("." if k % 3 == 0 else "") for k, w in enumerate("Альфа бета гамма 44. Дельта эпсилон (Зета 2(1). эта тета йота лямбда мю".split())]


@pytest.fixture(scope="module")
def documents():
    rng = np.random.default_rng(5)
    opens = ["Статья {}. Название ", "{}. Пункт ", "а) ", "Глава {} ", "IV. ", "", "", "2(1). ", "Статья 5-1. "]
    rows = [[], ["одно"], ["Статья 1. А", "1. б", "2. в"], ["Глава 1 о", "1. Х"], ["1. x"]]
    for n in range(80):
        ps = []
        for k in range(int(rng.integers(1, 25))):
            open_ = opens[int(rng.integers(0, len(opens) - (n % 2)))].format(k)
            ps.append(open_ + " ".join(rng.choice(WORDS, int(rng.integers(1, 90 if n % 3 else 12)))))
        rows.append(ps)
    return rows


@pytest.fixture(scope="module")
def frame(spark, documents):
    return spark.createDataFrame([(n, ps) for n, ps in enumerate(documents)], "doc long, ps array<string>")


def test_sentences(spark, frame, documents):
    rows = frame.select("doc", F.transform("ps", lambda p: st.sentences(p)).alias("s"), F.transform("ps", lambda p: st.split_sentences(p, F.lit(80))).alias("x")).collect()
    for r in rows:
        assert r.s == [py_sentences(p) for p in documents[r.doc]]
        assert r.x == [py_split(p, 80) for p in documents[r.doc]]


def test_units_and_chunks(spark, frame, documents):
    rows = frame.select("doc", st.parse_units(F.col("ps")).alias("u"), st.chunk_structural(F.col("ps"), F.lit("D"), LIMIT).alias("c"), st.chunk_paragraphs(F.col("ps"), 60, LIMIT).alias("p")).collect()
    seen = set()
    for r in rows:
        ps = documents[r.doc]
        assert [tuple(u) for u in r.u] == [tuple(u) for u in py_units(ps)]
        assert [tuple(c) for c in r.c] == list(py_chunks(ps, "D", LIMIT))
        seen |= {re.sub(r"[^а-я]", "", c.prefix.split(" › ")[-1])[:5] for c in r.c}
        plain, cur = [], ""
        for p in ps:
            cur = f"{cur}\n{p}" if cur else p
            if len(cur) >= 60:
                plain += py_split(cur, LIMIT) if len(cur) > LIMIT else [cur]
                cur = ""
        assert r.p == plain + [cur] * bool(cur)
    assert {"часть", "части"} <= seen


def test_whole_text_is_kept(spark, sf):
    """Chunks of the table's documents hold every paragraph, whole or cut at sentences."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    cut = F.flatten(F.transform(st.chunk_paragraphs(F.col("ps"), 200, 900), lambda b: words(b)))
    rows = acts.acts(spark, sf).select(cut.alias("a"), F.flatten(F.transform("ps", lambda p: words(p))).alias("b"))
    assert rows.filter("a <> b").count() == 0 and rows.count() == 200


# --- windows


def py_window(paragraphs, target, cap):
    words = lambda s: set(re.findall(r"[а-яёa-z0-9]{4,}", s.lower()))
    if len("\n".join(paragraphs)) <= cap:
        return "\n".join(paragraphs)
    at = max(range(len(paragraphs)), key=lambda k: (len(words(paragraphs[k]) & target), -k))
    if len(paragraphs[at]) > cap:
        pieces = [paragraphs[at][k : k + cap] for k in range(0, len(paragraphs[at]), cap)]
        return pieces[max(range(len(pieces)), key=lambda k: (len(words(pieces[k]) & target), -k))]
    held, turn = [at, at], True
    while turn:
        turn = False
        for end, step in ((0, -1), (1, 1)):
            to = held[end] + step
            size = lambda a, b: len("\n".join(paragraphs[a : b + 1]))
            if 0 <= to < len(paragraphs) and size(min(to, held[0]), max(to, held[1])) <= cap:
                held[end], turn = to, True
    return "\n".join(paragraphs[held[0] : held[1] + 1])


def test_windows_grow_by_turns(spark):
    from lodestone.functions.text import word_set

    rng = np.random.default_rng(9)
    vocabulary = ["слово%d" % k for k in range(40)]
    rows = []
    for n in range(120):
        ps = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 25)))) for _ in range(int(rng.integers(1, 12)))]
        rows.append((n, ps, sorted(set(rng.choice(vocabulary, 6)))))
    grown = st.grown_window(F.col("ps"), F.transform("ps", lambda p: word_set(p)), F.col("t"), 120)
    got = spark.createDataFrame(rows, "n int, ps array<string>, t array<string>").select("n", grown.alias("w")).collect()
    assert {r.n: r.w for r in got} == {n: py_window(ps, set(t), 120) for n, ps, t in rows}


def test_equal_windows_become_one(spark):
    passages = spark.createDataFrame([(1, 1, "a", 7, "t7"), (1, 2, "a", 3, "t3"), (1, 3, "a", 4, "t4"), (1, 4, "b", 3, "t3"), (1, 5, "a", 7, "t7"), (2, 1, "a", 4, "t4")], "query int, rank int, doc string, chunk int, text string")
    windows = spark.createDataFrame([("a", 3, "p", "one text"), ("a", 7, "p", "one text"), ("a", 4, "p", "another")], "doc string, chunk int, parent_id string, text string")
    got = sorted(tuple(r) for r in al.replace_parents(passages, windows).select("query", "rank", "doc", "chunk", "text", "child_chunk_ids").collect())
    assert got == [(1, 1, "a", 7, "one text", [7, 3]), (1, 2, "a", 4, "another", [4]), (1, 3, "b", 3, "t3", None), (2, 1, "a", 4, "another", [4])]
    assert [r.text for r in al.replace_parents(passages, windows, 3).orderBy("query", "rank").collect()] == ["one", "ano", "t3", "ano"]


# --- alignment


def py_path(e, rollback):
    """The best path over every transition, by enumeration of predecessors."""
    best, came = [list(e[0])], []
    for i in range(1, len(e)):
        row, back = [], []
        for j in range(len(e[0])):
            options = [(best[-1][k], -k) for k in range(j + 1)]
            value, at = max(options)
            if rollback and j + 1 < len(e[0]) and best[-1][j + 1] - 0.15 > value:
                value, at = best[-1][j + 1] - 0.15, -(j + 1)
            row.append(value + e[i][j])
            back.append(-at)
        best.append(row)
        came.append(back)
    path = [max(range(len(best[-1])), key=lambda j: (best[-1][j], -j))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("rollback", [True, False])
def test_path_with_few_kept_rows(rollback):
    rng = np.random.default_rng(3)
    for n, u in [(1, 1), (1, 4), (2, 3), (7, 1), (16, 5), (17, 5), (50, 9)]:
        e = np.round(rng.random((n, u)), 1)  # many ties
        assert al.best_path(lambda i: e[i], n, rollback) == py_path(e.tolist(), rollback)  # noqa: B023
    assert al.best_path(lambda i: None, 0) == []


def test_alignment_rows(spark):
    units = [("d", 1, "preamble", "", "общие слова перед текстом"), ("d", 2, "article", "1", "Статья 1. Первая\n1. альфа бета гамма дельта"), ("d", 3, "article", "2", "Статья 2. Вторая\n1. альфа бета гамма дельта\n2. омега сигма"), ("d", 4, "article", "3", "Статья 3. Третья\nтретья часть закона")]
    chunks = [("d", 0, "общие слова", None, None), ("d", 1, "альфа бета гамма дельта", "1", "1"), ("d", 2, "альфа бета гамма дельта", "2", "2"), ("d", 3, "до", None, None), ("d", 4, "ничего такого нигде", None, None), ("e", 0, "слова", None, None)]
    a = al.align(spark.createDataFrame(chunks, "doc string, ord int, body string, article string, part string"), spark.createDataFrame(units, "doc string, ordinal int, kind string, number string, text string"))
    got = {(r.doc, r.ord): r for r in a.collect()}
    assert [got["d", k].parent for k in range(5)] == [1, 2, 3, None, None]
    assert [got["d", k].reason for k in range(5)] == [None, None, None, "empty_words", "below_threshold"]
    assert got["d", 1].bonus == pytest.approx(0.045) and got["d", 2].bonus == pytest.approx(0.045)
    assert got["e", 0].reason == "no_units" and got["e", 0].candidate is None
    stats = {r.doc: r for r in al.alignment_statistics(a, spark.createDataFrame(units, "doc string, ordinal int, kind string, number string, text string")).collect()}
    assert (stats[None].chunks, stats[None].without_parent, stats["d"].preamble_parents, stats["e"].n_no_units) == (6, 3, 1, 1)


def test_documents_are_aligned_together(spark, monkeypatch):
    """No group a document: batches of documents give the rows that each gives alone."""
    rng = np.random.default_rng(9)
    words = [f"слово{k}" for k in range(25)]
    text = lambda n: " ".join(rng.choice(words, rng.integers(0, n)))
    chunks = [(d, k, f"{k % 3}. {text(9)}" if k % 2 else text(9), str(k % 4) if k % 3 else None, str(k % 3) if k % 2 else None, text(4)) for d in range(40) for k in range(d % 7)]
    units = [(d, k, ("preamble", "article", "item")[k % 3], str(k % 4), f"1. {text(12)}\n{k % 3}. {text(5)}") for d in range(40) for k in range(1, 1 + d % 5)]
    a = spark.createDataFrame(chunks, "doc int, ord int, body string, article string, part string, heading_path string").repartition(3)
    b = spark.createDataFrame(units, "doc int, ordinal int, kind string, number string, text string")
    for rollback in (True, False):
        monkeypatch.undo()
        out = al.align(a, b, 0.3, rollback)
        assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()
        together = sorted(map(repr, out.collect()))
        monkeypatch.setattr(al, "CELLS", 0, raising=False)
        code = al.align(a, b, 0.3, rollback)
        assert len(together) == len(chunks) and sorted(map(repr, code.collect())) == together


# --- scans


def test_scans_compose_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in (None, 1, 2, 3):
        at = 0
        for _ in range(150):
            at += int(rng.integers(1, 4))
            rows.append((g, at, int(rng.integers(0, 9)) if rng.random() < 0.4 else None))
    frame = spark.createDataFrame(rows, "g int, ord int, v int").repartition(3)
    want = {}
    for inclusive in (True, False):
        last, total, high = {}, {}, {}
        for g, at, v in rows:
            before = (last.get(g), total.get(g), high.get(g))
            if v is not None:
                last[g], total[g], high[g] = v, total.get(g, 0) + v, max(v, high.get(g, v))
            want[inclusive, g, at] = (last.get(g), total.get(g), high.get(g)) if inclusive else before
    for inclusive, block in itertools.product((True, False), (1, 7, 10_000)):
        out = scan.carry_last(frame, ["g"], "ord", "last", F.col("v"), inclusive, block)
        out = scan.scan(out, ["g"], "ord", {"total": F.col("v")}, F.sum, inclusive, block)
        out = scan.scan(out, ["g"], "ord", {"high": F.col("v")}, F.max, inclusive, block)
        assert {(inclusive, r.g, r.ord): (r.last, r.total, r.high) for r in out.collect()} == {k: v for k, v in want.items() if k[0] == inclusive}


def test_heading_stack(spark):
    rng = np.random.default_rng(7)
    rows = [(d, k, int(rng.integers(0, 4)) if rng.random() < 0.4 else None, f"{d}.{k}") for d in range(3) for k in range(200)]
    want, stack = {}, {}
    for d, k, level, text in rows:
        open_ = stack.setdefault(d, {})
        if level is not None:
            for deeper in [x for x in open_ if x >= level]:
                del open_[deeper]
            open_[level] = text
        want[d, k] = [open_[x] for x in sorted(open_)]
    frame = spark.createDataFrame(rows, "doc int, ord int, level int, text string").repartition(4)
    for block in (5, 1000):
        got = scan.heading_paths(frame, levels=4, block=block)
        assert {(r.doc, r.ord): r.path for r in got.collect()} == want
    with pytest.raises(Exception, match="deeper than level"):
        scan.heading_paths(frame, levels=2).collect()
