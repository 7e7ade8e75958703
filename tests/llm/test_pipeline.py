"""Each stage of the pipeline against what it is asked to do, and the whole."""

import re

import numpy as np

import corpus_pipeline as cp
from lodestone.llm import quality
from lodestone.llm.store import materialize
from tests.llm import brute
from tests.llm.test_operators import joined, words


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        docs = materialize(stage(spark, docs, sf), "stage")
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            kept = {r.doc_id for r in quality.apply_rules(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).filter("kept").collect()}
            assert {r.doc_id for r in after} == kept
        if k == 1:
            assert all(r.n_chars == len(r.text) for r in after) and {r.doc_id for r in after} <= {r.doc_id for r in before}
        if k == 2:
            want = joined([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({c for _, c in want.values()})
        if k == 3:
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        if k == 4:
            assert len(after) == len(before) and all(r.round_trip for r in after)
    assert sorted((r.doc_id, r.ids) for r in cp.run(spark, sf).collect()) == sorted((r.doc_id, r.ids) for r in after)


def five_word_firsts(rows):
    """The least ids of the components of (id, text), by comparing every pair."""
    sets = {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate(brute.LOW))
        sets[i] = {tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, o in sets.items():
            if j < i and 100 * len(s & o) >= 80 * len(s | o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in root if find(i) == i)


def test_near_duplicates_take_five_words_and_four_fifths(spark, sf):
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if (r.text or "").strip()]
    for g in range(8):
        base = words(100, 300 + g).split(" ")
        rows.append((10_000 + 100 * g, " ".join(base)))
        for c in range(1, 12):
            edited = list(base)
            for at in rng.choice(np.arange(5, 95), c % 4, replace=False):
                edited[at] = f"x{c}"
            rows.append((10_000 + 100 * g + c, " ".join(edited)))
    base = words(100, 400).split(" ")
    two = [w if k not in (30, 60) else "new" for k, w in enumerate(base)]  # 86 of 106 five-word shingles, 89 of 105 four-word ones
    rows += [(20_000, " ".join(base)), (20_001, " ".join(two)), (20_002, "a b c d"), (20_003, "A b c\td"), (20_004, "a b c d e")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in cp.near_duplicates(spark, df, sf).collect())
    assert 20_001 not in got and got == five_word_firsts(rows)
