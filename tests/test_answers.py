"""Figures of generated answers on literal rows."""

import re

from pyspark.sql import functions as F

from lodestone.operators import answers

RESULT = "path string, answer string, error string, generation_failed boolean, route_decision string, abstain_reason string, elapsed_sec double, usage_unknown boolean, oos_type string, reference_status string, faithfulness double, relevance double, correctness double"
RESULTS = [
    ("simple", "Да", None, None, "simple", "", 1.0, None, "", "verified", 1.0, 0.5, 4.0),
    ("simple", "Да", None, False, "simple", None, 2.0, False, None, "verified", 0.5, None, 9.0),
    ("complex", "Да", None, False, "complex", "", 3.0, True, "", "verified", None, 1.0, 2.0),
    ("simple", "Да", None, False, "simple", "", 4.0, False, "", "draft", 1.0, 1.0, 7.0),
    ("simple", "Ответа НЕТ.", None, False, "abstain", "", None, False, "out_of_scope", "verified", 0.0, 0.0, None),
    ("simple", "Интернет есть", None, False, "simple", "", None, False, "out_of_scope", "verified", 0.0, 0.0, None),
    ("simple", "", "empty answer", False, None, "none", None, False, "out_of_scope", "verified", None, None, None),
    ("simple", "Нет", "generation_failed", True, None, "", None, False, "out_of_scope", "verified", None, None, None),
    ("unknown", None, "broken", None, None, None, 1.5, True, "out_of_scope", "verified", None, None, None),
    ("simple", "x" * 200 + " не могу", None, False, None, "", None, False, "out_of_scope", "draft", None, None, None),
]


def test_run_summary(spark):
    row = answers.run_summary(spark.createDataFrame(RESULTS, RESULT)).first().asDict()
    assert row == {
        "answered": 7,
        "failed": 2,
        "abstained": 2,
        "usage_unknown": 2,
        "complex_path_rate": 0.2,
        "mean_elapsed_sec": 2.3,
        "faithfulness": 0.357,
        "answer_relevance": 0.357,
        "correctness_mean": 5.5,
        "correctness_inscope": 5.0,
        "correctness_scored": 3,
        "correctness_in_scope_total": 4,
        "oos_rejection_rate": 0.5,
        "false_sufficiency_rate": 0.5,
    }


def test_nothing(spark):
    row = answers.run_summary(spark.createDataFrame([], RESULT)).first()
    assert (row.answered, row.complex_path_rate, row.faithfulness, row.correctness_mean, row.correctness_inscope, row.oos_rejection_rate) == (0, 0.0, 0.0, None, None, 0.0)
    schema = "answer string, abstained boolean, is_oos boolean, forbidden string, top_score double, n_passages int"
    assert tuple(answers.abstain_rates(spark.createDataFrame([], schema)).first()) == (0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    assert answers.evaluator_summary(spark.createDataFrame([], "key string, score int, comment string")).count() == 0


def test_abstain_rates(spark):
    schema = "answer string, abstained boolean, is_oos boolean, forbidden string, top_score double, n_passages int"
    rows = [
        ("Раз в ГОД", None, None, " в год | |x", 0.5, 3),
        ("ok", True, False, "нет такого", None, None),
        ("  ", False, True, "|", 0.25, 2),
        (None, None, True, None, 0.125, 0),
        ("ok", None, True, "", 0.0, 1),
    ]
    row = answers.abstain_rates(spark.createDataFrame(rows, schema)).first()
    assert (row.abstain_rate, row.false_abstain_rate, round(row.correct_abstain_rate, 6)) == (0.6, 0.5, 0.666667)
    assert (round(row.inversion_rate, 6), row.avg_top_score, row.avg_passage_count) == (round(1 / 3, 6), 0.175, 1.2)


def plain_figures(answer, sources):
    """A scan over characters: the ends of sentences, brackets and marks one by one."""
    mark = re.compile(r"\[фрагмент\s+(\d+):\s*([^,\]]+?)(?:,\s*п\.\s*([^\]]+?)|,\s*без\s+пункта)?\s*\]", re.I)
    text, sources = answer or "", sources or []
    cites = [(int(m[1]), m[2].strip(), (m[3] or "").strip()) for m in mark.finditer(text)]
    ends, sentences, start, at, inside = ".!?", [], 0, 0, False
    while at < len(text):
        c = text[at]
        if inside:
            inside = c != "]"
        elif c == "[" and "]" in text[at:]:
            inside = True
        elif c in ends:
            stop = at
            while stop < len(text) and text[stop] in ends:
                stop += 1
            if stop == len(text) or text[stop].isspace():
                sentences.append(text[start:stop])
                start = stop
            at = stop - 1
        at += 1
    if text[start:].strip():
        sentences.append(text[start:])
    cited = sum(bool(mark.search(s)) for s in sentences)
    good = [(n, doc) for n, doc, _ in cites if 1 <= n <= len(sources)]
    named = [1 for n, doc in good if doc and doc.lower() in (sources[n - 1] or "").lower()]
    share = lambda a, b: a / b if b else 0.0
    return len(cites), len(set(cites)), share(len(set(cites)), len(cites)), share(cited, len(sentences)), share(len(good), len(cites)) if sources else 0.0, share(len(named), len(good))


def test_citation_figures(spark):
    texts = [
        "Срок год [Фрагмент 1: СП 1, п. 3.1]. Да. Нет!",
        "A. [Фрагмент 2: b.pdf, без пункта] c? d [фрагмент 9: zz]",
        "[Фрагмент 1: a, п. 3 и п. 4][Фрагмент 1: a, п. 3 и п. 4] ... !? v3.5 x",
        "[нет. тут [Фрагмент  3: C ] и [скобка. без конца. Два.",
        "a. b [c] d. e] f. [Фрагмент 0: a] [Фрагмент 1: ]",
        "Хвост.\n",
        "Hello.  ...  \t",
        " \n ",
        "",
        None,
        "\u0001. [x. y]. [Фрагмент 1: СП 1, прочее]",
        "слово. " * 20000 + "[Фрагмент 1: a]",
    ]
    lists = [["Док СП 1.pdf", "b.PDF", None], [], None, ["A"]]
    cases = [(n, t, s) for n, (t, s) in enumerate((t, s) for t in texts for s in lists)]
    frame = spark.createDataFrame(cases, "n int, answer string, sources array<string>")
    got = {r.n: tuple(r.c) for r in frame.select("n", answers.citation_figures(F.col("answer"), F.col("sources")).alias("c")).collect()}
    assert {n: got[n] for n, _, _ in cases} == {n: plain_figures(a and a.replace("\u0001", ""), s) for n, a, s in cases}


def test_evaluator_summary(spark):
    rows = [("retrieval_hit", 1, "rank=4"), ("retrieval_hit", 0, "miss"), ("retrieval_hit", None, "rank=1"), ("doc_cited", 1, None), ("retrieval_hit", 1, None), ("forbidden", None, "x")]
    got = {r.key: (round(r["mean"], 6), r.n, r.mrr) for r in answers.evaluator_summary(spark.createDataFrame(rows, "key string, score int, comment string")).collect()}
    assert got == {"retrieval_hit": (0.666667, 3, 0.25 / 3), "doc_cited": (1.0, 1, None)}


def test_usage(spark):
    rows = [
        ('{"usage_metadata": {"input_tokens": 5, "output_tokens": 6, "output_token_details": {"reasoning": 2}}, "response_metadata": {"token_usage": {"prompt_tokens": 9}}}', (5, 6, 2, "")),
        ('{"usage_metadata": {"prompt_tokens": 5, "completion_tokens_details": {"reasoning_tokens": "3"}}}', (5, 0, 3, "")),
        ('{"usage_metadata": null, "response_metadata": {"openrouter_provider": "p", "token_usage": {"prompt_tokens": 9, "completion_tokens": 1.9}}}', (9, 1, 0, "p")),
        ('{"usage_metadata": {"input_tokens": "many"}}', (0, 0, 0, "")),
        ("{}", (0, 0, 0, "")),
        ("no json", (0, 0, 0, "")),
        (None, (0, 0, 0, "")),
    ]
    frame = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, r string")
    assert [tuple(r.u) for r in frame.select("n", answers.usage(F.col("r")).alias("u")).orderBy("n").collect()] == [r[1] for r in rows]


def test_preference(spark):
    good = [('{"winner": "A"}', 0), ('\n{"winner": "b"} ', 1), ('```json\n{"winner": "tie"}\n```', -1), ('```\n{"winner": "a"}```', 0)]
    bad = ['{"winner": "C"}', '{"winner": 1}', '{"winner": null}', "[]", '["A"]', '"A"', "", "A", '{"winner": "A"', '{"winner": "A"} and more', '{"winner": ["A"]}', '```{"winner": "A"}```', None]
    rows = good + [(b, None) for b in bad]
    frame = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, r string")
    got = [r.p for r in frame.select("n", answers.preference(F.col("r")).alias("p")).orderBy("n").collect()]
    assert list(zip((r[0] for r in rows), got)) == rows
    seats = frame.select("n", answers.seat_scores(F.col("r"), F.col("n") == 0).alias("s")).orderBy("n").limit(5).collect()
    assert [tuple(r.s) for r in seats] == [(None, None, "target_error"), (0.0, 1.0, None), (0.5, 0.5, None), (1.0, 0.0, None), (None, None, "judge_format_error")]
