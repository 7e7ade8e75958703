"""Citation verdicts and filter guards on literal rows."""

import pytest

from lodestone.operators import citations
from lodestone.sources import guards

A, C = "Срок один год, см. пункт 5.", "Пункт 5. Срок — один год.\nПункт 6. Прочее"


@pytest.mark.parametrize(
    "checks,want",
    [
        ([], ("needs_review", True, None)),
        ([("norm", "match", "ОДИН  год", "один год")], ("pass", True, None)),
        ([("norm", "match", "один год", "один год"), ("norm", "mismatch", "пункт 5", "Пункт 6")], ("fail", True, None)),
        ([("norm", "mismatch", "пункт 5", "Пункт 6"), ("norm", "unverifiable", None, None)], ("fail", True, None)),
        ([("norm", "match", "один год", "один год"), ("norm", "unverifiable", "пункт 5", None)], ("needs_review", True, None)),
        ([("norm", "match", "один год", "один год"), ("norm", "missing_in_answer", None, "Пункт 6")], ("pass", False, None)),
        ([("norm", "missing_in_answer", None, "Пункт 6")], ("needs_review", False, None)),
        ([("norm", "match", "один год", "один год"), ("norm", "missing_in_answer", "пункт 5", "Пункт 6")], ("needs_review", False, None)),
        ([("norm", "match", "один год", "один год"), ("date", "missing_in_answer", "пункт 5", "Пункт 6")], ("pass", True, None)),
        ([("norm", "match", "два года", "один год")], ("format_error", True, "answer_quote")),
        ([("norm", "match", "один год", " ")], ("format_error", True, "context_quote")),
        ([("norm", "match", "один год", None)], ("format_error", True, "both quotes")),
        ([("norm", "missing_in_answer", None, None)], ("format_error", False, "context_quote required")),
        ([("norm", "match", "один год", "один год"), ("norm", "hm", None, None), ("norm", "match", "нет", "нет")], ("format_error", True, "comparison")),
        ([("norm", None, None, None)], ("format_error", True, "comparison")),
    ],
)
def test_verdicts(spark, checks, want):
    answers = spark.createDataFrame([(1, A, C)], "id int, answer string, context string")
    rows = spark.createDataFrame([(1, n, *c) for n, c in enumerate(checks)], "id int, ord int, field string, comparison string, answer_quote string, context_quote string")
    got = citations.verdicts(answers, rows).collect()
    assert [(r.status, r.complete, r.problem) for r in got] == [want] and got[0].n_checks == len(checks)


def test_guards():
    assert guards.lenient({"year": 2024, "$where": "x", "source": "a"}) == {"year": 2024}
    assert guards.lenient(None) is None and guards.lenient({}) == {}
    assert guards.strict({"audience": {"$in": ["a"]}}) == {"audience": {"$in": ["a"]}}
    for bad in (None, {}, {"source": "a"}, {"year": {"$gt": 1}}, {"year": {"$in": [1], "$ne": 2}}):
        with pytest.raises(ValueError):
            guards.strict(bad)
    with pytest.raises(ValueError):
        guards.predicate({"year": {"$gt": 1}})
    assert guards.unit_scopes("u") == ({"source_type": "external"}, {"source_type": "internal", "audience": {"$in": ["company", "u"]}})
    assert guards.unit_scopes(None)[1]["audience"] == {"$in": ["company"]}


def test_predicate_takes_a_missing_value_for_a_value(spark):
    rows = [(1, "external", None), (2, "internal", "company"), (3, "internal", "u"), (4, None, "v")]
    frame = spark.createDataFrame(rows, "id int, source_type string, audience string")
    ids = lambda f: [r.id for r in frame.filter(guards.predicate(f, frame.columns)).orderBy("id").collect()]
    outside, inside = guards.unit_scopes("u")
    assert ids(outside) == [1] and ids(inside) == [2, 3] and ids(None) == [1, 2, 3, 4]
    assert ids({"source_type": None}) == [4] and ids({"audience": {"$in": [None, "v"]}}) == [1, 4] and ids({"audience": {"$in": []}}) == []
    assert ids({"year": 2024}) == [] and ids({"year": None}) == [1, 2, 3, 4]
