"""The contract of an answer on literal rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import contract

ANSWERS = "id int, out_of_scope boolean, n_questions int, possible_mismatch boolean, dated boolean, requested array<string>, sheet boolean, strict boolean"
ITEMS = "id int, part string, ord int, statement string, evidence_ids array<string>"
EVIDENCE = "id int, eid string, level string, text string, source string, title string, locator string, state string, note string"
PIECES = [
    ("ext_001", "external", "Закон", "law.pdf", "", "п. 1", None),
    ("int_001", "internal", "Приказ", "order.pdf", "Приказ 5", None, None),
    ("obj_s1", "object", "Раздел", "sheet", "Лист", None, None),
    ("obj_f_a", "object", "Высота 10", "sheet", None, None, "known"),
    ("obj_f_b", "object", "", "sheet", "Поле", None, "unknown"),
    ("obj_f_c", "object", "Нет", "sheet", "Поле", None, "not_applicable"),
]
EXT, INT = ("external_basis", "e", ["ext_001"]), ("internal_basis", "i", ["int_001"])
FACT, DONE = ("object_facts", "f", ["obj_f_a"]), ("applied_conclusions", "a", ["obj_f_a", "ext_001"])
BOTH = ["external", "internal"]


def frames(spark, items, oos=False, questions=0, mismatch=False, dated=True, requested=BOTH, sheet=None, strict=False):
    answers = spark.createDataFrame([(1, oos, questions, mismatch, dated, requested, sheet, strict)], ANSWERS)
    rows = spark.createDataFrame([(1, p, n, s, ids) for n, (p, s, ids) in enumerate(items)], ITEMS)
    return answers, rows, spark.createDataFrame([(1, *p, "clash") for p in PIECES], EVIDENCE)


CASES = [
    ([EXT, INT], {}, ("answered", [])),
    ([EXT, INT], {"oos": True, "questions": 1}, ("out_of_scope", [])),
    ([("external_basis", "e", [])], {"questions": 1}, ("failed", ["citation_invalid"])),
    ([("external_basis", "e", ["zzz"])], {}, ("failed", ["citation_invalid"])),
    ([("external_basis", "e", ["int_001"])], {}, ("failed", ["citation_invalid"])),
    ([EXT, INT, ("applied_conclusions", "a", ["ext_001"])], {}, ("failed", ["citation_invalid"])),
    ([("other", "e", ["ext_001"])], {}, ("failed", ["citation_invalid"])),
    ([EXT, INT, ("applied_conclusions", "a", ["obj_f_b", "ext_001"])], {"questions": 2}, ("needs_context", ["applicability_unclear"])),
    ([EXT, INT, ("applied_conclusions", "a", ["obj_f_b", "ext_001"])], {}, ("needs_context", ["applied_on_unknown_field"])),
    ([EXT, INT, ("applied_conclusions", "a", ["obj_f_c", "ext_001"])], {}, ("answered", [])),
    ([EXT, INT, ("object_facts", "f", ["obj_f_b"])], {}, ("answered", [])),
    ([EXT, INT, ("applied_conclusions", "a", ["obj_f_a"])], {}, ("needs_review", ["applied_without_norm"])),
    ([EXT, INT, ("object_facts", "Ширина НЕ  МЕНЕЕ метра", ["obj_s1"])], {}, ("needs_review", ["object_fact_normative"])),
    ([EXT, INT, ("object_facts", "Должность занята, задолжен", ["obj_s1"])], {}, ("answered", [])),
    ([EXT, INT, FACT], {"sheet": False}, ("needs_review", ["object_profile_not_requested"])),
    ([EXT, INT], {"sheet": False}, ("answered", [])),
    ([], {}, ("needs_review", ["external_evidence_missing", "internal_evidence_missing"])),
    ([INT, DONE], {}, ("answered", [])),
    ([INT], {"requested": ["internal"]}, ("answered", [])),
    ([FACT], {}, ("answered", [])),
    ([FACT], {"strict": True}, ("needs_review", ["external_evidence_missing", "internal_evidence_missing"])),
    ([EXT, FACT], {}, ("needs_review", ["internal_evidence_missing"])),
    ([FACT], {"dated": False}, ("needs_review", ["object_profile_undated"])),
    ([EXT, INT], {"dated": False}, ("answered", [])),
    ([EXT, INT], {"mismatch": True}, ("needs_review", ["possible_mismatch"])),
    ([EXT], {"mismatch": True, "requested": ["external"]}, ("answered", [])),
]


@pytest.mark.parametrize("items,flags,want", CASES)
def test_decide(spark, items, flags, want):
    row = contract.decide(*frames(spark, items, **flags)).collect()
    assert [(r.status, r.reasons) for r in row] == [want]


def test_problems(spark):
    _, items, evidence = frames(spark, [EXT, ("internal_basis", "i", ["ext_001", "int_001", "no"]), ("object_facts", "f", []), ("applied_conclusions", "a", ["ext_001", "int_001"]), ("applied_conclusions", "a", [])])
    got = sorted((r.part, r.ord, r.eid or "", r.problem) for r in contract.check_citations(items, evidence).collect())
    assert got == [("applied_conclusions", 3, "", "no object evidence"), ("applied_conclusions", 4, "", "no evidence"), ("internal_basis", 1, "ext_001", "level"), ("internal_basis", 1, "no", "unknown id"), ("object_facts", 2, "", "no evidence")]


def test_shown(spark):
    rows = [("answered", []), ("needs_review", ["external_evidence_missing", "possible_mismatch"]), ("needs_review", ["applied_without_norm"]), ("needs_context", ["x"]), ("failed", []), ("out_of_scope", [])]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, s string, r array<string>")
    got = [r.c for r in frame.select("n", contract.shown_status(F.col("s"), F.col("r")).alias("c")).orderBy("n").collect()]
    assert got == ["sufficient", "conflict", "insufficient_evidence", "clarification_required", "failed", "out_of_scope"]


def test_expected(spark):
    schema = "s string, r array<string>, e array<struct<status:string,reasons:array<string>>>"
    rows = [
        ("a", ["y", "x"], [("b", []), ("a", ["x", "y"])]),
        ("a", ["x", "x"], [("a", ["x"])]),
        ("a", [], [("a", None)]),
        ("a", [], None),
        ("a", [], []),
    ]
    got = [r.ok for r in spark.createDataFrame(rows, schema).coalesce(1).select(contract.as_expected(F.col("s"), F.col("r"), F.col("e")).alias("ok")).collect()]
    assert got == [True, False, True, None, None]


def test_forbidden(spark):
    frame = spark.createDataFrame([(["Можно  НЕ\nделать", None, "b"], ["можно не  ДЕЛАТЬ", " ", "", "нет"])], "t array<string>, p array<string>")
    assert frame.select(contract.forbidden_hits(F.col("t"), F.col("p")).alias("h")).first().h == ["можно не  ДЕЛАТЬ"]


def test_chains(spark):
    later = ("internal_basis", "i first in order, external goes before", ["ext_001", "int_001"])
    items = [later, EXT, ("object_facts", "one", ["obj_f_a", "obj_s1"]), ("object_facts", "two", ["obj_s1"]), ("applied_conclusions", "so", ["obj_s1", "int_001", "obj_f_b", "ext_001", "obj_f_c", "qqq", "obj_zz"]), ("applied_conclusions", "bare", [])]
    _, rows, evidence = frames(spark, items)
    got = {r.conclusion: (r.fact, r.requirement) for r in contract.reasoning_chains(rows, evidence).collect()}
    assert got == {"so": ("one · Нет", "i first in order, external goes before · e"), "bare": ("", "")}


def test_cards(spark):
    items = [EXT, ("internal_basis", "i", ["int_001", "ext_001", "int_001", "no"]), ("object_facts", "f", ["obj_s1", "obj_f_a", "obj_f_b"]), ("object_facts", "g", ["no", "obj_s1"]), ("external_basis", "n", ["no"]), ("external_basis", "m", [])]
    _, rows, evidence = frames(spark, items)
    got = sorted((r.ord, -1 if r.pos is None else r.pos, r.statement, r.title, r.locator) for r in contract.basis_cards(rows, evidence).collect())
    assert got == [
        (0, 0, "e", "law.pdf", "п. 1"),
        (1, 0, "i", "Приказ 5", None),
        (1, 1, "i", "law.pdf", "п. 1"),
        (1, 2, "i", "Приказ 5", None),
        (2, 1, "f", "sheet", None),
        (3, 1, "g", "Лист", None),
        (4, -1, "n", None, None),
        (5, -1, "m", None, None),
    ]


def test_empty(spark):
    answers, items, evidence = (f.limit(0) for f in frames(spark, [EXT]))
    assert contract.decide(answers, items, evidence).count() == 0
    assert contract.reasoning_chains(items, evidence).count() == contract.basis_cards(items, evidence).count() == contract.check_citations(items, evidence).count() == 0
