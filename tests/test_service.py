"""Lookups, outcomes, questions and reviews on literal rows."""

from pyspark.sql import functions as F

from lodestone.functions import questions
from lodestone.operators import lookup, review


def column(spark, rows, schema, expression):
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"at int, {schema}")
    return [r.v for r in frame.select("at", expression.alias("v")).orderBy("at").collect()]


def test_weak_questions(spark):
    weak = [
        "Каким приказом утверждены правила?",
        "Какой Федеральный закон ввёл эту норму?",
        "Когда утратило силу или утратила  силу норма?",
        "Назовите номер подпункта",
        "Что изменила новая редакция?",
        "Какого типа закона требования регулируют отношения?",
        "КАКОЙ ДОКУМЕНТ УСТАНАВЛИВАЕТ порядок?",
        "Что нужно согласно настоящему Кодексу?",
        "Что сказано в статье 5?",
        "Какое приложение содержит форму?",
    ]
    strong = ["Сколько огнетушителей нужно?", "Кто проводит инструктаж", "", None, "Какие документы нужны при приёме?", "Что делать в статье расходов"]
    got = column(spark, [(q,) for q in weak + strong], "q string", questions.weak_question(F.col("q")))
    assert got == [True] * len(weak) + [False] * len(strong)


def test_query_class(spark):
    rows = [("СРАВНИ пункт 5 и 6",), ("A vs B",), ("Сколько лет?",), ("см. п. 5",), ("Кто отвечает",), ("",), (None,)]
    got = column(spark, rows, "q string", questions.query_class(F.col("q")))
    assert [tuple(g) for g in got] == [(True, 0.5), (True, 0.5), (False, 0.95), (False, 0.95), (False, 0.7), (False, 0.7), (False, 0.7)]


def test_incomplete(spark):
    rows = [
        ("один два три четыре пять шесть", True),
        ("один два три четыре пять", False),
        ("один два три четыре пять шесть. \n", False),
        ("Далее ТАБЛИЦА.", True),
        ("и так... далее.", True),
        ("Начало.\n2 второй;\n3 третий.", True),
        ("- первый.\n- второй.", False),
        ("1. первый.\n2 второй.", False),
        ("2 второй.", True),
        ("12. первый.", False),
        ("  \n ", False),
        ("", False),
        (None, False),
        ("слово " * 50000, True),
    ]
    assert column(spark, [r[:1] for r in rows], "t string", questions.incomplete(F.col("t"))) == [r[1] for r in rows]


def test_needs_picture(spark):
    long = "Полный текст пункта. " * 10
    rows = [(long, "s", 1, [1.0], "Table", True), (long, "s", 1, [1.0], "text", False), (long, "s", 1, [1.0], None, False), ("Да.", "s", 0, [1.0], "text", True), ("Да.", None, 1, [1.0], "table", False), ("Да.", "", 1, [1.0], "", False), ("Да.", "s", None, [1.0], "", False), ("Да.", "s", 1, [], "", False), ("Да.", "s", 1, None, "", False), (None, "s", 1, [1.0], "", True)]
    c = F.col
    assert column(spark, [r[:5] for r in rows], "t string, s string, p int, b array<double>, e string", questions.needs_picture(c("t"), c("s"), c("p"), c("b"), c("e"))) == [r[5] for r in rows]


def test_get_chunks(spark):
    chunks = spark.createDataFrame([("a", "7", "seven", 1), ("a", "007", "agent", 1), ("b", "7", "b seven", 1), ("a", "x", "ix", 1), ("a", "7", "again seven", 1), (None, "7", "nobody", 1)], "source string, local string, text string, chunk_id int")
    addresses = spark.createDataFrame([("a", "table", "1", "2", 5, "later"), ("a", "table", "1", "2", 3, "row"), ("a", "table", "1", "1", 4, "first row"), ("a", "table", "1", None, 9, "whole"), ("a", "item", "1.2", None, 1, "item"), ("b", "table", "1", "2", 1, "other")], "source string, kind string, num string, row string, ord int, text string")
    want = {
        "a::7": (True, "a", "again seven", None),
        "a::007": (True, "a", "agent", None),
        "b::007": (True, "b", "b seven", None),
        "a:: +7 ": (True, "a", "again seven", None),
        "a::x": (True, "a", "ix", None),
        "c::7": (False, None, None, None),
        "7": (False, None, None, "no source"),
        "": (False, None, None, "no source"),
        "::7": (False, None, None, "no source"),
        "a::addr:table:1": (True, "a", "row", None),
        "a::addr:table:1.1": (True, "a", "first row", None),
        "a::addr:table:1.9": (False, None, None, None),
        "a::addr:item:1.2": (True, "a", "item", None),
        "a::addr:item:1": (False, None, None, None),
        "a::addr:": (False, None, None, None),
    }
    asked = spark.createDataFrame([(k, 1) for k in want] * 2, "chunk_id string, source int")
    got = lookup.get_chunks(asked, chunks, addresses).collect()
    assert len(got) == len(want) and {r.chunk_id: (r.found, r.doc_id, r.text, r.error) for r in got} == want
    assert lookup.get_chunks(asked.limit(0), chunks, addresses).count() == 0
    assert not any(r.found for r in lookup.get_chunks(asked, chunks.limit(0), addresses.limit(0)).collect())


def test_outcome(spark):
    rows = [("which?", "generate", True, None, [1], "clarification"), ("", "generate", True, None, [], "ready"), (None, "abstain", True, "empty_pool", [0], "failed"), (None, "abstain", None, "empty_pool", [3], "empty"), (None, None, False, "gaps", [0, 0], "empty"), (None, None, False, None, None, "empty"), (None, "abstain", False, "gaps", [0, 2], "insufficient")]
    c = F.col
    out = lookup.outcome(c("c"), c("r"), c("f"), c("why"), c("a"))
    schema = "c string, r string, f boolean, why string, a array<int>"
    assert column(spark, [r[:5] for r in rows], schema, out) == [r[5] for r in rows]
    assert column(spark, [r[:5] for r in rows], schema, lookup.final_context(out, c("a"))) == [[] if r[4] is not None else None for r in rows]


def test_common_sample(spark):
    rows = [(1, "a", True), (1, "a", False), (1, "b", True), (2, "a", True), (2, "b", False), (3, "c", True), (4, "a", None), (1, "a", True)]
    got = {r.question: r.missing for r in review.common_sample(spark.createDataFrame(rows, "question int, variant string, ok boolean"), ["b", "a"]).collect()}
    assert got == {1: [], 2: ["b"], 3: ["b", "a"], 4: ["b", "a"]}


def test_reviews(spark):
    arbiter = spark.createDataFrame([(1, []), (2, ["x"]), (3, None), (4, [])], "n int, relevant array<string>")
    cited = spark.createDataFrame([(1,), (1,), (2,), (3,)], "n int")
    assert sorted(r.n for r in review.rejected_with_quote(arbiter, cited).collect()) == [1, 3]
    labels = spark.createDataFrame([(1, 5, "Один  ГОД"), (1, 5, "два"), (1, 6, "один"), (2, 5, None), (3, 5, "один"), (None, 5, "один")], "n int, chunk_id int, quote string")
    candidates = spark.createDataFrame([(1, 5, "срок\nодин год"), (2, 5, "x"), (3, 5, None)], "n int, chunk_id int, text string")
    got = {r.n: (r.n_labels, r.n_unverified) for r in review.unverified_quotes(labels, candidates).collect()}
    assert got == {1: (3, 2), 2: (1, 1), 3: (1, 1), None: (1, 1)}
    rows = [(True, False, True, True, "budget"), (True, False, False, True, "missing_parent"), (True, False, False, False, "other"), (True, True, True, True, None), (False, False, True, True, None)]
    assert column(spark, [r[:4] for r in rows], "a boolean, b boolean, c boolean, d boolean", review.loss_reason(*map(F.col, "abcd"))) == [r[4] for r in rows]
    rows = [("drop", 1.0, True), ("keep", 0.75, False), ("keep", 0.7, True), ("keep", None, True)]
    assert column(spark, [r[:2] for r in rows], "v string, c double", review.needs_human(F.col("v"), F.col("c"))) == [r[2] for r in rows]
