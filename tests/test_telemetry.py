"""Telemetry rows, sinks that fail, replay, and the glossary."""

import json
import re

from pyspark.sql import functions as F

from lodestone.operators import glossary as gl
from lodestone.operators import telemetry as tm
from lodestone.streaming import sinks

STATE = "query_id string, run_id string, ts timestamp, source string, query string, abstain_reason string, clarify_message string, stages array<string>, answer string, n_found int, latency_ms double, usages array<struct<model: string, prompt_tokens: int, completion_tokens: int, n_passages: int>>, error string, generation_failed boolean, generation_error string"


def test_projection(spark):
    calls = [("m", 1_000_000, 500_000, 3), ("x", 7, None, None), (None, 1, 1, 2), ("x", 1, 1, None)]
    rows = [
        ("a", "r", None, "api", "q", "none", "which", ["complex"], "ответ", 9, 12.9, calls, None, False, None),
        ("b", None, None, "ui", None, "", "which", ["complex"], None, None, None, None, None, None, None),
        ("c", None, None, "ui", "q", None, None, ["simple", "complex"], "x", 4, 1.0, [("m", 10, 0, None)], None, True, "Timeout"),
        ("d", None, None, "ui", "q", None, None, None, "x", 4, 1.0, [], "given", True, "Timeout"),
    ]
    out = tm.project_events(spark.createDataFrame(rows, STATE), {"m": (2.0, 4.0)})
    assert out.columns == tm.COLUMNS and len(tm.COLUMNS) == 16
    got = {r.query_id: r for r in out.collect()}
    assert [got[k].path for k in "abcd"] == ["abstain", "clarify", "complex", "simple"]
    assert (got["a"].n_passages, got["a"].n_passages_found, got["a"].prompt_tokens, got["a"].completion_tokens, got["a"].cost_usd, got["a"].unpriced_models, got["a"].latency_ms, got["a"].answer_len) == (5, 9, 1_000_009, 500_002, 4.0, ["x", "unknown"], 12, 5)
    assert (got["b"].question, got["b"].answer_len, got["b"].n_passages, got["b"].latency_ms, got["b"].cost_usd, got["b"].models, got["b"].error) == ("", 0, 0, 0, 0.0, [], None)
    assert (got["c"].n_passages, got["c"].error, got["d"].error) == (4, "generation_failed: Timeout", "given")
    assert tm.project_events(spark.createDataFrame(rows, STATE), {}).filter("query_id = 'c'").first().unpriced_models == ["m"]


def events(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, n_passages long, n_passages_found long")


def test_known_keys_and_retries(spark, tmp_path):
    rows = events(spark, ("a", 1, 1), ("b", 2, 2), ("a", 0, 9), (None, 1, 1))
    table = sinks.KeyedTable(str(tmp_path / "t"), rows.schema)
    assert table.read(spark).count() == 0
    for _ in range(3):  # the same batch again and again
        table.write(rows, 0)
    table.write(events(spark, ("b", 7, 7), ("c", 3, 3)), 1)
    table.write(events(spark, ("b", 7, 7), ("c", 3, 3)), 1)
    assert sorted(map(tuple, table.read(spark).collect())) == [("a", 0, 9), ("b", 2, 2), ("c", 3, 3)]


def test_a_stream_survives_its_table(spark, tmp_path):
    schema = events(spark).schema
    source, table, journal = tmp_path / "in", sinks.KeyedTable(str(tmp_path / "t"), schema), sinks.Journal(str(tmp_path / "j"))
    source.mkdir()

    def flaky(rows, batch):
        if batch == 1:
            raise ConnectionError("the table is down")
        table.write(rows, batch)

    sink = sinks.Fallback(flaky, journal.write)
    for n in range(3):
        (source / f"{n}.json").write_text("".join(json.dumps({"query_id": f"q{n}{k % 2}", "n_passages": n, "n_passages_found": None}) + "\n" for k in range(3)))
        query = sinks.start(spark.readStream.schema(schema).json(str(source)), sink, str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None
    ids = lambda: sorted(r.query_id for r in table.read(spark).collect())
    assert ids() == ["q00", "q01", "q20", "q21"] and sink.lost == []
    (tmp_path / "j" / "torn.json").write_text('{"query_id": "torn", "n_pa\n{"n_passages": 1}\n[1]\n')
    assert sinks.replay(spark, journal, table) == sinks.Report(3, 2, 3)
    assert ids() == ["q00", "q01", "q10", "q11", "q20", "q21"]
    assert table.read(spark).filter("query_id = 'q10'").first().n_passages_found == 1
    assert sinks.replay(spark, journal, table, "again") == sinks.Report(3, 0, 3) and len(ids()) == 6


def test_nothing_reaches_the_stream(spark):
    def broken(rows, batch):
        raise OSError("full")

    sink = sinks.Fallback(broken, broken)
    sink(events(spark, ("a", 1, 1)), 4)
    assert sink.lost == [4]


def plain_pattern(term):
    parts = [r"\b" + (re.escape(w[:-2]) + r"\w{0,3}\b" if len(w) > 4 else re.escape(w) + r"\b") for w in term.lower().split()]
    return re.compile(r"\s+".join(parts), re.IGNORECASE)


def test_glossary(spark, tmp_path):
    (tmp_path / "g.yaml").write_text('terms:\n  "Программа А":\n    official: "общие вопросы"\n  "соут":\n    official: "оценка условий"\n  "пустой":\n    source: "x"\n  "охрана труда":\n    official: "система мер"\n  "п/п":\n    official: "по порядку"\n', encoding="utf-8")
    glossary = gl.read_glossary(spark, str(tmp_path / "g.yaml"))
    terms = [(r.ord, r.term, r.official) for r in glossary.orderBy("ord").collect()]
    assert [t[1] for t in terms] == ["программа а", "соут", "охрана труда", "п/п"]
    assert gl.read_glossary(spark, str(tmp_path / "none.yaml")).count() == 0
    texts = ["О программе а и охране труда", "программах\n А, СОУТ", "программа абв", "состоять и создание соута", "охраной  трудами", "охранники труда", "номер п/п", "", None, "охрана, труда", "[Программы] а"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {}
    for n, t in enumerate(texts):
        found = [f"{term} → {official}" for _, term, official in terms if t and plain_pattern(term).search(t)]
        want[n] = t + "\n\n[Глоссарий: " + "; ".join(found) + "]" if found else t
    got = {r.id: r.text for r in gl.expand(frame, glossary).collect()}
    assert got == want and sum("Глоссарий" in (t or "") for t in got.values()) == 3
    assert gl.expand(frame, glossary.limit(0)).filter(F.col("text").contains("Глоссарий")).count() == 0


def test_glossary_on_random_texts(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pieces = ["право", "правовой", "правами", "акт", "акты", "закон", "законами", "о", "об", "труде", ",", "-"]
    terms = [" ".join(rng.choice(pieces[:10], int(rng.integers(1, 4)))) for _ in range(25)]
    texts = [" ".join(rng.choice(pieces, 12)) for _ in range(80)]
    glossary = spark.createDataFrame([(n, t, "x") for n, t in enumerate(terms)], "ord int, term string, official string")
    got = {(r.id, r.ord) for r in gl.find_terms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), glossary).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n, term in enumerate(terms) if plain_pattern(term).search(t)} and len(got) > 50


def test_glossary_with_ascii_words(spark):
    """As RE2 has it: other letters are no parts of words, so they stand beside a term, and the ending stops at them."""
    rows = [(0, "éci de"), (1, "ci deé"), (2, "treois une"), (3, "treoié une"), (4, "aci de"), (5, "CI\n De, treo une")]
    glossary = spark.createDataFrame([(0, "ci de", "A"), (1, "treoi une", "B")], "ord int, term string, official string")
    texts = spark.createDataFrame(rows, "id int, text string")
    assert {(r.id, r.ord) for r in gl.find_terms(texts, glossary, ascii=True).collect()} == {(0, 0), (1, 0), (2, 1), (5, 0), (5, 1)}


def test_glossary_words_meet_without_patterns(spark):
    """With ASCII words, terms of one and two words are joined with the words of the texts; other terms keep their patterns."""
    import random

    rng = random.Random(5)
    pieces = ["act", "acts", "actio", "action", "actions", "a", "as", "b_1", "é", ",", "x-y", "|", "\t", "\n", "\u00a0"]
    texts = ["".join(w if w in "\t\n" else w + rng.choice([" ", "  ", " ", ""]) for w in rng.choices(pieces, k=14)).upper() for _ in range(150)] + [None, "", "action"]
    terms = ["action", "a", "action as", "acts b_1", "actions actions", "a as act", "x-y a", "action é", "as a", "b_1"]
    glossary = spark.createDataFrame([(n, t, "x") for n, t in enumerate(terms)], "ord int, term string, official string")
    word = lambda w: re.escape(w[:-2]) + r"\w{0,3}" if len(w) > 4 else re.escape(w)
    plain = [re.compile(r"[\t\n\f\r ]+".join(rf"\b{word(w)}\b" if re.fullmatch(r"\w+", w, re.A) else rf"{'' if not w[0].isascii() else chr(92) + 'b'}{re.escape(w)}{'' if not w[-1].isascii() else chr(92) + 'b'}" for w in t.split()), re.A) for t in terms]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.ord) for r in gl.find_terms(frame, glossary.filter("term <> 'action é'"), ascii=True).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n, p in enumerate(plain) if t and n != 7 and p.search(t.lower())} and {n for _, n in got} >= {0, 1, 2, 3, 4, 8, 9}
    simple = gl.find_terms(frame, glossary.filter("ord < 5"), ascii=True)
    assert "pattern#" not in simple._jdf.queryExecution().optimizedPlan().toString()
