"""Queries of the contract of an answer about one unit.

Every document is an answer. Its evidence are pieces of its own text, and its
items cite them by rules on doc_id, some wrongly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import contract
from lodestone.plans.catalog import query
from lodestone.session import table

MADE = """ev AS (SELECT doc_id AS id, unnest([{'eid': 'ext_001', 'level': 'external', 'text': substr(text, 1, 30), 'title': '', 'state': NULL}, {'eid': 'int_001', 'level': 'internal', 'text': substr(text, 31, 30), 'title': 'order ' || doc_id % 5, 'state': NULL},
{'eid': 'obj_s1', 'level': 'object', 'text': 'section ' || lang, 'title': 'sheet', 'state': NULL}, {'eid': 'obj_f_h', 'level': 'object', 'text': CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'height ' || doc_id % 40 END, 'title': NULL, 'state': CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE 'known' END}], recursive := true), source, lang AS locator FROM documents),
it AS (SELECT doc_id AS id, 'external_basis' AS part, 0 AS pn, 1 AS ord, 'norm ' || substr(text, 1, 12) AS statement, ['ext_001'] AS ids FROM documents WHERE doc_id % 3 <> 1
UNION ALL SELECT doc_id, 'internal_basis', 1, 1, 'rule ' || lang, CASE WHEN doc_id % 13 = 0 THEN ['ext_001'] ELSE ['int_001'] END FROM documents WHERE doc_id % 4 <> 1
UNION ALL SELECT doc_id, 'object_facts', 2, 1, CASE WHEN doc_id % 7 = 0 THEN 'Здесь требуется ' ELSE 'fact ' END || lang, CASE WHEN doc_id % 37 = 0 THEN [] ELSE ['obj_s1', 'obj_f_h'] END FROM documents WHERE doc_id % 5 > 1
UNION ALL SELECT doc_id, 'applied_conclusions', 3, 1, 'so ' || source, CASE WHEN doc_id % 17 = 0 THEN ['ext_001'] WHEN doc_id % 19 = 0 THEN ['obj_s1', 'nope'] WHEN doc_id % 8 = 6 THEN ['obj_f_h'] ELSE ['obj_f_h', 'int_001', 'ext_001'] END FROM documents WHERE doc_id % 2 = 0),
cited AS (SELECT it.*, k AS pos, ids[k] AS eid, ev.eid AS known, level, ev.text, title, source, locator, state FROM (SELECT *, unnest(CASE WHEN len(ids) = 0 THEN [1] ELSE range(1, len(ids) + 1) END) AS k FROM it) it LEFT JOIN ev ON ev.id = it.id AND ev.eid = ids[k])"""
DECIDED = f"""{MADE},
ok(part, level) AS (VALUES ('external_basis', 'external'), ('internal_basis', 'internal'), ('object_facts', 'object'), ('applied_conclusions', 'external'), ('applied_conclusions', 'internal'), ('applied_conclusions', 'object')),
one AS (SELECT c.id, c.part, c.ord, any_value(statement) AS statement, bool_or(ok.part IS NULL) OR c.part = 'applied_conclusions' AND NOT coalesce(bool_or(c.level = 'object'), false) AS bad, coalesce(bool_or(c.level = 'external'), false) AS e, coalesce(bool_or(c.level = 'internal'), false) AS i, coalesce(bool_or(state = 'unknown'), false) AS u FROM cited c LEFT JOIN ok USING (part, level) GROUP BY c.id, c.part, c.ord),
per AS (SELECT id, count(*) FILTER (bad) AS bad, bool_or(part LIKE 'appl%' AND u) AS u, bool_or(part LIKE 'appl%' AND NOT e AND NOT i) AS bare, bool_or(part = 'object_facts' AND contains(statement, 'требуется')) AS rule, bool_or(part = 'object_facts') AS f, bool_or(part LIKE 'appl%') AS a, bool_or(part LIKE 'ext%' OR part LIKE 'appl%' AND e) AS e, bool_or(part LIKE 'int%' OR part LIKE 'appl%' AND i) AS i FROM one GROUP BY id),
flat AS (SELECT doc_id AS id, coalesce(bad, 0) AS bad, coalesce(u, false) AS u, coalesce(bare, false) AS bare, coalesce(rule, false) AS rule, coalesce(f, false) AS f, coalesce(a, false) AS a, coalesce(e, false) AS e, coalesce(i, false) AS i FROM documents LEFT JOIN per ON id = doc_id),
rev AS (SELECT *, list_filter([CASE WHEN bare THEN 'applied_without_norm' END, CASE WHEN rule THEN 'object_fact_normative' END, CASE WHEN id % 31 = 0 AND (f OR a) THEN 'object_profile_not_requested' END,
CASE WHEN (id % 9 = 0 OR NOT (f AND NOT a AND NOT e AND NOT i)) AND NOT e THEN 'external_evidence_missing' END, CASE WHEN (id % 9 = 0 OR NOT (f AND NOT a AND NOT e AND NOT i)) AND id % 6 <> 0 AND NOT i THEN 'internal_evidence_missing' END,
CASE WHEN (f OR a) AND id % 14 = 0 THEN 'object_profile_undated' END, CASE WHEN id % 11 = 0 AND e AND i THEN 'possible_mismatch' END], lambda x: x IS NOT NULL) AS r FROM flat),
decided AS (SELECT id, CASE WHEN id % 23 = 0 THEN 'out_of_scope' WHEN bad > 0 THEN 'failed' WHEN id % 29 = 0 OR u THEN 'needs_context' WHEN len(r) > 0 THEN 'needs_review' ELSE 'answered' END AS status,
CASE WHEN id % 23 = 0 THEN [] WHEN bad > 0 THEN ['citation_invalid'] WHEN id % 29 = 0 THEN ['applicability_unclear'] WHEN u THEN ['applied_on_unknown_field'] ELSE r END AS reasons, bad AS n_problems FROM rev)"""


def _made(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    k, no = F.col("id"), F.lit(None).cast("string")
    piece = lambda eid, level, text, title, state=no: F.struct(F.lit(eid).alias("eid"), F.lit(level).alias("level"), text.alias("text"), title.alias("title"), state.alias("state"))
    say = lambda word, c: F.concat(F.lit(word), c.cast("string"))
    pieces = F.array(
        piece("ext_001", "external", F.substring("text", 1, 30), F.lit("")),
        piece("int_001", "internal", F.substring("text", 31, 30), say("order ", k % 5)),
        piece("obj_s1", "object", say("section ", F.col("lang")), F.lit("sheet")),
        piece("obj_f_h", "object", F.when(k % 6 == 0, "").otherwise(say("height ", k % 40)), no, F.when(k % 10 == 0, "unknown").otherwise("known")),
    )
    evidence = docs.select("id", F.inline(pieces), "source", F.col("lang").alias("locator"))
    ids = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    item = lambda holds, part, statement, cites: F.when(holds, F.struct(F.lit(part).alias("part"), F.lit(1).alias("ord"), statement.alias("statement"), cites.alias("evidence_ids")))
    four = F.array(
        item(k % 3 != 1, "external_basis", say("norm ", F.substring("text", 1, 12)), ids("ext_001")),
        item(k % 4 != 1, "internal_basis", say("rule ", F.col("lang")), F.when(k % 13 == 0, ids("ext_001")).otherwise(ids("int_001"))),
        item(k % 5 > 1, "object_facts", F.concat(F.when(k % 7 == 0, "Здесь требуется ").otherwise("fact "), "lang"), F.when(k % 37 == 0, ids()).otherwise(ids("obj_s1", "obj_f_h"))),
        item(k % 2 == 0, "applied_conclusions", say("so ", F.col("source")), F.when(k % 17 == 0, ids("ext_001")).when(k % 19 == 0, ids("obj_s1", "nope")).when(k % 8 == 6, ids("obj_f_h")).otherwise(ids("obj_f_h", "int_001", "ext_001"))),
    )
    items = docs.select("id", F.inline(F.array_compact(four)))
    answers = docs.select(
        "id",
        (k % 23 == 0).alias("out_of_scope"),
        F.when(k % 29 == 0, 1).otherwise(0).alias("n_questions"),
        (k % 11 == 0).alias("possible_mismatch"),
        (k % 14 != 0).alias("dated"),
        F.when(k % 6 == 0, ids("external")).otherwise(ids("external", "internal")).alias("requested"),
        F.when(k % 31 == 0, False).alias("sheet"),
        (k % 9 == 0).alias("strict"),
    )
    return answers, items, evidence


@query(
    f"""WITH {DECIDED} SELECT *, CASE status WHEN 'answered' THEN 'sufficient' WHEN 'out_of_scope' THEN status WHEN 'needs_context' THEN 'clarification_required' WHEN 'failed' THEN status ELSE CASE WHEN list_contains(reasons, 'possible_mismatch') THEN 'conflict' ELSE 'insufficient_evidence' END END AS shown,
CASE WHEN id % 5 <> 0 THEN status = CASE WHEN id % 3 = 0 THEN 'answered' ELSE 'failed' END AND list_sort(reasons) = CASE WHEN id % 3 = 0 THEN [] ELSE ['citation_invalid'] END OR status = 'needs_review' AND list_sort(reasons) = ['applied_without_norm', 'external_evidence_missing'] END AS as_expected FROM decided"""
)
def contract_status(spark, d):
    """Status, reasons and what is shown, held against expectations with an alternative whose reasons stand in another order."""
    got = contract.decide(*_made(spark, d))
    k, names = F.col("id"), lambda *n: F.array(*map(F.lit, n)) if n else F.array().cast("array<string>")
    block = lambda s, r: F.struct(s.alias("status"), r.alias("reasons"))
    expected = F.when(k % 5 != 0, F.array(block(F.when(k % 3 == 0, "answered").otherwise("failed"), F.when(k % 3 == 0, names()).otherwise(names("citation_invalid"))), block(F.lit("needs_review"), names("external_evidence_missing", "applied_without_norm"))))
    return got.withColumn("shown", contract.shown_status(F.col("status"), F.col("reasons"))).withColumn("as_expected", contract.as_expected(F.col("status"), F.col("reasons"), expected))


@query(
    f"""WITH {MADE}, ok(part, level) AS (VALUES ('external_basis', 'external'), ('internal_basis', 'internal'), ('object_facts', 'object'), ('applied_conclusions', 'external'), ('applied_conclusions', 'internal'), ('applied_conclusions', 'object'))
SELECT c.id, c.part, c.ord, c.eid, CASE WHEN c.eid IS NULL THEN 'no evidence' WHEN known IS NULL THEN 'unknown id' ELSE 'level' END AS problem FROM cited c LEFT JOIN ok USING (part, level) WHERE ok.part IS NULL
UNION ALL SELECT id, part, ord, NULL, 'no object evidence' FROM cited WHERE part = 'applied_conclusions' GROUP BY id, part, ord HAVING NOT bool_or(coalesce(level = 'object', false))"""
)
def citation_check(spark, d):
    _, items, evidence = _made(spark, d)
    return contract.check_citations(items, evidence)


@query(
    f"""WITH {MADE}, said AS (SELECT id, eid, part = 'object_facts' AS sheet, arg_min(statement, pn * 10 + ord) AS said FROM cited WHERE pn < 3 AND eid IS NOT NULL GROUP BY ALL),
u AS (SELECT c.id, c.ord, c.pos, c.statement, c.eid LIKE 'obj~_%' ESCAPE '~' AS sheet, c.eid LIKE 'ext~_%' ESCAPE '~' OR c.eid LIKE 'int~_%' ESCAPE '~' AS norm, nullif(coalesce(said, text), '') AS t FROM cited c LEFT JOIN said s ON s.id = c.id AND s.eid = c.eid AND s.sheet = (c.eid LIKE 'obj~_%' ESCAPE '~') WHERE pn = 3)
SELECT id, ord, coalesce(string_agg(t, ' · ' ORDER BY pos) FILTER (sheet), '') AS fact, coalesce(string_agg(t, ' · ' ORDER BY pos) FILTER (norm), '') AS requirement, any_value(statement) AS conclusion FROM u GROUP BY id, ord"""
)
def reasoning_chains(spark, d):
    _, items, evidence = _made(spark, d)
    return contract.reasoning_chains(items, evidence)


@query(
    f"""WITH {MADE}, k AS (SELECT *, row_number() OVER (PARTITION BY id, part, ord ORDER BY eid NOT LIKE 'obj~_f~_%' ESCAPE '~', pos) AS nth FROM cited WHERE known IS NOT NULL)
SELECT it.id, it.part, it.ord, pos - 1 AS pos, it.statement, coalesce(nullif(title, ''), source) AS title, locator FROM it LEFT JOIN k ON k.id = it.id AND k.part = it.part AND k.ord = it.ord AND (k.part <> 'object_facts' OR nth = 1)"""
)
def basis_cards(spark, d):
    _, items, evidence = _made(spark, d)
    return contract.basis_cards(items, evidence)
