"""The contract of an answer about one unit: what it may cite, which status follows, what is shown.

An answer is three tables. ``answers``: id, out_of_scope, n_questions (what it
asks back), possible_mismatch, dated (the unit's sheet has a date), requested
(array of levels), sheet (asked for, true or false; null: not said), strict
(norms are needed in any case). ``items``: id, part, ord, statement,
evidence_ids. ``evidence``: id, eid (unique in an answer), level, text, source,
title, locator, state. All joins are on (id, eid), so a popular piece of
evidence is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of an answer, in order, and the levels each may cite.
PARTS = {
    "external_basis": ("external",),
    "internal_basis": ("internal",),
    "object_facts": ("object",),
    "applied_conclusions": ("external", "internal", "object"),
}
# Fixed value: stems that betray a rule where only a fact may stand (Java spelling).
NORMATIVE = r"(?iuU)(?<!\w)(?:требуется|необходим|должен(?!\w)|должн[аоыуе](?!\w)|достаточн|допуска|запрещ|обязан|не\s+снижа|не\s+менее|не\s+более)"
# Prefixes of evidence ids, and what stands between texts of a chain.
SHEET, FIELD, NORMS, DOT = "obj_", "obj_f_", ("ext_", "int_"), " · "
# Reasons that make a review a conflict, and what is shown for the other statuses.
CONFLICTS = ("possible_mismatch", "verification_contradiction")
SHOWN = {"answered": "sufficient", "out_of_scope": "out_of_scope", "needs_context": "clarification_required", "failed": "failed"}

def _is(part: str) -> Column:
    return F.col("part") == part


def _cited(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row per item and id it cites, with the evidence if there is any; an item without ids keeps one row."""
    known = evidence.select("id", "eid", F.lit(True).alias("known"), "level", "text", "source", "title", "locator", "state")
    return items.select("id", "part", "ord", "statement", F.posexplode_outer("evidence_ids").alias("pos", "eid")).join(known, ["id", "eid"], "left")


def _problem() -> Column:
    """What is wrong with one cited id, or null."""
    allowed = F.lit(False)
    for part, levels in PARTS.items():
        allowed = allowed | (_is(part) & F.col("level").isin(*levels))
    return F.when(F.col("eid").isNull(), "no evidence").when(F.col("known").isNull(), "unknown id").when(~F.coalesce(allowed, F.lit(False)), "level")


def check_citations(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """-> id, part, ord, eid, problem: items without evidence, unknown ids, levels a part may not cite, conclusions without the sheet."""
    rows = _cited(items, evidence).withColumn("problem", _problem())
    single = rows.filter("problem IS NOT NULL").select("id", "part", "ord", "eid", "problem")
    applied = rows.filter(_is("applied_conclusions") & F.col("eid").isNotNull()).groupBy("id", "part", "ord").agg(F.max(F.coalesce(F.col("level") == "object", F.lit(False))).alias("sheet"))
    return single.unionByName(applied.filter("NOT sheet").select("id", "part", "ord", F.lit(None).cast("string").alias("eid"), F.lit("no object evidence").alias("problem")))


def decide(answers: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """-> id, status, reasons, n_problems. The first that holds: out of scope, a citation that fails, a question back, a conclusion on an unknown field, reasons for a review, answered.

    An answer without items cites nothing. n_problems counts items with a fault, whatever the status.
    """
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)))
    level = F.col("level")
    per_item = (
        _cited(items, evidence)
        .groupBy("id", "part", "ord")
        .agg(
            yes(_problem().isNotNull()).alias("bad"),
            *(yes(level == name).alias(name) for name in ("external", "internal", "object")),
            yes(F.col("state") == "unknown").alias("unknown"),
            yes(F.rlike("statement", F.lit(NORMATIVE))).alias("rule"),
        )
        .withColumn("bad", F.col("bad") | (_is("applied_conclusions") & ~F.col("object")))
    )
    applied, fact = _is("applied_conclusions"), _is("object_facts")
    norm = F.col("external") | F.col("internal")
    per = per_item.groupBy("id").agg(
        F.count_if("bad").alias("n_problems"),
        yes(applied & F.col("unknown")).alias("unknown"),
        yes(applied & ~norm).alias("bare"),
        yes(fact & F.col("rule")).alias("rule"),
        yes(fact).alias("facts"),
        yes(applied).alias("applied"),
        yes(_is("external_basis") | (applied & F.col("external"))).alias("ext"),
        yes(_is("internal_basis") | (applied & F.col("internal"))).alias("int"),
    )
    flags = [c for c in per.columns if c not in ("id", "n_problems")]
    rows = answers.join(per, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {"n_problems": F.coalesce("n_problems", F.lit(0))})
    c = {name: F.col(name) for name in flags}
    cites = c["facts"] | c["applied"]
    needed = F.col("strict") | ~(c["facts"] & ~c["applied"] & ~c["ext"] & ~c["int"])
    asked = lambda name: F.array_contains("requested", name)
    found = (
        ("applied_without_norm", c["bare"]),
        ("object_fact_normative", c["rule"]),
        ("object_profile_not_requested", ~F.coalesce("sheet", F.lit(True)) & cites),
        ("external_evidence_missing", needed & asked("external") & ~c["ext"]),
        ("internal_evidence_missing", needed & asked("internal") & ~c["int"]),
        ("object_profile_undated", cites & ~F.col("dated")),
        ("possible_mismatch", F.col("possible_mismatch") & c["ext"] & c["int"]),
    )
    review = F.array_compact(F.array(*(F.when(holds, name) for name, holds in found)))
    none, one = F.array().cast("array<string>"), lambda r: F.array(F.lit(r))
    first = lambda *pairs: F.when(F.col("out_of_scope"), pairs[0]).when(F.col("n_problems") > 0, pairs[1]).when(F.col("n_questions") > 0, pairs[2]).when(c["unknown"], pairs[3])
    reasons = first(none, one("citation_invalid"), one("applicability_unclear"), one("applied_on_unknown_field")).otherwise(review)
    status = first(F.lit("out_of_scope"), F.lit("failed"), F.lit("needs_context"), F.lit("needs_context")).otherwise(F.when(F.size(review) > 0, "needs_review").otherwise("answered"))
    return rows.select("id", status.alias("status"), reasons.alias("reasons"), F.col("n_problems").cast("long").alias("n_problems"))


def shown_status(status: Column, reasons: Column) -> Column:
    """What a reader sees; in a review a conflict goes before missing evidence."""
    code = F.when(F.arrays_overlap(reasons, F.array(*map(F.lit, CONFLICTS))), "conflict").otherwise("insufficient_evidence")
    for status_, shown in SHOWN.items():
        code = F.when(status == status_, shown).otherwise(code)
    return code


def as_expected(status: Column, reasons: Column, expected: Column) -> Column:
    """Status and reasons, in any order, equal one of array<struct<status, reasons>>; null where nothing is expected."""
    same = lambda e: e["status"].eqNullSafe(status) & (F.array_sort(F.coalesce(e["reasons"], F.array().cast("array<string>"))) == F.array_sort(reasons))
    return F.when(F.size(expected) > 0, F.exists(expected, same))


def forbidden_hits(texts: Column, forbidden: Column) -> Column:
    """The phrases, in order, that stand in one of the texts, case and white space aside; blank phrases are none."""
    plain = lambda t: F.lower(F.regexp_replace(t, r"(?U)\s+", " "))
    hay = plain(F.array_join(texts, " \n ", ""))
    return F.filter(forbidden, lambda p: (F.trim(plain(p)) != "") & F.contains(hay, F.trim(plain(p))))


def reasoning_chains(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """-> id, ord, fact, requirement, conclusion for each applied conclusion.

    An id of the sheet stands for the first fact that cites it, an id of a norm
    for the first basis that does (external before internal); failing that for
    the evidence's own text. Empty texts are left out.
    """
    place = F.struct(F.coalesce(*(F.when(_is(p), k) for k, p in enumerate(PARTS))), "ord")
    said = (
        items.filter(~_is("applied_conclusions"))
        .select("id", _is("object_facts").alias("of_sheet"), place.alias("place"), "statement", F.explode("evidence_ids").alias("eid"))
        .groupBy("id", "eid", "of_sheet")
        .agg(F.min_by("statement", "place").alias("said"))
    )
    sheet = F.col("eid").startswith(SHEET)
    norm = F.col("eid").startswith(NORMS[0]) | F.col("eid").startswith(NORMS[1])
    used = _cited(items.filter(_is("applied_conclusions")), evidence).withColumn("of_sheet", F.when(sheet, True).when(norm, False))
    texts = used.join(said, ["id", "eid", "of_sheet"], "left").withColumn("t", F.nullif(F.coalesce("said", "text"), F.lit("")))
    part = lambda of: F.array_sort(F.collect_list(F.when(F.col("t").isNotNull() & (F.col("of_sheet") == of), F.struct("pos", "t"))))
    per = texts.groupBy("id", "ord").agg(F.first("statement").alias("conclusion"), part(True).alias("f"), part(False).alias("r"))
    line = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), DOT)
    return per.select("id", "ord", line("f").alias("fact"), line("r").alias("requirement"), "conclusion")


def basis_cards(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """-> id, part, ord, pos, statement, title, locator: a card per item and source it cites.

    An item without known sources has one card with its statement alone (pos
    null). A fact has one card only, of its first typed field, else of its first
    source. A title that is missing or empty is the source's name.
    """
    rows = _cited(items, evidence)
    keep = F.struct((~F.col("eid").startswith(FIELD)).alias("plain"), "pos")
    card = F.struct("pos", F.coalesce(F.nullif(F.col("title"), F.lit("")), "source").alias("title"), "locator")
    known = rows.filter("known")
    facts = known.filter(_is("object_facts")).groupBy("id", "part", "ord").agg(F.min_by(card, keep).alias("c"))
    cards = known.filter(~_is("object_facts")).select("id", "part", "ord", card.alias("c")).unionByName(facts)
    out = items.select("id", "part", "ord", "statement").join(cards, ["id", "part", "ord"], "left")
    return out.select("id", "part", "ord", F.col("c.pos").alias("pos"), "statement", F.col("c.title").alias("title"), F.col("c.locator").alias("locator"))
