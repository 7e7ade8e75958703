"""Numbered tables as rows: continuations joined, rows folded to texts, chunks of such tables replaced in place.

Tables are doc, ord (their order), ref, page, width and grid (an array of rows of cells).
Finding what continues and what replaces what are joins and windows over
all documents, prefix scans where one has very many tables. Only the rows of one merged table are folded in order, inside its
row, since titles wait for the next numbered row and torn words join the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import appended, let, strings
from lodestone.functions.text import token_estimate
from lodestone.operators.scan import BLOCK, carry_last, running_number
from lodestone.operators.settle import settle

# What numbers a row, how many tokens a text may have, below how many a run of plain rows joins a neighbour, and the words of a row's head.
ROW_ID, BUDGET, LOOSE_LEAST, SLACK = r"(?U)^\d+(\.\d+)*\.?$", 400, 20, 8
PARENT, COLUMN, NO_HEADING = "Пункт ", "Колонка 1: ", "Document start"

Tokens = Callable[[Column], Column]
UNIT = "array<struct<row_id: string, text: string>>"


def merged_tables(tables: DataFrame, whole: int = BLOCK) -> DataFrame:
    """Adds ``grp``: a table goes on in the next one of its document if that has the same width and stands on the next page.

    Tables are exchanged once, by document; those of a document with more than ``whole`` tables go through prefix scans.
    """
    large = settle(tables.groupBy("doc").agg(F.count("*").alias("__n")).filter(F.col("__n") > whole).select(F.col("doc").alias("__doc")), "large")
    if large.isEmpty():
        return _merged_at_once(tables)
    parted = lambda how: tables.join(large, F.col("doc").eqNullSafe(F.col("__doc")), how)
    return _merged_at_once(parted("left_anti")).unionByName(_merged_by_scans(parted("left_semi")))


def _goes_on(last: str) -> Column:
    return F.coalesce((F.col(f"{last}.width") == F.col("width")) & (F.col("page") - F.col(f"{last}.page") == 1), F.lit(False))


def _merged_at_once(tables: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("doc").orderBy("ord")
    seen = tables.withColumn("__last", F.lag(F.struct("page", "width")).over(in_order)).withColumn("__opens", (~_goes_on("__last")).cast("long"))
    return seen.withColumn("grp", F.sum("__opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("__last", "__opens")


def _merged_by_scans(tables: DataFrame) -> DataFrame:
    seen = carry_last(tables, ["doc"], "ord", "__last", F.struct("page", "width"), inclusive=False)
    return running_number(seen, ["doc"], "ord", "grp", ~_goes_on("__last")).drop("__last")


def _words_packed(line: Column, room: Column, tokens: Tokens) -> Column:
    def add(acc: Column, w: Column) -> Column:
        full = (acc["cur"] != "") & (tokens(F.concat(acc["cur"], F.lit(" "), w)) > room)
        return F.struct(F.when(full, appended(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(full | (acc["cur"] == ""), w).otherwise(F.concat(acc["cur"], F.lit(" "), w)).alias("cur"))

    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    return F.aggregate(words, F.struct(strings().alias("done"), F.lit("").alias("cur")), add, lambda acc: appended(acc["done"], acc["cur"]))


def pack_lines(head: Column, body: Column, budget: int, tokens: Tokens) -> Column:
    """Lines to texts of at most ``budget`` tokens, each of which opens with the head's lines; a line that is too long is cut between words, nothing is left out."""

    def packed(top: Column) -> Column:
        room = F.lit(budget - SLACK) - tokens(top)
        lines = F.flatten(F.transform(body, lambda b: F.when(tokens(b) <= room, F.array(b)).otherwise(_words_packed(b, room, tokens))))
        under = lambda cur, line: F.when(cur == "", line).otherwise(F.concat(cur, F.lit("\n"), line))

        def add(acc: Column, line: Column) -> Column:
            full = (acc["n"] > 0) & (tokens(under(acc["cur"], line)) > budget)
            return F.struct(F.when(full, appended(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), under(F.when(full, top).otherwise(acc["cur"]), line).alias("cur"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"))

        start = F.struct(strings().alias("done"), top.alias("cur"), F.lit(0).alias("n"))
        return F.aggregate(lines, start, add, lambda acc: appended(acc["done"], acc["cur"]))

    return let(F.array_join(head, "\n"), packed)


def fold_rows(rows: Column, budget: int = BUDGET, loose_least: int = LOOSE_LEAST, tokens: Tokens = token_estimate) -> Column:
    """array<struct<row_id, text>> of a merged table's rows (arrays of trimmed cells, none empty, none twice).

    A numbered row opens with the row it is part of, if that came before. Plain
    rows between numbered ones are a text of their own; short ones go to the row
    before if they start in lower case or without letters, else they wait for the
    next row; what still waits at the end goes to the last one.
    """
    texts = lambda of, row_id: F.transform(of, lambda t: F.struct(row_id.alias("row_id"), t.alias("text")))
    none = F.lit(None).cast("string")

    def seen(row: Column) -> Column:
        first = F.get(row, F.lit(0))
        row_id = F.regexp_replace(first, r"\.+$", "")
        return F.struct(
            F.rlike(first, F.lit(ROW_ID)).alias("numbered"),
            first.alias("first"),
            row_id.alias("row_id"),
            F.when(F.contains(row_id, F.lit(".")), F.regexp_extract(row_id, r"^(.*)\.[^.]*$", 1)).alias("parent"),
            F.when(F.size(row) > 1, F.get(row, F.lit(1))).alias("second"),
            F.filter(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), lambda t: t != "").alias("rest"),
            F.array_join(F.array_distinct(F.filter(row, lambda t: t != "")), " | ").alias("plain"),
        )

    def behind(units: Column, text: Column) -> Column:
        """The last unit goes on with a text."""
        last = F.element_at(units, -1)
        return F.concat(F.slice(units, F.lit(1), F.size(units) - 1), F.array(F.struct(last["row_id"].alias("row_id"), F.concat(last["text"], F.lit("\n"), text).alias("text"))))

    def flushed(acc: Column) -> Column:
        """The state when no plain rows are held any more."""

        def worked(text: Column) -> Column:
            letter = F.regexp_extract(text, r"\p{L}", 0)
            joins = (letter == "") | ((letter == F.lower(letter)) & (letter != F.upper(letter)))
            short = tokens(text) < loose_least
            back = short & joins & (F.size(acc["units"]) > 0) & (F.size(acc["pending"]) == 0)
            own = texts(pack_lines(strings(), F.concat(acc["pending"], acc["loose"]), budget, tokens), none)
            idle = F.size(acc["loose"]) == 0
            units = F.when(idle, acc["units"]).when(back, behind(acc["units"], text)).when(short, acc["units"]).otherwise(F.concat(acc["units"], own))
            waits = F.when(idle | back, acc["pending"]).when(short, appended(acc["pending"], text)).otherwise(strings())
            return F.struct(units.alias("units"), acc["ids"].alias("ids"), strings().alias("loose"), waits.alias("pending"))

        return let(F.array_join(acc["loose"], "\n"), worked)

    def add(acc: Column, r: Column) -> Column:
        def numbered(s: Column) -> Column:
            parent = F.get(F.filter(s["ids"], lambda x: x["id"] == r["parent"]), F.lit(0))
            named = F.when(parent["second"].isNotNull(), F.array(F.concat(F.lit(PARENT), r["parent"], F.lit(": "), parent["second"]))).otherwise(strings())
            head = F.concat(s["pending"], named, F.array(F.concat(F.lit(COLUMN), r["first"])), F.slice(r["rest"], F.lit(1), F.lit(1)))
            body = F.slice(r["rest"], F.lit(2), F.greatest(F.size(r["rest"]) - 1, F.lit(0)))
            known = F.exists(s["ids"], lambda x: x["id"] == r["row_id"])
            ids = F.when(known, s["ids"]).otherwise(appended(s["ids"], F.struct(r["row_id"].alias("id"), r["second"].alias("second"))))
            return F.struct(F.concat(s["units"], texts(pack_lines(head, body, budget, tokens), r["row_id"])).alias("units"), ids.alias("ids"), strings().alias("loose"), strings().alias("pending"))

        held = F.struct(acc["units"].alias("units"), acc["ids"].alias("ids"), appended(acc["loose"], r["plain"]).alias("loose"), acc["pending"].alias("pending"))
        return F.when(r["numbered"], let(flushed(acc), numbered)).otherwise(held)

    def finish(acc: Column) -> Column:
        def end(s: Column) -> Column:
            tail = F.array_join(s["pending"], "\n")
            return F.when(F.size(s["pending"]) == 0, s["units"]).when(F.size(s["units"]) > 0, behind(s["units"], tail)).otherwise(F.array(F.struct(none.alias("row_id"), tail.alias("text"))))

        return let(flushed(acc), end)

    start = F.struct(F.array().cast(UNIT).alias("units"), F.array().cast("array<struct<id: string, second: string>>").alias("ids"), strings().alias("loose"), strings().alias("pending"))
    return F.aggregate(F.transform(rows, seen), start, add, finish)


def table_units(tables: DataFrame, budget: int = BUDGET, loose_least: int = LOOSE_LEAST, tokens: Tokens = token_estimate) -> DataFrame:
    """doc, grp, refs, units of the merged tables that have a numbered row."""
    clean = F.transform("grid", lambda row: F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    parts = merged_tables(tables).groupBy("doc", "grp").agg(F.array_sort(F.collect_list(F.struct("ord", "ref", clean.alias("grid")))).alias("parts"))
    rows = F.array_distinct(F.filter(F.flatten(F.transform("parts", lambda p: p["grid"])), lambda row: F.exists(row, lambda c: c != "")))
    whole = parts.select("doc", "grp", F.transform("parts", lambda p: p["ref"]).alias("refs"), rows.alias("rows"))
    whole = whole.filter(F.exists("rows", lambda row: F.rlike(F.get(row, F.lit(0)), F.lit(ROW_ID))))
    return whole.select("doc", "grp", "refs", fold_rows(F.col("rows"), budget, loose_least, tokens).alias("units"))


def replace_table_chunks(chunks: DataFrame, tables: DataFrame, **how) -> DataFrame:
    """chunks: doc, ord, refs (array), text, section -> doc, ord, part, text, section, table_row_id.

    Where all of a chunk's references lie in one merged, numbered table, the
    first such chunk gives way to the table's units (part 0, 1, ... at its ord), each under
    the section's name, and the others go. All other chunks stay, as part 0.
    """
    units = settle(table_units(tables, **how), "units")
    group_of = units.select(F.col("doc").alias("__doc"), "grp", F.explode("refs").alias("__ref"))
    asked = chunks.select("doc", "ord", F.explode("refs").alias("__ref"))
    met = asked.join(group_of, F.col("doc").eqNullSafe(F.col("__doc")) & (asked["__ref"] == group_of["__ref"]), "left").select("doc", "ord", "grp")
    pure = met.groupBy("doc", "ord").agg(F.min("grp").alias("grp"), F.max("grp").alias("__other"), F.count_if(F.col("grp").isNull()).alias("__out")).filter("__out = 0 and grp = __other").select("doc", "ord", "grp")
    first = pure.groupBy("doc", "grp").agg(F.min("ord").alias("ord"))
    kept = chunks.join(pure, ["doc", "ord"], "left_anti").select("doc", "ord", F.lit(0).alias("part"), "text", "section", F.lit(None).cast("string").alias("table_row_id"))
    sections = chunks.select("doc", "ord", "section")
    heading = F.when((F.coalesce("section", F.lit("")) != "") & (F.col("section") != NO_HEADING), F.col("section"))
    new = first.join(sections, ["doc", "ord"]).join(units.select("doc", "grp", "units"), ["doc", "grp"]).select("doc", "ord", "section", F.posexplode("units").alias("part", "u"))
    text = F.regexp_replace(F.concat_ws("\n", heading, F.col("u.text")), r"(?U)^\s+|\s+$", "")
    return kept.unionByName(new.select("doc", "ord", "part", text.alias("text"), "section", F.col("u.row_id").alias("table_row_id")))
