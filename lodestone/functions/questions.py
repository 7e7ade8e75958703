"""Column expressions that judge questions and pieces of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Questions about an act's number or history, about which act rules something, and about its structure (Java spelling).
META = (
    r"(?iuU)как(?:ой|им|ая|ие)\s+(?:федеральн\w+\s+)?закон\w*\s+(?:ввёл|ввел|введ\w*|внес\w*|изменил|утратил|отменил|дополнил)"
    r"|каким\s+(?:актом|приказом|постановлением)\s+|утратил\w*\s+силу|номер\s+(?:пункта|статьи|части|подпункта)|нов\w+\s+редакц|введена\s+редакц|в\s+ред\."
)
WHICH_ACT = (
    r"(?iuU)как(?:ой|ая|ое|ие|ого|их|им)\s+(?:\w+\s+){0,2}?(?:закон\w*|законодательств\w*|кодекс\w*|документ\w*|акт\w*|постановлени\w*|приказ\w*)\b"
    r"[^?]{0,60}?\b(?:регулир\w+|определ\w+|устанавлив\w+|регламентир\w+|действует|предусматрив\w+|осуществля\w+)"
)
STRUCTURE = (
    r"(?iuU)(?:согласно|в\s+соответствии\s+со?)\s+(?:настоящ\w+\s+|данн\w+\s+|указанн\w+\s+|трудов\w+\s+)*"
    r"(?:стать\w*|пункт\w*|част[ьияей]\w*|граф\w*|приложени\w*|раздел\w*|глав\w*|списк\w*|кодекс\w*|таблиц\w*)"
    r"|в\s+стать[ье]\w*\s*\d|как(?:ой|ое|ая|ие)\s+(?:пункт|стать|приложени|раздел|глав)"
)
# Marks of comparisons and of questions for one value, with the diversity each asks for.
COMPARISONS = ("сравни", "разница", "отличие", "коллизия", "приоритет", "что важнее", "противореч", "различия", "vs", "или лучше")
VALUES = ("пункт", "п.", "таблица", "табл.", "значение", "величина", "минимальн", "максимальн", "не менее", "не более", "сколько")
LAMBDAS = {"comparison": 0.5, "value": 0.95, "general": 0.7}
# Marks of a text that goes on elsewhere, and the length below which a passage needs its picture.
GOES_ON, SHORT = ("...", "продолжение следует", "см. далее", "таблица", "схема"), 150


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")


def weak_question(question: Column) -> Column:
    """A question about an act itself instead of what it says; null is none."""
    return F.coalesce(F.rlike(question, F.lit(META)) | F.rlike(question, F.lit(WHICH_ACT)) | F.rlike(question, F.lit(STRUCTURE)), F.lit(False))


def query_class(question: Column) -> Column:
    """struct<several_documents, diversity>: comparisons go before questions for a value; null is a general question."""
    low = F.lower(F.coalesce(question, F.lit("")))
    kind = lambda several, name: F.struct(F.lit(several).alias("several_documents"), F.lit(LAMBDAS[name]).alias("diversity"))
    return F.when(_any(low, COMPARISONS), kind(True, "comparison")).when(_any(low, VALUES), kind(False, "value")).otherwise(kind(False, "general"))


def incomplete(text: Column) -> Column:
    """The text says that it goes on, breaks off after more than five words, or is a list whose beginning is missing; empty texts are complete."""
    t = _stripped(text)
    broken = ~F.rlike(t, F.lit(r"[.?!;:]\z")) & (F.size(F.split(t, r"(?U)\s+")) > 5)
    tail = F.rlike(t, F.lit(r"(?md)(?U)^\s*[-*\d]+\s")) & ~F.rlike(t, F.lit(r"(?U)\A\s*(?:1\.|-|\*)\s"))
    return (t != "") & (_any(F.lower(t), GOES_ON) | broken | tail)


def needs_picture(text: Column, source: Column, page: Column, box: Column, element: Column) -> Column:
    """A passage whose place on a page is known, and which is a table, incomplete or short."""
    placed = (F.coalesce(source, F.lit("")) != "") & page.isNotNull() & F.coalesce(F.size(box) > 0, F.lit(False))
    return placed & (F.contains(F.lower(F.coalesce(element, F.lit(""))), F.lit("table")) | incomplete(text) | (F.length(_stripped(text)) < SHORT))
