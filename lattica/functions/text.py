"""String functions that follow Python's rules where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence marks cut off the end of a question, and marks cut
#: off both ends of a slot.
QUESTION_MARKS = "？?。"
TEMPLATE_MARKS = "？。"
SLOT_MARKS = "，,：:；;。？?、 "


def strip(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def normalized(question: Column, marks: str = QUESTION_MARKS) -> Column:
    return F.rtrim(strip(question), F.lit(marks))


def clean_slot(text: Column) -> Column:
    return F.btrim(strip(text), F.lit(SLOT_MARKS))


def before(text: Column, marker: str) -> Column:
    """What stands before the first marker; all without one."""
    return F.substring_index(text, marker, 1)


def after(text: Column, marker: str) -> Column:
    """What stands after the first marker; all without one."""
    at = F.locate(marker, text)
    return F.when(at > 0, F.substr(text, at + len(marker))).otherwise(text)


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
