"""Field-level rewrites and report lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

ROMAN_WORD = "[A-Za-z]+(?:'[A-Za-z]+)?"


def replace_field(rows: DataFrame, field: str, change: Callable[[Column], Column]) -> DataFrame:
    """Changes a field, keeps the old one as <field>_original, and tells whether they differ. [FN14]"""
    new = change(F.col(field))
    return rows.withColumn(f"{field}_original", F.col(field)).withColumn(field, new).withColumn("changed", ~F.col(field).eqNullSafe(F.col(f"{field}_original")))


def roman_words(text: Column) -> Column:
    """Array of (word, before, after): the Latin words of a text and the characters next to them ('' at its ends). [FN15]"""
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit("(?s)" + pattern), group)
    return F.arrays_zip(found(ROMAN_WORD, 0).alias("word"), found("(?:(?<=(.))|^)" + ROMAN_WORD, 1).alias("before"), found(ROMAN_WORD + "(?=(.)|$)", 1).alias("after"))


def stays_roman(x: Column, frequent: tuple[str, ...] = fixed.COMMON) -> Column:
    """Words that a transliterator must leave: links, capitals of over four letters, frequent English, parts of placeholders. [FN15]"""
    low = F.lower(x["word"])
    loud = (x["word"] == F.upper(x["word"])) & (F.length(x["word"]) > 4)
    return low.isin(*fixed.SKIPPED, *frequent) | low.startswith("http") | loud | F.coalesce(x["before"].isin("{", "[", "_"), F.lit(False)) | F.coalesce(x["after"].isin("}", "_", "]"), F.lit(False))


def table_line(*cells: Column) -> Column:
    """A Markdown table row. [LLM8]"""
    parts: list[Column] = []
    for c in cells:
        parts += [F.lit(" | " if parts else "| "), c]
    return F.concat(*parts, F.lit(" |"))
