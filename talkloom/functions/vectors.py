"""Vectors as array columns; sums run in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, missing: float = -1.0, strict: bool = True) -> Column:
    """Cosine; ``missing`` where a vector is empty, has no length or (strict) another size. [FN30, FN31]"""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    bad = F.coalesce(norm == 0, F.lit(True))
    if strict:
        bad = bad | (F.coalesce(F.size(a), F.lit(-1)) != F.coalesce(F.size(b), F.lit(-1)))
    return F.when(bad, F.lit(missing)).otherwise(dot(a, b) / norm)


def hashed_bag(tokens: Column, dims: int = 48) -> Column:
    """Signed hashed bag of words, scaled to length 1, six digits. [FN29]"""
    placed = F.transform(F.transform(tokens, lambda t: F.sha2(t, 256)), lambda h: F.struct((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims).alias("at"), F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1).alias("sign")))
    sums = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(p, lambda x: x["at"] == i), F.lit(0), lambda s, x: s + x["sign"]).cast("double"))
    length = lambda raw: F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda raw: let(length(raw), lambda n: F.transform(raw, lambda x: F.when(n > 0, F.round(x / n, 6)).otherwise(F.lit(0.0))))
    return let(placed, lambda p: let(sums(p), unit))


def read_vector(text: Column) -> Column:
    """A JSON list, else numbers between commas or spaces. [SRC19]"""
    plain = F.transform(F.filter(F.split(F.trim(text), r"[,\s]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<double>")), plain)
