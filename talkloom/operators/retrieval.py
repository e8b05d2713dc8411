"""Top-k retrieval by shared words, by cosine or by text similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine


def overlap_score(text: Column, query: Column, tags: Column | None = None) -> Column:
    """Shared distinct words, and half a point for each tag that is a query word. [RET1, SET7]"""
    asked = F.array_distinct(tokens(query))
    score = F.size(F.array_intersect(F.array_distinct(tokens(text)), asked)).cast("double")
    return score if tags is None else score + 0.5 * F.size(F.array_intersect(F.transform(tags, lambda t: F.lower(t)), asked))


def top_k(scored: DataFrame, score: str, order: str, k: int, floor: bool = True) -> DataFrame:
    """The k best (one at least, with ``floor``), ties in stored order. [SRT1, SRT2]"""
    return scored.orderBy(F.desc(score), order).limit(max(1, k) if floor else k)


def search_text(rows: DataFrame, query: str, text: Column, order: str, k: int, tags: Column | None = None, wanted: list[str] | None = None) -> DataFrame:
    """[RET1, RET2]"""
    from .quality import has_tags

    rows = rows.filter(has_tags(tags, wanted)) if wanted and tags is not None else rows
    return top_k(rows.withColumn("score", overlap_score(text, F.lit(query), tags)), "score", order, k)


def search_vector(rows: DataFrame, query: list[float], vector: str, order: str, k: int, missing: float = -1.0) -> DataFrame:
    """Rows without a vector are left out. [RET1, RET3, JN18]"""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return top_k(rows.filter(F.col(vector).isNotNull()).withColumn("score", cosine(F.col(vector), asked, missing)), "score", order, k)


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; an Arrow function over whole batches. [FN32]"""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return run(a, b)


def routed_tags(text: Column, routes: dict[str, str]) -> Column:
    """Tags that a text's keywords stand for. [RET7]"""
    return F.array_distinct(F.filter(F.array(*[F.when(F.lower(text).contains(k), v) for k, v in routes.items()]), lambda x: x.isNotNull()))
