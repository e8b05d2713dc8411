"""Aggregates of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed


def fractions(rows: DataFrame, label: Column, digits: int = 3) -> DataFrame:
    """(label, n, share): the rows of each label over all rows. [AG3]"""
    total = rows.agg(F.count("*")).scalar()
    return rows.withColumn("label", label).groupBy("label").agg(F.count("*").alias("n")).select("label", "n", F.round(F.col("n") / total, digits).alias("share"))


def tag_fractions(rows: DataFrame, tags: Column, digits: int = 3) -> DataFrame:
    """As fractions, each distinct tag of a row counted once. [AG2, AG3]"""
    total = rows.agg(F.count("*")).scalar()
    return rows.select(F.explode(F.array_distinct(tags)).alias("label")).groupBy("label").agg(F.count("*").alias("n")).select("label", "n", F.round(F.col("n") / total, digits).alias("share"))


def bucket(value: Column, cuts: list[tuple[float, str]], low: str) -> Column:
    """The name of the first cut the value reaches. [AG4, AG5]"""
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for at, name in cuts[1:]:
        out = out.when(value >= at, name)
    return out.otherwise(low)


def nearest_rank(rows: DataFrame, value: str, shares: list[float], group: str | None = None) -> DataFrame:
    """(group, p, value): the value at place int(n * p) of the sorted values, counted from 0. [AG8]

    Distinct values are counted first, so the sort is over what differs; a running count finds the places.
    """
    keys = [group] if group else []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value) if keys else Window.orderBy(value)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(whole))
    asked = upto.withColumn("p", F.explode(F.array(*[F.lit(p) for p in shares]))).withColumn("at", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1))
    return asked.filter("upto > at and upto - c <= at").select(*keys, "p", F.col(value).alias("value"))


def top_counts(rows: DataFrame, by: list[str], n: int, within: list[str] | None = None) -> DataFrame:
    """The n commonest of ``by`` (of each ``within``), ties by key. [SRT6, PAR5]"""
    counts = rows.groupBy(*(within or []), *by).agg(F.count("*").alias("n"))
    if not within:
        return counts.orderBy(F.desc("n"), *by).limit(n)
    w = Window.partitionBy(*within).orderBy(F.desc("n"), *by)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def duplicate_count(rows: DataFrame, key: Column) -> DataFrame:
    """[AG10]"""
    return rows.agg((F.count("*") - F.countDistinct(key)).alias("duplicates"))


def gaps(topics: DataFrame, langs: DataFrame, script_lang: str, least: int = fixed.TOPIC_LEAST, least_pct: float = fixed.SCRIPT_LEAST) -> DataFrame:
    """(gap, value): topics counted, as domain and as tag together, less than ``least`` times, and the second language where its
    percentage is below ``least_pct``; from rows (topic) and (lang). [AG16]"""
    wanted = topics.sparkSession.createDataFrame([(t,) for t in fixed.TOPICS], "gap string")
    counts = topics.select(F.regexp_replace("topic", "^tag:", "").alias("gap")).groupBy("gap").agg(F.count("*").alias("n"))
    few = wanted.join(F.broadcast(counts.filter(F.col("gap").isin(*fixed.TOPICS))), "gap", "left").select("gap", F.coalesce("n", F.lit(0)).cast("double").alias("value")).filter(F.col("value") < least)
    share = langs.agg(F.coalesce(100 * F.try_divide(F.count_if(F.col("lang") == script_lang), F.count("lang")), F.lit(0.0)).alias("value"))
    return few.unionByName(share.filter(F.col("value") < least_pct).select(F.lit(f"lang:{script_lang}").alias("gap"), "value"))
