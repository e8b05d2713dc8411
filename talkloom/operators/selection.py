"""Sampling, quotas, deduplication and splits.

Seeded random choices are orders by a hash of seed and key: the same on every run and at every number of
partitions. Sizes and strata are exact; which rows are chosen is this engine's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT


def drawn(key: Column, seed: str = DEFAULT.seed) -> Column:
    """A pseudo-random order. [SMP4]"""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key; rows without a key count as one. [WIN6, SET2-5, SRC8]"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def mark_duplicates(rows: DataFrame, keys: list[str], order: list[str], out: str = "is_dup") -> DataFrame:
    """Adds whether a row isn't the first of its key; ``order`` tells rows of a key apart. [AG17]

    The first is found by a minimum, which partial aggregation keeps small for a key that many rows share.
    """
    place = F.struct(*order)
    first = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(place).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = rows.join(first, same, "left")
    return joined.withColumn(out, place != F.col("_first")).drop("_first", *[f"_k_{k}" for k in keys])


def lowest(rows: DataFrame, n: Column, draw: str, key: str) -> DataFrame:
    """The n rows of lowest ``draw`` (hex digits, evenly spread), exactly and without a global sort.

    Rows are counted by their first four digits; whole prefixes are in or out, and only rows of the same
    prefix are ranked among each other. ``n`` may be a scalar subquery.
    """
    cut = rows.withColumn("_b", F.substring(draw, 1, 4))
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_c"))  # 65,536 rows at most
    room = sizes.withColumn("_room", n - (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c"))).filter("_room > 0")
    ranked = cut.join(room, "_b").withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(draw, key)))
    return ranked.filter(F.col("_n") <= F.col("_room")).select(rows.columns)


def stratified(rows: DataFrame, stratum: str, quotas: dict[str, int], target: int, key: str, seed: str = DEFAULT.seed) -> DataFrame:
    """Up to its quota from every stratum, then refilled from the rest to ``target``. [SMP1, JN9]"""
    drawn_rows = rows.withColumn("_h", drawn(F.col(key), seed))
    quota = F.coalesce(*[F.when(F.col(stratum) == k, q) for k, q in quotas.items()], F.lit(0))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    picked = drawn_rows.withColumn("_n", place).filter(F.col("_n") <= max(quotas.values(), default=0)).filter(F.col("_n") <= quota).drop("_n")
    rest = drawn_rows.join(picked.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").orderBy("_h", key).limit(target)
    both = picked.withColumn("_late", F.lit(False)).unionByName(rest.withColumn("_late", F.lit(True)))
    return both.orderBy("_late", "_h", key).limit(target).drop("_h", "_late")


def quota_top(rows: DataFrame, group: str, score: str, key: str, target: int) -> DataFrame:
    """Best rows of every group by proportional quota, then the best ranks of all groups to ``target``. [WIN5, SMP3]

    A group's quota is max(1, int(target * share * 1.2)); groups fill in the order of their first key.
    """
    total = rows.agg(F.count("*")).scalar()
    plan = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"), F.min(key).alias("_first"))
    plan = plan.withColumn("_quota", F.greatest(F.lit(1), F.floor(F.lit(target) * (F.col("_size") / total) * 1.2)))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).filter(F.col("_n") <= max(1, int(target * 1.2)))
    return ranked.join(plan, F.col(group).eqNullSafe(F.col("_g"))).filter("_n <= _quota").orderBy("_first", "_n").limit(target).select(rows.columns)


def priority_then_longest(rows: DataFrame, priority: Column, length: Column, target: int, key: str, seed: str = DEFAULT.seed) -> DataFrame:
    """Priority rows first, then random ones of the longer half of the others. [SMP2]

    The half is cut by a running count over distinct lengths; only rows of the length it is cut in are ranked
    among each other. Two passes over the rows.
    """
    marked = rows.withColumn("_p", priority).withColumn("_l", length).withColumn("_h", F.when(priority, F.lit("")).otherwise(drawn(F.col(key), seed)))
    sizes = marked.filter("not _p").groupBy(F.col("_l").alias("_at")).agg(F.count("*").alias("_c"))
    half, before = F.floor(F.sum("_c").over(Window.partitionBy()) / 2), F.sum("_c").over(Window.orderBy(F.desc("_at"))) - F.col("_c")
    room = sizes.withColumn("_room", half - before).filter("_room > 0")
    joined = marked.join(room, ~F.col("_p") & (F.col("_l") == F.col("_at")), "left").filter("_p or _room is not null")
    edge = F.coalesce(F.col("_room") < F.col("_c"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_l", F.when(edge, F.lit("")).otherwise(F.substring("_h", 1, 3))).orderBy(key))
    kept = joined.withColumn("_n", rank).filter(~edge | (F.col("_n") <= F.col("_room")))
    return kept.orderBy(F.desc("_p"), "_h", key).limit(target).select(rows.columns)


def split_shuffled(rows: DataFrame, key: str, share: float = 0.1, seed: str = DEFAULT.seed) -> DataFrame:
    """Adds split: max(1, int(n * share)) rows of lowest hash are 'val'. [SMP5]"""
    take = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share))).scalar()
    val = lowest(rows.select(F.col(key).alias("_k"), drawn(F.col(key), seed).alias("_h")), take, "_h", "_k")
    marked = rows.join(val.select("_k", F.lit("val").alias("_v")), F.col(key) == F.col("_k"), "left")
    return marked.withColumn("split", F.coalesce("_v", F.lit("train"))).drop("_k", "_v")


def template_of(key: Column, templates: list[str]) -> Column:
    """One of the templates, by the key's hash. [SMP6]"""
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (F.conv(F.substring(drawn(key), 1, 8), 16, 10).cast("long") % len(templates) + 1).cast("int"))


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of every group. [WIN7]"""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


def within_budget(rows: DataFrame, group: str, order: str, cost: Column, budget: Column | int) -> DataFrame:
    """The newest rows of every group whose running cost stays within the budget. [WIN8, STR12]"""
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


def carry_forward(rows: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """The last value that was there. [WIN13]"""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """Adds run_length: how many rows in a row, up to this one, had no flag. [WIN10]"""
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_g", F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(group, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("run_length", F.sum((~F.col(flag)).cast("int")).over(inside)).drop("_g")


def sessions(rows: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """(user, session, start, end, n): sessions end when the next event comes ``gap_seconds`` or more later. [STR2]"""
    w = Window.partitionBy(user).orderBy(ts)
    apart = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    cut = F.coalesce((apart >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = rows.withColumn("session", F.sum(cut).over(w))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
