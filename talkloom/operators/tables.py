"""Changes to keyed tables as whole-table rewrites, and the scene store's joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = (), replace: bool = False) -> DataFrame:
    """New rows win, but for the columns in ``keep_old``; with ``replace`` old rows that aren't in the new set go. [SNK6, SNK7, JN10]"""
    o = old.select([F.col(c).alias(f"_o_{c}") for c in old.columns] + [F.lit(True).alias("_old")])
    n = new.withColumn("_new", F.lit(True))
    joined = n.join(o, F.col(key) == F.col(f"_o_{key}"), "left" if replace else "full_outer")
    pick = [F.when(F.col("_new").isNotNull(), F.coalesce(f"_o_{c}", c) if c in keep_old else F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in old.columns]
    return joined.select(pick)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't there yet. [SNK8, SNK14, JN6-9, JN21, SET8]"""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def replace_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups that the new rows name are replaced. [SNK10, SNK16]"""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def fill_missing(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """[SNK9]"""
    return rows.withColumn("filled", F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column), value))


def patch(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Sets given non-null values on matching rows; ``changed`` tells which. [SNK11, SNK15]"""
    hit = F.coalesce(where, F.lit(False))
    changed = F.lit(False)
    for c, v in values.items():
        changed = changed | (v.isNotNull() & ~v.eqNullSafe(F.col(c)))
    out = rows.withColumn("changed", hit & changed)
    for c, v in values.items():
        out = out.withColumn(c, F.when(hit, F.coalesce(v, F.col(c))).otherwise(F.col(c)))
    return out


def next_index(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The place after the last in every group. [SNK12]"""
    return rows.groupBy(group).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_index"))


def insert_edge(edges: DataFrame, nodes: DataFrame, new: DataFrame, node: str = "id") -> DataFrame:
    """Those new edges (a, b, kind) whose ends both exist, appended. [SNK13, RET8]"""
    known = nodes.select(F.col(node).alias("_n")).distinct()
    ok = new.join(known, F.col("a") == F.col("_n"), "left_semi").join(known, F.col("b") == F.col("_n"), "left_semi")
    return edges.unionByName(ok)


def midpoint_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds the order values that lie just before and just after each row. [WIN9, RET9]"""
    w = Window.partitionBy(group).orderBy(order)
    before, after = F.lag(order).over(w), F.lead(order).over(w)
    o = F.col(order)
    return rows.withColumn("slot_before", F.coalesce((before + o) / 2, o - 1.0)).withColumn("slot_after", F.coalesce((o + after) / 2, o + 1.0))


def between(low: float | None, high: float | None, next_: float | None = None, previous: float | None = None) -> float:
    """A place between two neighbours, after one, or before one; ValueError if they are out of order. [RET9]"""
    if low is not None and high is not None:
        if low >= high:
            raise ValueError("the bounds are out of order")
        return (low + high) / 2
    if low is not None:
        return (low + next_) / 2 if next_ is not None else low + 1.0
    if high is not None:
        return (high + previous) / 2 if previous is not None else high - 1.0
    raise ValueError("no bound is given")


def nested(parent: DataFrame, child: DataFrame, key: str, order: str, columns: list[str], out: str) -> DataFrame:
    """Parents with their children as an ordered array; none is an empty array. [JN3-5, AG23]"""
    item = F.struct(order, *[c for c in columns if c != order])
    lists = child.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(out))
    empty = F.array().cast(lists.schema[out].dataType)
    return parent.join(lists, key, "left").withColumn(out, F.coalesce(F.col(out), empty))


def linked_neighbours(rows: DataFrame, group: str, order: str, node: str) -> DataFrame:
    """Sequence edges from each row to the next. [WIN12]"""
    nxt = F.lead(node).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("to", nxt).filter("to is not null").select(group, F.col(node).alias("from"), "to", F.lit("sequence").alias("kind"))


def resolve_one(rows: DataFrame, where: Column) -> DataFrame:
    """The one matching row; LookupError if there is none. [RET6]"""
    found = rows.filter(where).limit(1)
    if not found.count():
        raise LookupError("no row matches")
    return found


def compose_text(parent: DataFrame, child: DataFrame, key: str, order: str, line: Column, head: Column) -> DataFrame:
    """(key, text): heading, then the children's lines in order. [FN33, SNK18]"""
    lists = child.withColumn("_line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_line").alias("l")))).alias("_lines"))
    joined = parent.withColumn("_head", head).join(lists, key, "left")
    lines = F.transform(F.coalesce("_lines", F.array().cast(lists.schema["_lines"].dataType)), lambda x: x["l"])
    return joined.select(key, F.array_join(F.concat(F.array("_head"), lines), "\n").alias("text"))
