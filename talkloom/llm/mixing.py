"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of all tokens gets weight p**a / sum(p**a). The exponent a is found by bisection: the
least one that repeats no source more than ``max_repeats`` times, raised (if need be) until the entropy of
the weights is down to ``target_entropy`` nats, where one is given. Weights times the token budget, rounded
down, are the sources' budgets.

Every source is dealt into ``blocks`` blocks by a hash of the key. A pass over a source runs through its
blocks in an order drawn anew for each pass, and through each block's documents likewise. A source's budget
takes as many whole passes as it holds, then the first blocks of one more; the block in which the budget
ends gives its first documents that still fit. So the tokens of a source fall short of its budget by less
than one document, and every row is taken as often as the plan says.

Prefix sums run over block totals (at most sources x blocks x passes rows, a source's passes apart). In the one block a
source is cut in they run over the totals of ``SLICES`` slices of its order first, then over the documents of the one slice
the budget ends in; no task sees a whole source or block. The least weight a source can get is kept in check by
``max_repeats`` alone: without it a small source may be repeated as often as its weight says.

Defined results: a null source counts as ''; rows of equal key lie together, in or out together; a row
without tokens (null, 0 or less) counts 0 and comes with its block; an empty table gives an empty table; of more
than ``MAX_SOURCES`` sources the shares stay in a table and the bisection aggregates over it; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCKS = 1024
#: Hexadecimal digits of an order key that make a slice: 16**4 slices.
SLICE_DIGITS = 4
SLICES = 16**SLICE_DIGITS
MAX_SOURCES = 100_000
SEED = 7
STEPS = 60


def weights(shares: list[float], exponent: float) -> list[float]:
    """Normalised p**exponent."""
    top = max(shares)
    raw = [(p / top) ** exponent for p in shares]
    return [r / math.fsum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def of_list(shares: list[float]):
    """Exponent -> (largest weight over share, entropy), from the shares themselves."""

    def measure(x: float) -> tuple[float, float]:
        w = weights(shares, x)
        return max(v / p for v, p in zip(w, shares)), entropy(w)

    return measure


def of_table(totals: DataFrame, whole: int, top: float):
    """The same from a table (n long: tokens of each source), one aggregation for each exponent."""

    def measure(x: float) -> tuple[float, float]:
        share = F.col("n") / float(whole)
        raw = totals.select(share.alias("p"), F.pow(share / top, F.lit(x)).alias("r"))
        z, most, held = raw.agg(F.sum("r"), F.max(F.col("r") / F.col("p")), F.sum(F.when(F.col("r") > 0, F.col("r") * F.log("r")).otherwise(0.0))).first()
        return most / z, math.log(z) - held / z

    return measure


def exponent(shares, budget_share: float = 1.0, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent of the mix, by bisection on [0, 1] for the limit and [0, 64] for the entropy; ``shares``: a list, or a measure of exponents.

    Weights even out as the exponent falls: the entropy falls and the largest repetition falls as it rises.
    A limit that even the natural mix breaks, or an entropy out of reach, gives the nearest end.
    """
    measure = shares if callable(shares) else of_list(shares)

    def least(low: float, high: float, holds) -> float:
        if holds(low):
            return low
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    a = 0.0
    if max_repeats is not None:
        a = least(0.0, 1.0, lambda x: measure(x)[0] * budget_share <= max_repeats)
    if target_entropy is not None:
        a = max(a, least(0.0, 64.0, lambda x: measure(x)[1] <= target_entropy))
    return a


def draw(*parts: Column) -> Column:
    """A pseudo-random order key from the seed and these values."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *[p.cast("string") for p in parts]).cast("binary"))


def block_of(key: Column, blocks: int) -> Column:
    return (F.conv(F.substring(draw(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % blocks).cast("int")


def mix(df: DataFrame, tokens: Column, key: str = "doc_id", source: str = "source", budget_share: float = 1.0, max_repeats: float | None = 4.0, target_entropy: float | None = None, target_entropy_share: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Rows of ``df`` as often as the mix takes them, with mix_source, mix_tokens, mix_weight, mix_pass, mix_block_rank and mix_order.

    ``budget_share``: the budget over all tokens there are. ``target_entropy_share``: the target as a share of
    that of even weights. Sorting by (mix_source, mix_pass, mix_block_rank, mix_order) gives the permutations.
    """
    spark = df.sparkSession
    added = {"mix_source", "mix_tokens", "mix_weight", "mix_pass", "mix_block_rank", "mix_order"}
    df = df.select(*[c for c in df.columns if c not in added])
    marked = df.withColumn("mix_source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("mix_tokens", F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0).cast("long"))).withColumn("mix_block", block_of(F.col(key), blocks))
    narrow = marked.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("mix_key"), "mix_source", "mix_tokens", "mix_block")
    sums = written(narrow.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("n")), "blocks")
    totals = sums.groupBy("mix_source").agg(F.sum("n").alias("n")).filter("n > 0")
    n, whole, most = totals.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if n <= MAX_SOURCES:  # the driver has the shares, and what the plan joins is small
        few, rows = F.broadcast, sorted(tuple(r) for r in totals.collect())
        plan = []
        if rows:
            shares = [t / whole for _, t in rows]
            target = target_entropy if target_entropy_share is None else target_entropy_share * math.log(n)
            for (s, t), w in zip(rows, weights(shares, exponent(shares, budget_share, max_repeats, target))):
                budget = int(w * whole * budget_share)
                plan.append((s, w, budget // t, budget % t))
        plan_df = spark.createDataFrame(plan, "mix_source string, mix_weight double, full int, rest long")
    else:
        few, top, totals = (lambda x: x), most / whole, written(totals, "totals")
        target = target_entropy if target_entropy_share is None else target_entropy_share * math.log(n)
        raw = F.pow(F.col("n") / float(whole) / top, F.lit(exponent(of_table(totals, whole, top), budget_share, max_repeats, target)))
        weighed = totals.select("mix_source", "n", (raw / totals.agg(F.sum(raw)).scalar()).alias("mix_weight")).withColumn("budget", F.floor(F.col("mix_weight") * float(whole) * budget_share))
        plan_df = written(weighed.select("mix_source", "mix_weight", F.expr("cast(budget div n as int)").alias("full"), F.expr("budget % n").alias("rest")), "plan")
    passes = sums.join(few(plan_df), "mix_source").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("full"))))
    order = Window.partitionBy("mix_source", "mix_pass").orderBy("drawn", "mix_block")
    passes = passes.withColumn("drawn", draw(F.col("mix_pass"), F.col("mix_source"), F.col("mix_block"))).withColumn("mix_block_rank", F.row_number().over(order)).withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    passes = passes.filter("mix_pass < full or before < rest").withColumn("cut", F.expr("mix_pass = full and before + n > rest"))
    passes = written(passes.select("mix_source", "mix_block", "mix_weight", "mix_pass", "mix_block_rank", "cut", (F.col("rest") - F.col("before")).alias("room")), "passes")
    # at most one cut block for each source: where its budget ends
    cuts = passes.filter("cut").select("mix_source", "mix_block", "mix_pass", "room")
    inside = narrow.join(few(cuts), ["mix_source", "mix_block"]).withColumn("mix_order", draw(F.col("mix_pass"), F.col("mix_key"))).withColumn("slice", F.substring("mix_order", 1, SLICE_DIGITS))
    by_slice = Window.partitionBy("mix_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = inside.groupBy("mix_source", "slice", "room").agg(F.sum("mix_tokens").alias("n")).withColumn("upto", F.sum("n").over(by_slice))
    # the slice that the room ends in; those before it fit whole, and its own name sorts before all in it
    ends = written(slices.filter("upto > room").groupBy("mix_source").agg(F.min(F.struct("slice", (F.col("room") - F.col("upto") + F.col("n")).alias("room"))).alias("e")).select("mix_source", "e.*"), "ends")
    fits = Window.partitionBy("mix_source").orderBy("mix_order").rangeBetween(Window.unboundedPreceding, 0)
    split = inside.drop("room").join(few(ends), ["mix_source", "slice"]).withColumn("upto", F.sum("mix_tokens").over(fits)).filter("upto <= room").groupBy("mix_source").agg(F.max("mix_order").alias("last"))
    last = ends.join(split, "mix_source", "left").select("mix_source", F.coalesce("last", "slice").alias("last"))
    passes = written(passes.join(few(last), "mix_source", "left").select("mix_source", "mix_block", "mix_weight", "mix_pass", "mix_block_rank", F.when(F.col("cut"), F.coalesce("last", F.lit(""))).otherwise("~").alias("last")), "schedule")
    taken = marked.join(passes, ["mix_source", "mix_block"]).withColumn("mix_order", draw(F.col("mix_pass"), F.coalesce(F.col(key).cast("string"), F.lit("null")))).filter("mix_order <= last")
    return taken.select(*df.columns, "mix_source", "mix_tokens", "mix_weight", "mix_pass", "mix_block_rank", "mix_order")
