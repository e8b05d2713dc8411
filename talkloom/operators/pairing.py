"""Chat messages to reply pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def reply_pairs(messages: DataFrame, window_seconds: float | None, chat: str = "chat", order: str = "line_no", ts: str = "ts", owner: str = "is_owner", text: str = "text") -> DataFrame:
    """(chat, reply order, input, reply, n_messages): each owner message with the run of others' messages before it. [WIN1, AG22, JN13]

    A run goes on while the gap to the message before is at most ``window_seconds`` (None: no clock) and ends at
    an owner message. One sort by chat; the run's texts are put together in message order.
    """
    w = Window.partitionBy(chat).orderBy(order)
    after_owner = F.lag(owner).over(w)
    fresh = F.coalesce(after_owner, F.lit(True))
    if window_seconds is not None:
        fresh = fresh | F.coalesce((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > int(window_seconds * 1_000_000), F.lit(True))
    runs = messages.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    found = runs.groupBy(chat, "_run").agg(
        F.array_sort(F.collect_list(F.when(~F.col(owner), item))).alias("said"),
        F.max(F.when(F.col(owner), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("reply"),
    )
    found = found.filter(F.col("reply").isNotNull() & (F.size("said") > 0))
    return found.select(chat, F.col("reply.o").alias("reply_order"), F.array_join(F.transform("said", lambda x: x["t"]), "\n").alias("input"), F.col("reply.t").alias("reply"), F.size("said").alias("n_messages"))


def name_map(messages: DataFrame, owners: list[str], chat: str = "chat", order: str = "line_no", speaker: str = "speaker", wide_names: bool = False) -> DataFrame:
    """(chat, name_key, placeholder) by first appearance; after 26 names the letters start again, unless ``wide_names``. [FN16, WIN4]"""
    key = F.lower(F.trim(F.col(speaker)))
    first = messages.withColumn("name_key", key).filter(~F.col("name_key").isin(*[o.lower() for o in owners])).groupBy(chat, "name_key").agg(F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(chat).orderBy("first", "name_key")) - 1
    letter = F.char(F.lit(65) + rank % 26)
    label = F.concat(letter, F.when(rank >= 26, F.floor(rank / 26).cast("string")).otherwise("")) if wide_names else letter
    return first.select(chat, "name_key", F.concat(F.lit("{NAME_"), label, F.lit("}")).alias("placeholder"))


def with_placeholders(messages: DataFrame, names: DataFrame, chat: str = "chat", speaker: str = "speaker") -> DataFrame:
    """Adds the speaker's placeholder, the speaker itself where there is none. [JN12]"""
    joined = messages.withColumn("name_key", F.lower(F.trim(F.col(speaker)))).join(names, [chat, "name_key"], "left")
    return joined.withColumn("shown", F.coalesce("placeholder", speaker)).drop("name_key", "placeholder")


def holdout_size(n: Column, ratio: float) -> Column:
    """How many of a chat's n rows are held out. [WIN2]"""
    c = F.greatest(F.ceil(n * ratio), F.when(n >= 5, 1).otherwise(0))
    return F.when(c >= n, F.when(n > 1, F.greatest(F.lit(1), F.floor(n / 5))).otherwise(n)).otherwise(c)


def holdout(rows: DataFrame, ratio: float, chat: str, *order: str) -> DataFrame:
    """Adds split: the last rows of every chat are 'val'. [WIN2]"""
    back = Window.partitionBy(chat).orderBy(*[F.desc(o) for o in order])
    n = F.count("*").over(Window.partitionBy(chat))
    return rows.withColumn("split", F.when(F.row_number().over(back) <= holdout_size(n, ratio), "val").otherwise("train"))


def tags(incoming: Column, reply: Column, s: Settings = DEFAULT) -> Column:
    """Tags of a pair."""
    from ..functions.text import is_script_related

    extra = F.array(F.when(is_script_related(incoming, s) | is_script_related(reply, s), "script"), F.when(reply.contains("?"), "clarifying"))
    return F.concat(F.array(F.lit("persona"), F.lit("whatsapp")), F.filter(extra, lambda x: x.isNotNull()))
