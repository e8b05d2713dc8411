"""End-to-end plans: chat exports to training examples, curation to a target size, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as fx
from ..operators import conversation, pairing, quality, selection, stats
from ..sources import parse


def chat_examples(files: DataFrame, owners: list[str], s: Settings = DEFAULT, val_ratio: float = 0.1) -> DataFrame:
    """(id, chat, input, output, lang, tags, reply_ts, split) from exports (chat, text).

    Parses messages, replaces names and personal data, pairs replies with the bursts before them, filters, tags
    and holds out each chat's last part.
    """
    messages = parse.chat_messages(parse.lines_of(files))
    names = pairing.name_map(messages, owners)
    shown = pairing.with_placeholders(messages, names)
    speakers = messages.groupBy("chat", F.lower(F.trim("speaker")).alias("name_key")).agg(F.min_by("speaker", "line_no").alias("name"))
    lists = names.join(speakers, ["chat", "name_key"]).groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("placeholder", "name"))).alias("names"))
    rows = shown.join(lists, "chat", "left").withColumn("is_owner", F.lower(F.trim("speaker")).isin(*[o.lower() for o in owners]))
    rows = rows.filter(F.col("is_owner") | ~quality.skip_incoming(F.col("text")))
    none = F.array().cast("array<struct<placeholder:string,name:string>>")
    clean = fx.redact_pii(fx.redact_names(F.col("text"), F.coalesce("names", none)), s)
    rows = rows.withColumn("said", F.when(F.col("is_owner"), clean).otherwise(F.concat("shown", F.lit(": "), clean)))
    pairs = pairing.reply_pairs(rows, s.reply_window_minutes * 60, "chat", "line_no", "ts", "is_owner", "said")
    pairs = pairs.filter(~quality.skip_reply(F.col("reply"), s)).withColumn("output", fx.ensure_prefix(F.col("reply"), s))
    stamped = pairs.join(messages.select("chat", F.col("line_no").alias("reply_order"), F.col("ts").alias("reply_ts")), ["chat", "reply_order"])
    tagged = stamped.withColumn("tags", pairing.tags(F.col("input"), F.col("reply"), s)).withColumn("lang", fx.lang_two_way(F.col("reply"), s)).withColumn("id", fx.session_key(F.col("chat"), F.col("reply_order").cast("string")))
    held = pairing.holdout(tagged, val_ratio, "chat", "reply_ts", "reply_order")
    return held.select("id", "chat", "input", "output", "lang", "tags", "reply_ts", "split")


def scored(examples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds reason, score, score reasons and language category."""
    out, script, asks = F.col("output"), F.array_contains("tags", "script"), F.array_contains("tags", "clarifying")
    return examples.withColumn("reason", quality.quality_reason(out, 15, s)).withColumn("score", quality.quality_score(out, script, asks, s)).withColumn("reasons", quality.score_reasons(out, script, asks, s)).withColumn("category", fx.lang_category(out, s))


def curate(examples: DataFrame, target: int, shares: tuple[float, float, float] = (0.57, 0.29, 0.14), s: Settings = DEFAULT) -> DataFrame:
    """Passed examples without duplicates, sampled by language category to the target size."""
    passed = scored(examples, s).filter("reason = 'passed'")
    unique = selection.first_of_each(passed.withColumn("_h", fx.content_hash("output", "input")), ["_h"], [F.col("chat"), F.col("id")]).drop("_h")
    quotas = dict(zip(("script_dominant", "code_switched", "english_only"), (int(target * x) for x in shares)))
    return selection.stratified(unique, "category", quotas, target, "id", s.seed)


def as_chat(examples: DataFrame, system: str) -> DataFrame:
    """(id, messages, metadata) for training."""
    messages = conversation.as_messages(("system", F.lit(system)), ("user", fx.strip_placeholders(F.col("input"))), ("assistant", F.col("output")))
    return examples.select("id", messages.alias("messages"), F.create_map(F.lit("chat"), F.col("chat"), F.lit("lang"), F.col("lang"), F.lit("tags"), F.concat_ws(",", "tags")).alias("metadata"))


def mix_report(examples: DataFrame) -> DataFrame:
    """(chat, lang, n) with totals, as one rollup."""
    return examples.rollup("chat", "lang").agg(F.count("*").alias("n"))


def tag_report(examples: DataFrame) -> DataFrame:
    return stats.tag_fractions(examples, F.col("tags"))


def confident(rows: DataFrame, confidence: str, least: float, n: int) -> DataFrame:
    """The n surest rows of at least this confidence. [FLT17]"""
    return rows.filter(F.col(confidence) >= least).orderBy(F.desc(confidence)).limit(n)


def session_turns(turns: DataFrame, session: str) -> DataFrame:
    """[FLT14, SRT4]"""
    return turns.filter(F.col("session_id") == session).orderBy("turn_number")


def in_story_order(scenes: DataFrame, order: str = "narrative_order", key: str = "id") -> DataFrame:
    """Adds each scene's place. [SRT3]"""
    return scenes.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col(order).asc_nulls_last(), key)))


def composed_reply(opening: Column, bullets: Column, most: int = 4, lines: int = 6) -> Column:
    """Opening and at most four bullets, six lines in all. [CLS6]"""
    items = F.transform(F.slice(bullets, 1, most), lambda b: F.concat(F.lit("- "), b))
    return F.array_join(F.slice(F.concat(F.array(opening), items), 1, lines), "\n")
