"""Streaming queries: they drain the events as a file stream; results equal those of the batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams
from .relational import FOUND as BATCH

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.file_stream(spark, f"{sf_dir}/event[s].parquet", SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_str15_live_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("is_owner", F.col("event_type") == "purchase")
    return streams.run_once(streams.live_pairs(rows, 720 * 60, "user_id", "event_id", "ts", "is_owner", "event_type"), "live-pairs")


def stream_str2_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.idle_sessions(events(spark, sf_dir), "user_id", "ts", "1800 seconds")
    return streams.run_once(found, "sessions").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_str3_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("is_speech", F.col("event_type") != "error")
    found = streams.utterances(rows, "user_id", "event_id", "is_speech", streams.Segmenter(30, 2, 1000), idle=IDLE)
    return streams.run_once(found, "utterances")


def stream_str6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.batched(events(spark, sf_dir), "user_id", "event_id", "value", 100.0, idle=IDLE)
    return streams.run_once(found, "batches").select("user_id", "first", "last")


def stream_str4_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("is_speech", F.col("event_type") != "error")
    return streams.run_once(streams.speech_only(rows).select("event_id", "user_id"), "speech")


def stream_str8_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.create_map(F.col("event_type"), F.col("value") / 50).alias("scores"))
    limits = spark.createDataFrame([("click", 0.9), ("error", 0.2)], "model string, threshold double")
    return streams.run_once(streams.detections(rows, limits).select("event_id", "model"), "detections")


IDLE = "720 minutes"
#: Runs of a user's events that are idle no longer than that, in order; whether a run has ended by the last watermark.
RUNS_SQL = """l as (select *, lag(ts) over (partition by user_id order by event_id) as lt from events),
    r as (select *, sum(case when lt is null or ts - lt > interval 720 minute then 1 else 0 end) over (partition by user_id order by event_id) as run from l),
    e as (select *, row_number() over (partition by user_id, run order by event_id) - 1 as n, count(*) over (partition by user_id, run) as size, max(run) over (partition by user_id) > run or max(ts) over (partition by user_id, run) + interval 720 minute < (select max(ts) - interval 10 minute from events) as ended,
        min(event_id) over (partition by user_id, run) as since from r)"""
UTTERANCES_SQL = f"""with recursive {RUNS_SQL}, s as (
    select user_id, run, -1::bigint as n, ''::varchar as recent, -1::bigint as begun, 0::bigint as quiet, null::bigint as first from (select distinct user_id, run from e) union all
    select user_id, run, n, case when begun < 0 and not start then r else '' end, case when begun < 0 then case when start then n - length(r) + 1 else -1 end when over then -1 else begun end, case when begun < 0 or over then 0 else q end, case when begun >= 0 and over then begun end
    from (select *, begun < 0 and length(replace(r, '0', '')) > 0.9 * length(r) as start, begun >= 0 and (q >= 2 or n - begun + 1 >= 1000) as over from (
        select e.user_id, e.run, e.n, s.begun, right(s.recent || case when e.event_type <> 'error' then '1' else '0' end, 30) as r, case when e.event_type <> 'error' then 0 else s.quiet + 1 end as q from s join e on e.user_id = s.user_id and e.run = s.run and e.n = s.n + 1)))
    select e.user_id, e.since, coalesce(s.first, s.begun) as first, s.n as last from s join e using (user_id, run, n) where s.first is not null or (s.begun >= 0 and e.n = e.size - 1 and e.ended)"""
BATCHES_SQL = f"""with recursive {RUNS_SQL}, s as (
    select user_id, run, n, event_id as first, value as total from e where n = 0 union all
    select e.user_id, e.run, e.n, case when s.total >= 100 then e.event_id else s.first end, case when s.total >= 100 then e.value else s.total + e.value end from s join e on e.user_id = s.user_id and e.run = s.run and e.n = s.n + 1)
    select s.user_id, s.first, e.event_id as last from s join e using (user_id, run, n) where s.total >= 100 or (e.n = e.size - 1 and e.ended)"""

ALL = [stream_str15_live_pairs, stream_str2_idle_sessions, stream_str3_utterances, stream_str6_batches, stream_str4_speech, stream_str8_detections]
SQL = {
    "stream_str15_live_pairs": BATCH["win1_burst_reply"][1],
    "stream_str2_idle_sessions": """with l as (select *, lag(ts) over (partition by user_id order by ts) as lt from events),
        s as (select *, sum(case when lt is null or ts - lt >= interval 1800 second then 1 else 0 end) over (partition by user_id order by ts) as k from l)
        select user_id, min(ts) as start, count(*) as n from s group by user_id, k having max(ts) + interval 1800 second <= (select max(ts) - interval 10 minute from events)""",
    "stream_str3_utterances": UTTERANCES_SQL,
    "stream_str6_batches": BATCHES_SQL,
    "stream_str4_speech": "select event_id, user_id from events where event_type <> 'error'",
    "stream_str8_detections": "select event_id, event_type as model from events where value / 50 >= case event_type when 'click' then 0.9::double when 'error' then 0.2::double else 0.5::double end",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
