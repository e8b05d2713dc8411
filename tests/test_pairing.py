import random
from datetime import datetime, timedelta

import pytest

from talkloom.operators import pairing
from talkloom.sources import parse


def brute(rows, window):
    """(reply order, texts) by one pass in order."""
    out, pending, last = [], [], None
    for order, ts, own, text in rows:
        if pending and (ts - last).total_seconds() > window:
            pending = []
        if own:
            if pending:
                out.append((order, "\n".join(pending)))
            pending = []
        else:
            pending, last = [*pending, text], ts
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_one_pass(spark, seed):
    r, start, every, rows = random.Random(seed), datetime(2024, 1, 1), {}, []
    for chat in range(5):
        ts, own = start, []
        for k in range(60):
            ts += timedelta(minutes=r.choice([1, 5, 30, 31, 90]))
            own.append((k, ts, r.random() < 0.3, f"m{k}"))
        every[chat] = brute(own, 1800)
        rows += [(chat, *x) for x in own]
    df = spark.createDataFrame(rows, "chat int, line_no int, ts timestamp, is_owner boolean, text string")
    got = {}
    for x in pairing.reply_pairs(df, 1800).orderBy("chat", "reply_order").collect():
        got.setdefault(x.chat, []).append((x.reply_order, x.input))
    assert got == {k: v for k, v in every.items() if v}


CHAT = """[1/2/24, 10:00:00 AM] Ann Lee: hello there
second line of the same message
[1/2/24, 10:05:00 AM] Bob: ask Ann Lee at +1 555-010-2233 or x@y.co
[1/2/24, 10:06:00 AM] owner: which scene?
[1/2/24, 10:07:00 AM] Bob: image omitted
[1/2/24, 10:08:00 AM] owner: never emitted (nothing pending)
[1/2/24, 11:00:00 AM] Ann Lee: late
[1/2/24, 11:30:00 AM] owner: exactly thirty minutes, still paired
[1/2/24, 12:00:00 PM] Bob: too old
[1/2/24, 12:30:01 PM] owner: not paired
[99/99/99, 1:00] Bob: bad timestamp, dropped
continuation attaches to the previous parsed message"""


def test_chat_to_pairs(spark):
    from pyspark.sql import functions as F

    from talkloom.functions import text as fx
    from talkloom.operators import quality

    files = spark.createDataFrame([("c", "﻿" + CHAT.replace("\n", "\r\n", 3))], "chat string, text string")
    m = parse.chat_messages(parse.lines_of(files)).cache()
    rows = m.orderBy("line_no").collect()
    assert len(rows) == 9
    assert rows[0].text == "hello there\nsecond line of the same message" and rows[0].speaker == "Ann Lee"
    assert rows[-1].text.endswith("continuation attaches to the previous parsed message")
    named = pairing.with_placeholders(m, pairing.name_map(m, ["owner"]))
    names = pairing.name_map(m, ["owner"]).join(m.groupBy(F.lower("speaker").alias("name_key")).agg(F.first("speaker").alias("name")), "name_key").groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("placeholder", "name"))).alias("names"))
    said = named.join(names, "chat").withColumn("text", F.when(F.col("speaker") == "owner", F.col("text")).otherwise(F.concat("shown", F.lit(": "), fx.redact_pii(fx.redact_names(F.col("text"), F.col("names"))))))
    said = said.withColumn("is_owner", F.col("speaker") == "owner").filter(~(~F.col("is_owner") & quality.skip_incoming(F.regexp_replace("text", r"^\{NAME_.\}: ", ""))))
    pairs = pairing.reply_pairs(said, 1800).orderBy("reply_order").withColumn("reply", fx.ensure_prefix(F.col("reply"))).withColumn("tags", pairing.tags(F.col("input"), F.col("reply"))).collect()
    assert [p.reply for p in pairs] == ["Boss, which scene?", "Boss, exactly thirty minutes, still paired"]
    assert pairs[0].input == "{NAME_A}: hello there\nsecond line of the same message\n{NAME_B}: ask {NAME_A} at {PHONE} or {EMAIL}"
    assert pairs[0].tags == ["persona", "whatsapp", "script", "clarifying"] and pairs[1].tags == ["persona", "whatsapp", "script"]


def test_holdout_sizes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 10, 11)], "n int")
    assert [r[0] for r in df.select(pairing.holdout_size(F.col("n"), 0.1)).collect()] == [1, 1, 1, 1, 2]


def test_timestamps(spark):
    cases = {"1/2/24, 10:00:00 AM": "2024-01-02 10:00:00", "13/4/24, 9:05": "2024-04-13 09:05:00", "3/4/2024, 1:00 pm": "2024-03-04 13:00:00", "12/31/23, 11:59 PM": "2023-12-31 23:59:00", "bad": None}
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse.timestamp(F.col("s")).cast("string").alias("t")).collect()
    assert {r.s: r.t for r in got} == cases


def test_speakers_beyond_26(spark):
    rows = [("c", k, f"S{k:02d}") for k in range(30)]
    df = spark.createDataFrame(rows, "chat string, line_no int, speaker string")
    narrow = {r.name_key: r.placeholder for r in pairing.name_map(df, []).collect()}
    assert narrow["s00"] == narrow["s26"] == "{NAME_A}"
    assert len({r.placeholder for r in pairing.name_map(df, [], wide_names=True).collect()}) == 30
