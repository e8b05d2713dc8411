import random

from pyspark.sql import functions as F

from talkloom.streaming import streams


def test_segmenter():
    s = streams.Segmenter(ring=30, silence=3)
    assert s.run([True, True, False, False, False, True]) == [(0, 4), (5, 5)]
    assert s.run([False] * 5) == []
    assert streams.Segmenter(silence=99, longest=4).run([True] * 6)[0] == (0, 3)


def files(spark, path, parts, schema):
    """Files that a stream takes in this order, one a batch."""
    import time

    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return streams.file_stream(spark, path, schema)


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    r = random.Random(1)
    flags = {u: [r.random() < 0.6 for _ in range(80)] for u in ("a", "b")}
    parts = [[(u, i, at(i), f[i]) for u, f in flags.items() for i in range(k * 20, k * 20 + 20)] for k in range(4)]
    # the last row lets the watermark pass: all keys but its own end
    stream = files(spark, str(tmp_path / "in"), [*parts, [("z", 0, at(90_000), False)]], "session_id string, chunk_index long, ts timestamp, is_speech boolean")
    seg = streams.Segmenter(30, 2, 1000)
    got = {u: [] for u in flags}
    for x in streams.run_once(streams.utterances(stream, segmenter=seg), "utterances").orderBy("session_id", "first").collect():
        got[x.session_id].append((x.first, x.last))
    assert got == {u: seg.run(f) for u, f in flags.items()}


def test_state_goes_after_the_watermark(spark, tmp_path):
    schema = "k string, i long, ts timestamp, s double"
    stream = files(spark, str(tmp_path / "in"), [[("a", 0, at(0), 0.3), ("b", 0, at(1), 0.2)], [("a", 1, at(2), 0.3)], [("a", 0, at(1), 9.0), ("a", 2, at(9000), 0.1)], [("z", 0, at(90_000), 0.4)]], schema)
    folder = streams.shared_folder(spark, "state")
    q = streams.batched(stream, "k", "i", "s").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").collect()
    # a row late for its key is left out; rests are given out once their keys are idle
    assert sorted((r.k, r.first, r["last"], round(r.seconds, 6)) for r in rows) == [("a", 0, 1, 0.6), ("a", 2, 2, 0.1), ("b", 0, 0, 0.2)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # z alone
    q.stop()


def test_daemon():
    d, state, out = streams.Daemon(streams.Segmenter(1, 2, 2**62)), streams.Daemon.fresh, []
    wake, speech = "0100000010000000", "0001110001110000"
    modes = []
    for i, (w, f) in enumerate(zip(wake, speech)):
        state, found = d.step(state, i, w == "1", f == "1", 0.15)
        modes.append(state[0])
        out += [found] if found else []
    assert [(a, b, round(s, 6)) for a, b, s in out] == [(4, 7, 0.6), (10, 13, 0.6)]
    assert modes[:9] == ["listening", "woken", "woken", "capturing", "capturing", "capturing", "capturing", "listening", "woken"]
    short = streams.Daemon(streams.Segmenter(1, 1, 2**62), wakes=False)
    state, out = streams.Daemon.fresh, []
    for i, f in enumerate("0110"):
        state, found = short.step(state, i, False, f == "1", 0.2)
        out.append(found)
    assert out == [None] * 4 and state == streams.Daemon.fresh  # 0.4 seconds are too short


def test_captured_stream(spark, tmp_path):
    rows = [("u", i, at(i), w == "1", f == "1", 0.15) for i, (w, f) in enumerate(zip("0100000010000000", "0001110001110000"))]
    stream = files(spark, str(tmp_path / "in"), [rows[:6], rows[6:]], "k string, i long, ts timestamp, w boolean, f boolean, s double")
    found = streams.run_once(streams.captured(stream, "k", "i", "w", "f", "s", streams.Daemon(streams.Segmenter(1, 2, 2**62))), "captured").collect()
    assert sorted((r.first, r["last"]) for r in found) == [(4, 7), (10, 13)]


def test_sessions(spark, tmp_path):
    turns = [("s", i, at(i), f"message{i:02d} about budget", "turn") for i in range(22)] + [("s", 30, at(30), None, "clear"), ("s", 31, at(31), "new start", "turn"), ("t", 0, at(5), "hello there", "turn"), ("t", 1, at(6), None, "delete")]
    stream = files(spark, str(tmp_path / "in"), [turns[:12], turns[12:], [("z", 0, at(900_000), "x", "turn")]], "k string, i long, ts timestamp, said string, op string")
    rows = streams.run_once(streams.sessions(stream, "k", "i", "said", op="op"), "sessions").collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append(r)
    s = {r.n: r for r in by["s"] if r.texts and r.texts[0].startswith("message")}
    assert s[14].summary == "" and s[15].summary == "Discussed: about, budget, " + ", ".join(f"message{i:02d}" for i in range(7))
    assert len(s[22].texts) == 20 and s[22].texts[0] == "message02 about budget"
    assert any(r.n == 0 and not r.ended for r in by["s"]) and any(r.n == 1 and r.texts == ["new start"] and r.ended for r in by["s"])
    assert any(r.ended and r.n == 0 for r in by["t"])


def test_first_detections(spark, tmp_path):
    rows = [("a", at(0), 0.7), ("a", at(10), 0.9), ("b", at(20), 0.6), ("a", at(70), 0.8), ("z", at(90_000), 1.0)]
    stream = files(spark, str(tmp_path / "in"), [rows], "model string, ts timestamp, score double")
    found = streams.run_once(streams.first_detections(stream).select("model", "score", "first"), "first").collect()
    assert sorted((r.model, r.score) for r in found) == [("a", 0.7), ("a", 0.8), ("b", 0.6)]


def test_late_response(spark, tmp_path):
    t = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:01:00"), (9, "2024-01-02 00:00:00")], "turn_id int, t string").select("turn_id", F.to_timestamp("t").alias("ts"))
    a = spark.createDataFrame([(1, "2024-01-01 10:02:00", "yes"), (2, "2024-01-01 11:00:00", "too late"), (9, "2024-01-02 00:00:01", "z")], "turn_id int, t string, response string").select("turn_id", F.to_timestamp("t").alias("ts"), "response")
    for name, df in (("t", t), ("a", a)):
        df.write.parquet(str(tmp_path / name))
    st = lambda n, s: spark.readStream.schema(s).parquet(str(tmp_path / n))
    joined = streams.late_responses(st("t", t.schema), st("a", a.schema))
    got = {r.turn_id: r.response for r in streams.run_once(joined, "late").collect()}
    assert got[1] == "yes" and got.get(2) is None
