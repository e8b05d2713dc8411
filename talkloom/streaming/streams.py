"""Structured Streaming operators over a stream of chunk or event rows, each with a batch twin.

State lives in Spark's state store, one record a key. A key that is idle for longer than ``idle`` in event time ends: what is open
is given out and its state goes, by a timer once the watermark has passed, or when the key's next row shows the gap. So results don't
depend on how a stream is cut into batches, and the store holds the keys of the last ``idle`` and ``late`` only. A key's rows are taken
in ``order``; rows that come after later ones of their key have been taken are late and left out. A batch's rows of one key are
sorted in memory: the size of a batch bounds them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """[SRC18]"""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def speech_only(chunks: DataFrame, flag: str = "is_speech") -> DataFrame:
    """[STR4]"""
    return chunks.filter(F.col(flag))


def detections(chunks: DataFrame, thresholds: DataFrame, scores: str = "scores") -> DataFrame:
    """A row for every model whose score reaches its threshold (0.5 without one); thresholds: (model, threshold). [STR8]"""
    rows = chunks.select("*", F.explode(scores).alias("model", "score")).drop(scores)
    return rows.join(thresholds, "model", "left").filter(F.col("score") >= F.coalesce("threshold", F.lit(0.5))).drop("threshold")


def first_detections(found: DataFrame, ts: str = "ts", within: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """The first detection of every model in each window. [STR9]"""
    return found.withWatermark(ts, late).groupBy(F.window(ts, within), "model").agg(F.min_by("score", ts).alias("score"), F.min(ts).alias("first"))


def idle_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that end when a key is idle. [STR2]"""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def late_responses(turns: DataFrame, responses: DataFrame, ts: str = "ts", late: str = "10 minutes", within: str = "5 minutes") -> DataFrame:
    """Turns with their response, which may come up to ``within`` later; without one in the end. [STR13, JN14, SNK15]"""
    a = turns.withWatermark(ts, late)
    b = responses.select(F.col("turn_id").alias("_id"), F.col(ts).alias("_ts"), "response").withWatermark("_ts", late)
    on = (F.col("turn_id") == F.col("_id")) & (F.col("_ts") >= F.col(ts)) & (F.col("_ts") <= F.col(ts) + F.expr(f"interval {within}"))
    return a.join(b, on, "left_outer").drop("_id", "_ts")


class Segmenter:
    """Utterances from flagged chunks: starts when over 90 % of the last ``ring`` chunks are speech, ends after ``silence`` silent ones or ``longest`` in all. [STR3, STR5]"""

    def __init__(self, ring: int = 30, silence: int = 16, longest: int = 1000):
        self.ring, self.silence, self.longest = ring, silence, longest

    def step(self, state: tuple, index: int, speech: bool) -> tuple[tuple, tuple[int, int] | None]:
        """State (recent flags, start or -1, silent run) and one chunk to the new state and an ended utterance (first, last)."""
        recent, start, quiet = state
        if start < 0:
            recent = (recent + ("1" if speech else "0"))[-self.ring:]
            if recent.count("1") > 0.9 * len(recent):
                return ("", index - len(recent) + 1, 0), None
            return (recent, -1, 0), None
        quiet = 0 if speech else quiet + 1
        if quiet >= self.silence or index - start + 1 >= self.longest:
            return ("", -1, 0), (start, index)
        return ("", start, quiet), None

    def run(self, flags: list[bool], first: int = 0) -> list[tuple[int, int]]:
        """All utterances of a finished stream; an open one ends with it."""
        state, out = ("", -1, 0), []
        for i, f in enumerate(flags, first):
            state, ended = self.step(state, i, f)
            if ended:
                out.append(ended)
        return out + ([(state[1], first + len(flags) - 1)] if state[1] >= 0 else [])


LISTENING, WOKEN, CAPTURING = "listening", "woken", "capturing"


class Daemon:
    """Listens for a wake word, waits for speech, captures it and hands it on: an utterance of over ``least`` seconds counts. [STR1]

    Without a wake word speech itself starts the capture. After an utterance, counted or not, it listens again.
    """

    def __init__(self, segmenter: Segmenter | None = None, least: float = 0.5, wakes: bool = True):
        self.segmenter, self.least, self.wakes = segmenter or Segmenter(longest=2**62), least, wakes

    fresh = (LISTENING, "", -1, 0, -1, 0.0)

    def step(self, state: tuple, index: int, wake: bool, speech: bool, seconds: float) -> tuple[tuple, tuple[int, int, float] | None]:
        """State (mode, recent flags, start, silent run, first chunk captured, seconds captured) and a chunk to the new state and an utterance to process."""
        mode, recent, start, quiet, first, held = state
        if mode == LISTENING and self.wakes:
            return ((WOKEN, "", -1, 0, -1, 0.0) if wake else self.fresh), None
        (recent, start, quiet), ended = self.segmenter.step((recent, start, quiet), index, speech)
        if mode != CAPTURING:
            return ((CAPTURING, recent, start, quiet, index + 1, 0.0) if start >= 0 else (mode, recent, start, quiet, -1, 0.0)), None
        held += seconds
        if ended:
            return self.fresh, ((first, index, held) if held > self.least else None)
        return (mode, recent, start, quiet, first, held), None



def stateful(rows: DataFrame, key: str, order: str, ts: str, columns: list[str], out: str, state: str, fresh: tuple, step, ended, idle: str, late: str, mode: str = "append") -> DataFrame:
    """Runs ``step(state, *columns) -> (state, rows given out)`` over each key's rows, ``ended(state) -> rows`` when a key ends.

    ``out`` and ``state`` are schemas; rows given out are prefixed with the key.
    """
    gap = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = dict(rows.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        if store.hasTimedOut:
            found += ended(store.get[2:])
            store.remove()
        else:
            last, seen, *now = store.get if store.exists else (None, None, *fresh)
            now = tuple(now)
            frame = pd.concat(list(frames)).sort_values(order, kind="stable")
            for o, at, *values in zip(frame[order], frame["_at"], *[frame[c] for c in columns]):
                if seen is not None and o < seen:
                    continue
                at = int(at)
                if last is not None and at - last > gap:
                    found += ended(now)
                    now = fresh
                now, given = step(now, *values)
                found += given
                last, seen = max(at, last or at), int(o)
            store.update((last, seen, *now))
            store.setTimeoutTimestamp(max(last + gap, store.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], *x) for x in found], columns=[key, *[c.split()[0] for c in out.split(", ")]])

    needed = list(dict.fromkeys([key, order, ts, *columns]))
    return rows.select(*needed, F.unix_millis(ts).alias("_at")).withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", f"last long, seen long, {state}", mode, GroupStateTimeout.EventTimeTimeout)


def utterances(chunks: DataFrame, key: str = "session_id", order: str = "chunk_index", flag: str = "is_speech", segmenter: Segmenter | None = None, ts: str = "ts", idle: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, since, first, last) of utterances: the order of the key's first chunk since it was idle, and places of chunks from there, from 0.
    One that is open when its key ends, ends with it. [STR3, STR5]"""
    seg = segmenter or Segmenter()

    def step(state: tuple, place: int, speech: bool) -> tuple[tuple, list]:
        since, n, *now = state
        now, found = seg.step(tuple(now), n, bool(speech))
        since = int(place) if since is None else since
        return (since, n + 1, *now), [(since, *found)] if found else []

    ended = lambda state: [(state[0], state[3], state[1] - 1)] if state[3] >= 0 else []
    return stateful(chunks, key, order, ts, [order, flag], "since long, first long, last long", "since long, n long, recent string, start long, quiet long", (None, 0, "", -1, 0), step, ended, idle, late)


def captured(chunks: DataFrame, key: str, order: str, wake: str, flag: str, seconds: str, daemon: Daemon | None = None, ts: str = "ts", idle: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, first, last, seconds) of the utterances that a daemon hands on; a key that is idle goes back to listening. [STR1]"""
    d = daemon or Daemon()

    def step(state: tuple, woke: bool, speech: bool, length: float) -> tuple[tuple, list]:
        n, *now = state
        now, found = d.step(tuple(now), n, bool(woke), bool(speech), float(length))
        return (n + 1, *now), [found] if found else []

    return stateful(chunks, key, order, ts, [wake, flag, seconds], "first long, last long, seconds double", "n long, mode string, recent string, start long, quiet long, first long, held double", (0, *Daemon.fresh), step, lambda state: [], idle, late)


def batched(chunks: DataFrame, key: str, order: str, seconds: str, least: float = 0.5, ts: str = "ts", idle: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, first, last, seconds): runs of chunks of at least ``least`` seconds; the rest is given out when its key ends. [STR6]"""

    def step(state: tuple, i: int, length: float) -> tuple[tuple, list]:
        first, _, total = state
        first, total = (int(i) if first < 0 else first), total + float(length)
        return ((-1, -1, 0.0), [(first, int(i), total)]) if total >= least else ((first, int(i), total), [])

    ended = lambda state: [tuple(state)] if state[0] >= 0 else []
    return stateful(chunks, key, order, ts, [order, seconds], "first long, last long, seconds double", "first long, upto long, total double", (-1, -1, 0.0), step, ended, idle, late)


def live_pairs(messages: DataFrame, window_seconds: float, chat: str = "chat", order: str = "line_no", ts: str = "ts", owner: str = "is_owner", text: str = "text", late: str = "10 minutes") -> DataFrame:
    """(chat, reply_order, input, reply, n_messages) as replies come in; a burst without a reply in the window goes. [STR15]"""

    def step(state: tuple, o: int, own: bool, said: str) -> tuple[tuple, list]:
        burst, n = state
        if own:
            return ("", 0), [(int(o), burst, said, n)] if n else []
        return (f"{burst}\n{said}" if n else said, n + 1), []

    return stateful(messages, chat, order, ts, [order, owner, text], "reply_order long, input string, reply string, n_messages int", "burst string, n int", ("", 0), step, lambda state: [], f"{window_seconds} seconds", late)


def sessions(turns: DataFrame, session: str, order: str, text: str, ts: str = "ts", op: str | None = None, most: int = 20, summarise: int = 15, idle: str = "1 days", late: str = "10 minutes") -> DataFrame:
    """(session, n, texts, summary, ended) after each turn: its place, the last ``most`` turns, and the topics of their older half once there
    are ``summarise``. ``op``: a column that says 'turn', 'clear' or 'delete'; a session is made by its first turn. [STR10, STR11]"""
    op = op or "_op"
    turns = turns if op in turns.columns else turns.withColumn(op, F.lit("turn"))

    def step(state: tuple, said: str, what: str) -> tuple[tuple, list]:
        texts, n, summary = list(state[0]), state[1], state[2]
        if what in ("clear", "delete"):
            return ([], 0, ""), [(0, [], "", what == "delete")]
        texts, n = [*texts, said or ""][-most:], n + 1
        if len(texts) >= summarise:
            words = {w for t in texts[:len(texts) // 2] for w in t.lower().split() if len(w) > 4}
            summary = "Discussed: " + ", ".join(sorted(words)[:10])
        return (texts, n, summary), [(n, texts, summary, False)]

    out = "n long, texts array<string>, summary string, ended boolean"
    return stateful(turns, session, order, ts, [text, op], out, "texts array<string>, n long, summary string", ([], 0, ""), step, lambda state: [(state[1], list(state[0]), state[2], True)], idle, late)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; only where that is unset and the master is local a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="talkloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Drains what there is of a stream into Parquet files in the shared folder, and reads them."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
