"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades run from 0 (worst) to ``grades`` - 1. One vector of weights over hashed text features gives a text's
position s; ordered thresholds t1 < t2 < ... cut the axis: P(grade >= k) = sigmoid(s - t_k). A text's
expected grade is the sum of these tails, the tail at the wanted grade serves for selection.

Features of a text, each counted once: its words and their first five bytes (letters, A-Z lowered), the
punctuation hanging on its words, capitals throughout a word, a word said twice in a row, and bins for the
shares of distinct words and of words with other marks than commas and full stops; each is hashed to one of 2**18 weights. Prediction reads whole texts.

Training reads a bounded sample: about ``sample_rows`` labelled keys of lowest hash, ``REPEATS`` different texts or grades of
a key at most, of a longer text a run of ``sample_chars`` characters at a place that its hash picks.

Defined results: a null or empty text has no features and gets the thresholds' own tails; without any
label the tails are (grades - k) / grades, as for evenly spread grades; repeated rows agree; an empty table
gives an empty table; clashing columns of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, byte_view, slices, small_batches, worker_state

BITS = 18
SAMPLE_ROWS = 10_000
SAMPLE_CHARS = 20_000
REPEATS = 4
SEED = 5

_random = np.random.RandomState(20)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER = np.zeros(256, np.int32)
UPPER[65:91] = 1
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = IS_LETTER[65:91] = IS_LETTER[128:] = True
LETTERS = np.where(IS_LETTER, _random.randint(1, 2**62, 256).astype(np.uint64)[LOWER], 0).astype(np.uint64)
MARKS = np.where(IS_LETTER | SPACE, 0, _random.randint(1, 2**62, 256).astype(np.uint64)).astype(np.uint64)
MARKS[48:58] = 0
POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int64)


#: A run without white space is cut into words of so many bytes.
MAX_WORD = 1 << 16
#: Bytes worked on at once, a multiple of MAX_WORD; longer texts are cut where a word starts.
PIECE = 1 << 20


def word_start(raw: np.ndarray, lo: int, at: int) -> int:
    """Where the word (or white space) around ``at`` starts, if one starts at ``lo``."""
    space = np.flatnonzero(SPACE[raw[lo:at]])
    begin = lo + int(space[-1]) + 1 if len(space) else lo
    return begin + (at - begin) // MAX_WORD * MAX_WORD


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, weight index) pairs of all texts, each once."""
    cuts, owner = [], []
    for i in np.flatnonzero(np.diff(offsets)):
        lo, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            cuts.append(lo)
            owner.append(i)
            if end - lo <= PIECE:
                break
            # all of a piece's white space may lie before its last word
            lo = max(lo + 1, word_start(raw, lo, lo + PIECE))
    cuts, owner = np.array([*cuts, len(raw)], np.int64), np.array(owner, np.int64)
    n, k, parts = len(offsets) - 1, 0, []
    total, strange = np.zeros(n, np.int64), np.zeros(n, np.int64)
    of, last = -1, 0
    while k < len(owner):
        end = max(k + 1, int(np.searchsorted(cuts, cuts[k] + PIECE, side="right")) - 1)
        piece, index, words, odd, edges = piece_features(raw[cuts[k]:cuts[end]], cuts[k:end + 1] - cuts[k])
        parts.append(owner[k:end][piece] << BITS | index)
        np.add.at(total, owner[k:end], words)
        np.add.at(strange, owner[k:end], odd)
        for j, (first, final) in enumerate(edges):  # a word that is said again in the next piece of its text
            if first and owner[k + j] == of and first == last:
                parts.append(np.array([of << BITS | TWICE]))
            if words[j]:
                of, last = owner[k + j], final
        k = end
    seen = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    d, b = seen >> BITS, seen & (1 << BITS) - 1
    distinct, has = np.bincount(d, minlength=n), np.flatnonzero(total)
    size = np.minimum(3, np.log10(total[has]).astype(np.int64))
    variety = 16 + 16 * size + np.minimum(15, (8 * distinct[has] / (total[has] + 4)).astype(np.int64))
    strangeness = 96 + np.ceil(16 * strange[has] / total[has]).astype(np.int64)
    return np.concatenate([d, has, has]), np.concatenate([b, variety, strangeness])


TWICE, LOUD = 3, 4


def piece_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(piece, weight index) pairs of the words; of each piece the words, those with odd marks, and the hashes of its first and last word."""
    n = len(offsets) - 1
    space = SPACE[raw]
    begins = ~space
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins[1:] &= space[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [(0, 0)] * n
    long = np.flatnonzero(np.diff(np.append(starts, len(raw))) > MAX_WORD)
    if len(long):
        ends = [starts[i] + int(np.argmax(np.append(space[starts[i]:], True))) for i in long]
        more = [np.arange(starts[i] + MAX_WORD, min(e, starts[i + 1] if i + 1 < len(starts) else len(raw)), MAX_WORD) for i, e in zip(long, ends)]
        starts = np.sort(np.concatenate([starts, *more]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # a word's bytes end at the next word's start at the latest; white space between them adds nothing
    sizes = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    own, at = raw[starts[0]:], starts - starts[0]
    letters = LETTERS[own]
    letters *= POWER[place & 255]
    word = np.add.reduceat(letters, at)
    letters[place >= 5] = 0
    stem = np.add.reduceat(letters, at)
    marks = np.add.reduceat(MARKS[own], at)
    upper = np.add.reduceat(UPPER[own], at)
    count = np.add.reduceat(IS_LETTER[own].astype(np.int32), at)
    odd = np.flatnonzero((marks != 0) & (marks != MARKS[44]) & (marks != MARKS[46]))
    same = doc[1:] == doc[:-1]
    twice = np.flatnonzero((word[1:] == word[:-1]) & same & (word[1:] != 0)) + 1
    loud = np.flatnonzero((upper == count) & (upper > 2))
    marked = np.flatnonzero(marks != 0)
    d = np.concatenate([doc, doc, doc[marked], doc[twice], doc[loud]])
    b = np.concatenate([bucket(word, 1), bucket(stem, 5), bucket(marks[marked], 2), np.full(len(twice), TWICE), np.full(len(loud), LOUD)])
    seen = np.unique(d << BITS | b)
    words = np.bincount(doc, minlength=n)
    first = np.minimum(np.cumsum(words) - words, len(word) - 1)
    edges = [(int(word[f]), int(word[f + w - 1])) if w else (0, 0) for f, w in zip(first, words)]
    return seen >> BITS, seen & (1 << BITS) - 1, words, np.bincount(doc[odd], minlength=n), edges


@dataclass
class Ordinal:
    """Weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each k from 1."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds[None, :], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 160, rate: float = 0.1, decay: float = 6e-4) -> Ordinal:
    """Weights and thresholds of least penalised log loss, by Adam over all rows."""
    prior = np.array([(np.sum(grades >= k) + (n_grades - k) / n_grades) / (len(grades) + 1) for k in range(1, n_grades)])
    thresholds = np.log((1 - prior) / prior)
    weights = np.zeros(1 << BITS, np.float32)
    if not len(rows) or len(set(grades.tolist())) < 2:
        return Ordinal(weights, thresholds)
    sizes = np.array([len(r) for r in rows])
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    often = np.bincount(flat, minlength=1 << BITS)
    ids = np.flatnonzero(often >= 2)
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    flat = place[flat]
    use = flat >= 0
    flat, doc = flat[use], doc[use]
    n, k = len(rows), n_grades - 1
    p = np.concatenate([np.zeros(len(ids)), [thresholds[0]], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = p[:len(ids)], np.exp(p[len(ids) + 1:])
        t = p[len(ids)] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(doc, w.astype(np.float32)[flat], minlength=n)
        c = np.concatenate([np.ones((n, 1)), sig(s[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        like = np.maximum(c[at, grades] - c[at, grades + 1], 1e-12)
        slope = c * (1 - c)
        up, down = slope[at, grades] / like, slope[at, grades + 1] / like
        ds = -(up - down) / n
        dt = np.zeros(k)
        np.add.at(dt, (grades - 1)[grades > 0], up[grades > 0] / n)
        np.add.at(dt, grades[grades < k], -down[grades < k] / n)
        back = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(flat, ds.astype(np.float32)[doc], minlength=len(ids)) + decay * w, [back[0]], back[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (1 - (step - 1) / steps) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[ids] = p[:len(ids)]
    return Ordinal(weights, p[len(ids)] + np.concatenate([[0], np.cumsum(np.exp(p[len(ids) + 1:]))]))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, text: str = "text", key: str = "doc_id", grade: str = "grade", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Ordinal:
    """Fits on rows of ``ratings`` (key, grade from 0) joined to their texts."""
    rated = ratings.select(F.col(key).alias("k"), F.col(grade).cast("int").alias("g")).filter(F.col("k").isNotNull() & F.col("g").between(0, n_grades - 1)).distinct()
    n = rated.select("k").distinct().count()
    share = min(1.0, sample_rows / max(1, n))
    low = F.xxhash64(F.lit(SEED), F.col("k")) <= (int((share - 0.5) * (2**64 - 1)) if share < 1 else 2**63 - 1)
    room = F.greatest(F.length("text") - sample_chars, F.lit(0)).cast("long")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).filter(low & F.col("text").isNotNull()).withColumn("t", F.xxhash64("text"))
    texts = texts.withColumn("text", F.substring("text", (F.pmod(F.col("t"), room + 1) + 1).cast("int"), F.lit(sample_chars)))
    # of rows that share their key a few, so that no key can fill the sample; equal rows count once
    few = lambda rows, order: rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(order))).filter(F.col("r") <= REPEATS).drop("r")
    picked = few(rated.filter(low), "g").join(few(texts.groupBy("k", "t").agg(F.min("text").alias("text")), "t"), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches, "text"):
            doc, index = features(*byte_view(own))
            order = np.argsort(doc, kind="stable")
            sizes = np.bincount(doc, minlength=batch.num_rows)
            ends = np.cumsum(sizes)
            index = index[order].astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("g"), pa.array([index[e - s:e].tobytes() for s, e in zip(sizes, ends)], pa.binary())], names=["k", "g", "f"])

    rows = sorted((r.k, r.g, bytes(r.f)) for r in small_batches(picked).mapInArrow(run, "k string, g int, f binary").collect())
    if not rows:
        return Ordinal(np.zeros(1 << BITS, np.float32), np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1)))
    return fit([np.frombuffer(f, "<i4") for _, _, f in rows], np.array([g for _, g, _ in rows]), n_grades)


def predict(df: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds expected_grade double, tails array<double> (P(grade >= k) for k from 1) and grade int (the likeliest)."""
    new = ["expected_grade", "tails", "grade"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("expected_grade", T.DoubleType(), False), T.StructField("tails", T.ArrayType(T.DoubleType(), False), False), T.StructField("grade", T.IntegerType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, lambda: None)
        model = shared.value
        weights = np.rint(model.weights.astype(np.float64) * 2**20)  # whole multiples: sums don't depend on order
        for batch, own in slices(batches, text):
            doc, index = features(*byte_view(own))
            tails = model.tails(np.bincount(doc, weights[index], minlength=batch.num_rows) / 2**20)
            grade = np.diff(np.concatenate([np.zeros((batch.num_rows, 1)), 1 - tails, np.ones((batch.num_rows, 1))], axis=1)).argmax(axis=1)
            out = add_column(batch.select(keep), "expected_grade", pa.array(tails.sum(axis=1)))
            out = add_column(out, "tails", pa.array(list(tails), pa.list_(pa.float64())))
            yield add_column(out, "grade", pa.array(grade.astype(np.int32)))

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)
