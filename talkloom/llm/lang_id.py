"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes holds how often each byte followed each context
of 0 to ``order`` bytes. A byte costs -log2(n / (t + q)) bits in the longest context that has seen it
(n: its count, t: the context's count, q: its distinct successors); each longer known context that has not
costs an escape of -log2(q / (t + q)); a byte that no context has seen costs 8 bits more. The statistics are
frozen after training, so a text's code length is a sum of fixed costs per (context, byte); costs are
whole multiples of 2**-16 bit, sums are exact. The language of the shortest code is predicted.

Training reads a bounded sample of rows with a language: ``per_language`` different rows of each at most, those of lowest
hash, ``MAX_ROWS`` in all (but one of each language at least), of a longer text a run of ``sample_chars`` characters at a place
that its hash picks. N-grams are counted on the executors; the driver gets the counts. Prediction covers whole texts.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and where no language was
learned; ties go to the language of smaller name; repeated rows agree; an empty table gives an empty table;
clashing columns of the input are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, byte_view, slices, small_batches, worker_state, written

ORDER = 4
PER_LANGUAGE = 400
SAMPLE_CHARS = 4_000
#: Sampled rows of all languages together, if there are no more languages than that.
MAX_ROWS = 8_000
SEED = 11
FIXED = 1 << 16
CHUNK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """For each byte the key of it and the ``order`` bytes before it (zeros before the first), the byte lowest."""
    padded = np.concatenate([np.zeros(order, np.uint8), raw])
    keys = np.zeros(len(raw), np.uint64)
    for k in range(order + 1):
        keys = keys << np.uint64(8) | padded[k:k + len(raw)]
    return keys


class ContextTrees:
    """Frozen statistics of all languages, and the costs they give."""

    def __init__(self, order: int, langs: list[str], symbols: list[list[tuple[np.ndarray, np.ndarray]]], contexts: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.order, self.langs, self.symbols, self.contexts = order, langs, symbols, contexts

    @classmethod
    def train(cls, samples: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
        keys = {lang: np.concatenate([grams(np.frombuffer(t, np.uint8), order) for t in texts] or [np.zeros(0, np.uint64)]) for lang, texts in samples.items()}
        return cls.of_counts({lang: (k, np.ones(len(k), np.int64)) for lang, k in keys.items()}, order)

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> ContextTrees:
        """Trees of languages from n-grams (see ``grams``) and how often each occurs."""
        langs, symbols, contexts = sorted(counts), [], []
        for lang in langs:
            keys, often = counts[lang]
            own_symbols, own_contexts = [], []
            for k in range(order + 1):
                seen, place = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(place, often, minlength=len(seen)).astype(np.int64)
                context, first = np.unique(seen >> np.uint64(8), return_index=True)
                total = np.add.reduceat(n, first) if len(n) else n
                distinct = np.diff(np.append(first, len(seen)))
                of = np.repeat(np.arange(len(context)), distinct)
                own_symbols.append((seen, fixed(n / (total + distinct)[of]) if len(n) else np.zeros(0, np.int64)))
                own_contexts.append((context, fixed(distinct / (total + distinct)) if len(n) else np.zeros(0, np.int64)))
            symbols.append(own_symbols)
            contexts.append(own_contexts)
        return cls(order, langs, symbols, contexts)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Costs of distinct keys, a column for each language."""
        out = np.zeros((len(keys), len(self.langs)), np.int32)
        for lang in range(len(self.langs)):
            cost, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
            for k in range(self.order, -1, -1):
                part = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
                hit, at = find(self.symbols[lang][k][0], part)
                cost[open_[hit]] += self.symbols[lang][k][1][at[hit]]
                open_, part = open_[~hit], part[~hit]
                known, at = find(self.contexts[lang][k][0], part >> np.uint64(8))
                cost[open_[known]] += self.contexts[lang][k][1][at[known]]
            cost[open_] += 8 * FIXED
            out[:, lang] = cost
        return out


def fixed(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * FIXED).astype(np.int64)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the sorted table holds, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


class Scorer:
    """Code lengths under the trees; remembers costs in a direct-mapped table of bounded size."""

    def __init__(self, trees: ContextTrees):
        self.trees, n = trees, max(1, len(trees.langs))
        self.bits = max(8, min(20, (1 << 23) // n).bit_length() - 1 if n > 8 else 20)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros((1 << self.bits, n), np.int32)

    def bytes_cost(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        cost = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            own = self.trees.costs(new)
            cost[miss] = own[back]
            at = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = new[first], own[first]
        return cost

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in 2**-16 bits, a column for each language."""
        n, order = len(offsets) - 1, self.trees.order
        out = np.zeros((n, len(self.trees.langs)), np.int64)
        chunk = max(1, 4 * CHUNK // max(4, len(self.trees.langs)))
        for lo in range(0, len(raw), chunk):
            hi = min(lo + chunk, len(raw))
            first, last = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left")
            before = max(0, lo - order)
            keys = grams(raw[before:hi], order)[lo - before:]
            starts = offsets[first:last]
            for k in range(order):  # what stands before a text's first bytes is not its own
                at = starts + k
                at = at[(at >= lo) & (at < hi) & (at < offsets[first + 1:last + 1])]
                keys[at - lo] &= np.uint64((1 << 8 * (k + 1)) - 1)
            cost = self.bytes_cost(keys)
            full = np.flatnonzero(offsets[first + 1:last + 1] > np.maximum(starts, lo))
            out[first + full] += np.add.reduceat(cost, np.maximum(starts[full] - lo, 0), axis=0, dtype=np.int64)
        return out


def sampled(labelled: DataFrame, text: str, lang: str, key: str, per_language: int, sample_chars: int) -> DataFrame:
    """(lang, piece, inside): the sample; ``inside`` tells that a piece doesn't start its text."""
    # of equal rows one counts, rows that share a key but not the text are told apart
    h = F.xxhash64(F.lit(SEED), F.col(key), F.col(text))
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).cast("string").alias("lang"), h.alias("h"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n"))
    langs = counts.agg(F.count("*")).scalar()
    most = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(MAX_ROWS) / langs)))
    # twice what is wanted, so that a low draw of a rare language leaves enough; the lowest of these are taken
    below = F.when(2.0 * F.col("most") / F.col("n") >= 1, F.lit(2**63 - 1)).otherwise(((2.0 * F.col("most") / F.col("n") - 0.5) * float(2**64)).cast("long"))
    limits = written(counts.withColumn("most", most.cast("int")).select(F.col("lang").alias("l"), "most", below.alias("below")), "limits")
    room = F.greatest(F.length("text") - sample_chars, F.lit(0))
    place = F.pmod(F.col("h"), room.cast("long") + 1).cast("int")
    low = rows.join(limits, F.col("lang") == F.col("l")).filter("h <= below").select("lang", "h", "most", F.substring("text", place + 1, F.lit(sample_chars)).alias("piece"), (place > 0).alias("inside"))
    one = low.groupBy("lang", "h").agg(F.min(F.struct("piece", "inside", "most")).alias("x")).select("lang", "h", "x.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return one.withColumn("r", rank).filter("r <= most").select("lang", "piece", "inside")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = ORDER, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> ContextTrees:
    """Trees from the rows of ``labelled`` that have a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "piece"):
            own: dict[str, list[np.ndarray]] = {}
            for name, t, inside in zip(batch.column("lang").to_pylist(), texts.to_pylist(), batch.column("inside").to_pylist()):
                keys = grams(np.frombuffer(t.encode(), np.uint8), order)
                own.setdefault(name, []).append(keys[order:] if inside else keys)
            for name, parts in own.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys), pa.string()), "g": keys.view(np.int64), "n": pa.array(n, pa.int64())})

    sample = small_batches(sampled(labelled, text, lang, key, per_language, sample_chars))
    found = sample.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found.column("lang").to_pylist(), object)
    g, n = found.column("g").to_numpy().view(np.uint64), found.column("n").to_numpy()
    return ContextTrees.of_counts({name: (g[names == name], n[names == name]) for name in sorted(set(names.tolist()))}, order)


def predict(df: DataFrame, trees: ContextTrees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred string, score double (the posterior share of the predicted language) and bits_per_byte double (its code length)."""
    new = ["lang_pred", "score", "bits_per_byte"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("bits_per_byte", T.DoubleType())])
    shared, name = df.sparkSession.sparkContext.broadcast(trees), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language ID", name), lambda: Scorer(shared.value))
        langs = np.array([*scorer.trees.langs, "und"], object)
        for batch, texts in slices(batches, text):
            raw, offsets = byte_view(texts)
            lettered = np.array([LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            n = batch.num_rows
            best, score, rate = np.full(n, len(langs) - 1), np.zeros(n), np.full(n, np.nan)
            if len(langs) > 1 and n:
                bits = scorer.lengths(raw, offsets)
                least = bits.min(axis=1)
                post = 1 / np.exp2(-np.minimum((bits - least[:, None]) / FIXED, 1000.0)).sum(axis=1)
                best = np.where(lettered, bits.argmin(axis=1), best)
                score = np.where(lettered, post, 0.0)
                rate = np.where(lettered, least / FIXED / np.maximum(np.diff(offsets), 1), np.nan)
            out = add_column(batch.select(keep), "lang_pred", pa.array(langs[best].tolist(), pa.string()))
            yield add_column(add_column(out, "score", pa.array(score)), "bits_per_byte", pa.array(rate, mask=~np.isfinite(rate)))

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)
