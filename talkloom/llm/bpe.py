"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of symbols. A pair of neighbours that the vocabulary can merge
lies in the bucket of its merge rank; a bitmap with one bit per rank, summarised word by word up to a
single word, gives the lowest non-empty bucket by find-first-set. Entries whose pair has changed since
they were queued are stale and skipped when met. A pre-token of n bytes takes O(n log n) at worst.

Defined results: a null or empty text gives no ids and decodes to no bytes; repeated rows are encoded
alike; an empty table gives an empty table; other columns of the input pass through untouched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_column, list_array, slices, small_batches, worker_state
from .pretokens import finder

#: Distinct pre-tokens a worker remembers in each of two generations.
MEMO_ENTRIES = 250_000
#: Longer pre-tokens are encoded each time they are met, so that the memory of a worker is bounded.
MEMO_CHARS = 64


class RankQueue:
    """Priority queue of list positions keyed by merge rank: buckets, and a bitmap hierarchy over the ranks.

    ``leaves`` has a bit for each rank, in words of 2**``shift`` bits; ``top``, a local of the merge loop, a bit for each word that
    isn't zero. A bucket is one position, or a heap of several. Queueing and taking stand in ``ByteBPE.encode_piece`` alone.
    """

    def __init__(self, ranks: int):
        self.shift = max(4, (max(1, ranks).bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.leaves = [0] * ((ranks >> self.shift) + 1)
        self.buckets: dict[int, int | list[int]] = {}
        self.bit = [1 << k for k in range(max(self.mask + 1, len(self.leaves)))]


class ByteBPE:
    """Encoder and decoder over a table of byte strings and ranks; every single byte has a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = finder(pattern)
        self.size = max(ranks.values()) + 1
        self.token = {r: t for t, r in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: (left id << 32 | right id) -> rank of the joined bytes, for every split of every token into two tokens.
        self.pair: dict[int, int] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                left, right = ranks.get(t[:k]), ranks.get(t[k:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = r
        self.queue = RankQueue(self.size)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        byte, pair = self.byte, self.pair.get
        ids = [byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [pair(a << 32 | b) for a, b in zip(ids, ids[1:])]
        rank_at.append(None)
        queue = self.queue
        buckets, leaves, bit, shift, mask, top = queue.buckets, queue.leaves, queue.bit, queue.shift, queue.mask, 0
        fresh = [(r, i) for i, r in enumerate(rank_at) if r is not None]
        while True:
            for r, i in fresh:  # push
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = i
                    at = r >> shift
                    word = leaves[at]
                    if not word:
                        top |= bit[at]
                    leaves[at] = word | bit[r & mask]
                elif type(bucket) is int:
                    buckets[r] = [i, bucket] if i < bucket else [bucket, i]
                else:
                    heappush(bucket, i)
            if not top:
                break
            at = (top & -top).bit_length() - 1  # pop
            word = leaves[at]
            low = word & -word
            r = at << shift | low.bit_length() - 1
            i = buckets[r]
            if type(i) is not int:
                bucket = i
                i = heappop(bucket)
            else:
                bucket = None
            if not bucket:
                del buckets[r]
                leaves[at] = word ^ low
                if word == low:
                    top ^= bit[at]
            if rank_at[i] != r:
                fresh = ()
                continue  # stale
            j = after[i]
            k = after[j]
            ids[i], after[i], rank_at[j] = r, k, None
            fresh = []
            if k < n:
                before[k] = i
                rank_at[i] = new = pair(r << 32 | ids[k])
                if new is not None:
                    fresh.append((new, i))
            else:
                rank_at[i] = None
            h = before[i]
            if h >= 0:
                rank_at[h] = new = pair(ids[h] << 32 | r)
                if new is not None:
                    fresh.append((new, h))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Memo(dict):
    """Pre-token -> its ids as packed 32-bit integers, in two generations of bounded size."""

    def __init__(self, bpe: ByteBPE, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.bpe, self.entries, self.old = bpe, entries, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.bpe.encode_piece(piece.encode())
            packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in id order, and each token's start and length; an id that the file lacks has length -1."""
    with open(path, "rb") as f:
        token = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    size = max(token) + 1
    lengths = np.array([len(token[i]) if i in token else -1 for i in range(size)], np.int64)
    starts = np.zeros(size, np.int64)
    np.cumsum(np.maximum(lengths, 0)[:-1], out=starts[1:])
    return np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8), starts, lengths


def decode_ids(ids: np.ndarray, path: str, chunk: int = 1 << 18) -> np.ndarray:
    """Bytes of a run of ids; ValueError for an id that the vocabulary lacks."""
    data, starts, lengths = token_table(path)
    out = []
    for k in range(0, len(ids), chunk):
        part = ids[k:k + chunk].astype(np.int64)
        if part.size and (part.min() < 0 or part.max() >= len(lengths) or lengths[part].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        n = lengths[part]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts[part] - (ends - n), n)
        out.append(data[at])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>): the BPE ids of each whole text. ``keep``: the columns that stay (default: all but the text)."""
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else [c for c in keep if c != ids]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state(("bpe", path, pattern), lambda: Memo(ByteBPE.load(path, pattern)))
        find, get = known.bpe.find, known.__getitem__
        for batch, texts in slices(batches, text):
            packed = [b"".join(map(get, find(t))) for t in texts.to_pylist()]
            lengths = np.fromiter((len(p) >> 2 for p in packed), np.int64, len(packed))
            column = list_array(b"".join(packed), lengths, pa.int32()).cast(pa.list_(pa.int32()))
            yield add_column(batch.select(keep), ids, column)

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``decode(encode(df))`` in one pass: adds ``ids`` and ``out``, the bytes that those ids stand for."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (ids, out) and (keep is not None or c != text)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state(("bpe", path, pattern), lambda: Memo(ByteBPE.load(path, pattern)))
        find, get = known.bpe.find, known.__getitem__
        for batch, texts in slices(batches, text):
            packed = [b"".join(map(get, find(t))) for t in texts.to_pylist()]
            lengths = np.fromiter((len(p) >> 2 for p in packed), np.int64, len(packed))
            flat = b"".join(packed)
            column = list_array(flat, lengths, pa.int32()).cast(pa.list_(pa.int32()))
            yield add_column(add_column(batch.select(keep), ids, column), out, decoded(np.frombuffer(flat, "<i4"), lengths, path))

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def decoded(ids: np.ndarray, lengths: np.ndarray, path: str) -> pa.Array:
    """The bytes of each run of ids, as a binary array."""
    ends = np.cumsum(lengths)
    return pa.array([decode_ids(ids[e - k:e], path).tobytes() for e, k in zip(ends, lengths)], pa.binary())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary): the bytes that each row's ids stand for. A null list decodes to no bytes."""
    columns = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(whole.num_rows, 1024))
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                lists = batch.column(ids).cast(pa.large_list(pa.int32()))
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield add_column(batch, out, decoded(lists.flatten().to_numpy(zero_copy_only=False), n, path))

    return small_batches(df.select(*columns)).mapInArrow(run, schema)
