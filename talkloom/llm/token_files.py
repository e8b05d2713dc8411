"""Token ids as flat files of unsigned integers with 64-bit document offsets, memory-mapped on reading.

Layout of a folder, one set of files for each partition of the key order:
    part-00000.bin   token ids of the partition's documents, one after the other, little-endian uint16
                        if the vocabulary has at most 65,536 ids, else uint32
    part-00000.idx   n + 1 little-endian uint64: where each document starts in the .bin file, in ids
    part-00000.key   n little-endian int64: the documents' keys (0 for those without one, which stand first)
    bases.json       ids before each partition (prefix sums of the partitions' sizes), documents, and those without a key

Partitions hold about equal bytes of text: quantiles of the keys give fine ranges, whose bytes are added up and dealt out.
A key that fills more than a partition is dealt to several by a hash of its texts, equal texts too.

A task writes under a name of its own and renames at its end, so that a repeated or speculative task
leaves whole files only. The folder must be one that the driver and all executors share.

Defined results: a null or empty text is a document of the end id alone; documents without a key come first; those of equal
keys lie together, in the order of a hash; an empty table gives a folder with no parts.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_state
from .pretokens import finder, is_latin

MEMO_ENTRIES = 400_000
MEMO_CHARS = 64
MARK = "\ue000"


def open_folder(uri: str):
    """(pyarrow file system, path in it) of a shared folder."""
    from pyarrow import fs

    parsed = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parsed.path)) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


class Encoder:
    """Ids of whole texts under a tokenizers file.

    For a byte-level BPE without normaliser a text's ids are those of its pre-tokens in turn; each distinct
    pre-token is encoded by the library once and remembered (two generations of bounded size).
    Any other tokenizer, texts with an added token inside, and texts beyond U+024F (where the installed
    libraries know different versions of Unicode) are encoded whole.
    """

    def __init__(self, path: str, pattern: str, most_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        #: Two bytes an id if all ids fit, else four.
        self.dtype = "<u2" if max(most_id + 1, self.whole.get_vocab_size(with_added_tokens=True)) <= 1 << 16 else "<u4"
        form = json.loads(self.whole.to_str())
        pre = form["pre_tokenizer"] or {}
        self.by_piece = form["model"]["type"] == "BPE" and not form["normalizer"] and not form["post_processor"] and not form["model"]["dropout"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        self.added = [t["content"] for t in form["added_tokens"]]
        self.pieces = Tokenizer.from_file(path)
        self.pieces.no_truncation()
        self.pieces.no_padding()
        self.pieces.encode_special_tokens = True
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(MARK, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.find = finder(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def learn(self, wanted: set[str]) -> list[str]:
        """Makes all wanted pre-tokens known; returns those too long to be kept."""
        if len(self.known) > MEMO_ENTRIES:
            self.before, self.known = self.known, {}
        known, before, missing = self.known, self.before, []
        for w in wanted.difference(known):
            if (p := before.get(w)) is not None:
                known[w] = p
            else:
                missing.append(w)
        known.update(zip(missing, self.of_pieces(missing)))
        return [w for w in missing if len(w) > MEMO_CHARS]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(pieces), 4096):
            part = pieces[k:k + 4096]
            found = self.pieces.encode(MARK.join(part), add_special_tokens=False)
            ids, words = np.array(found.ids, self.dtype), np.array(found.word_ids)
            cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(ids)]
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer joined or lost a pre-token")
            raw, size = ids.tobytes(), ids.itemsize
            out += [raw[size * a:size * b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        plain = [self.by_piece and is_latin(t) and not any(a in t for a in self.added) for t in texts]
        words = [self.find(t) if p else () for t, p in zip(texts, plain)]
        long = self.learn(set().union(*words))
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) if p else np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for t, p, w in zip(texts, plain, words)]
        for w in long:
            del self.known[w]
        return out


def write_token_files(df: DataFrame, folder: str, path: str, pattern: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> list[dict]:
    """Writes the files of ``df`` in ascending order of ``key``; returns a row for each partition, with its base."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows, parts = dealt_out(rows, max(1, df.select(key).rdd.getNumPartitions()))
    fs, top = open_folder(folder)
    fs.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, fs = TaskContext.get().partitionId(), open_folder(folder)[0]
        own, enc = f"{top}/.{part}-{uuid.uuid4().hex}", worker_state(("token files", path, pattern, end_id), lambda: Encoder(path, pattern, end_id))
        end, keys, sizes, nulls = np.array([end_id], enc.dtype).tobytes(), [], [], 0
        with fs.open_output_stream(f"{own}.bin") as out:
            for batch, texts in slices(batches, "text"):
                packed = enc.encode(texts.to_pylist())
                out.write(b"".join(p + end for p in packed))
                sizes += [len(p) // len(end) + 1 for p in packed]
                keys.append(batch.column("key").fill_null(0).to_numpy())
                nulls += batch.column("key").null_count
        if sizes:
            offsets = np.zeros(len(sizes) + 1, "<u8")
            np.cumsum(sizes, out=offsets[1:])
            for kind, data in (("idx", offsets), ("key", np.concatenate(keys).astype("<i8"))):
                with fs.open_output_stream(f"{own}.{kind}") as out:
                    out.write(data.tobytes())
            for kind in ("bin", "idx", "key"):
                fs.move(f"{own}.{kind}", f"{top}/part-{part:05d}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": [len(sizes)], "ids": [int(offsets[-1])], "width": pa.array([len(end)], pa.int32()), "nulls": [nulls]})
        else:
            fs.delete_file(f"{own}.bin")

    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("key").asc_nulls_first(), "place", "text")
    totals = sorted(small_batches(dealt.select("key", "text")).mapInArrow(run, "part int, documents long, ids long, width int, nulls long").collect())
    bases, ids, documents = [], 0, 0
    for r in totals:
        bases.append({"part": r.part, "base": ids, "first": documents, "documents": r.documents, "ids": r.ids, "width": r.width, "nulls": r.nulls})
        ids, documents = ids + r.ids, documents + r.documents
    with fs.open_output_stream(f"{top}/bases.json") as out:
        out.write(json.dumps(bases).encode())
    return bases


#: Fine key ranges for each partition, whose bytes decide how they are dealt out.
FINE = 4


def dealt_out(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """``rows`` (key, text) with part int, ascending with the key, and place double, their order within a key; and the number of parts."""
    cuts = sorted(set(rows.filter("key is not null").approxQuantile("key", [k / (FINE * parts) for k in range(1, FINE * parts)], 0.2 / (FINE * parts)))) if parts > 1 else []
    # places of equal texts differ by where they are read, so that a key of one text many times over can be dealt out too
    place = (F.xxhash64("text", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).cast("double") / 2.0**64 + 0.5).alias("place")
    rows = rows.select("key", "text", place)
    if parts == 1:
        return rows.withColumn("part", F.lit(0)), 1
    # with b cuts below a key: range 2 b + 2 if it equals the next cut, else 2 b + 1; 0 for rows without a key
    below = bucket_of(F.col("key"), cuts)
    same = F.coalesce(F.get(F.from_json(F.lit(json.dumps([int(c) for c in cuts])), "array<bigint>"), below) == F.col("key"), F.lit(False)).cast("int")
    rows = rows.withColumn("fine", F.when(F.col("key").isNull(), F.lit(0)).otherwise(2 * below + 1 + same).cast("int"))
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long")
    sizes = {r.fine: (r.bytes, r.low == r.high) for r in rows.groupBy("fine").agg(F.sum(size).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
    first, split, n = deal([sizes.get(k, (0, False)) for k in range(2 * len(cuts) + 2)], parts)
    table = lambda x: F.from_json(F.lit(json.dumps(x)), "array<int>")
    pieces = F.get(table(split), F.col("fine"))
    part = F.get(table(first), F.col("fine")) + F.least(F.floor(F.col("place") * pieces).cast("int"), pieces - 1)
    return rows.withColumn("part", part).drop("fine"), n


def deal(ranges: list[tuple[int, bool]], parts: int) -> tuple[list[int], list[int], int]:
    """(first part, number of parts) of each range of (bytes, whether it is one key), and how many parts there are in all."""
    most = max(1, -(-sum(n for n, _ in ranges) // parts))
    first, split, now, held = [], [], 0, 0
    for n, one in ranges:
        alone = one and n > 1.5 * most
        if held and (alone or held + n > 1.25 * most):
            now, held = now + 1, 0
        first.append(now)
        split.append(-(-n // most) if alone else 1)
        now, held = (now + split[-1], 0) if alone else (now, held + n)
    return first, split, now + 1


def bucket_of(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds lie below the key, by halving; the bounds are one constant, however many there are."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([int(b) for b in bounds])), "array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = F.get(table, mid) < key
        step = F.struct(F.when(below, mid + 1).otherwise(span["lo"]).alias("lo"), F.when(below, span["hi"]).otherwise(mid).alias("hi"))
        return F.when(span["lo"] < span["hi"], step).otherwise(span)

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda span: span["lo"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(key long, start long, n_tokens long, ids binary) of each document: ``ids`` are little-endian uint32."""
    fs, top = open_folder(folder)
    with fs.open_input_stream(f"{top}/bases.json") as f:
        bases = json.loads(f.read())
    schema = "key long, start long, n_tokens long, ids binary"
    if not bases:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, width, nulls in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "width", "nulls"))):
                ids, offsets, keys = open_part(folder, part, width)
                lo = 0
                while lo < len(keys):
                    most = int(np.searchsorted(offsets, int(offsets[lo]) + READ_IDS, side="right")) - 1
                    hi = min(max(lo + 1, most), lo + 4096, len(keys))
                    run, at = ids(int(offsets[lo]), int(offsets[hi])), (offsets[lo:hi + 1] - offsets[lo]).astype(np.int64)
                    key = pa.array(np.array(keys[lo:hi]), mask=np.arange(lo, hi) < nulls)
                    yield pa.RecordBatch.from_pydict({"key": key, "start": pa.array(offsets[lo:hi].astype(np.int64) + base), "n_tokens": pa.array(np.diff(at)), "ids": pa.array([run[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])], pa.binary())})
                    lo = hi

    parts = spark.range(0, len(bases), 1, len(bases))
    table = spark.createDataFrame([(k, b["part"], b["base"], b["width"], b["nulls"]) for k, b in enumerate(bases)], "id long, part int, base long, width int, nulls long")
    return parts.join(table, "id").select("part", "base", "width", "nulls").repartition(len(bases), "part").mapInArrow(run, schema)


#: Ids read at once, one document at least.
READ_IDS = 1 << 20


def open_part(folder: str, part: int, width: int) -> tuple[Callable[[int, int], np.ndarray], np.ndarray, np.ndarray]:
    """(ids from one place to another, offsets, keys) of one part; memory-mapped where the folder is a local path, else the ids are read range by range."""
    fs, top = open_folder(folder)
    name = lambda kind: f"{top}/part-{part:05d}.{kind}"
    if type(fs).__name__ == "LocalFileSystem":
        ids, offsets, keys = (np.memmap(name(kind), dtype, "r") for kind, dtype in (("bin", f"<u{width}"), ("idx", "<u8"), ("key", "<i8")))
        return (lambda lo, hi: ids[lo:hi]), offsets, keys
    whole = []
    for kind, dtype in (("idx", "<u8"), ("key", "<i8")):
        with fs.open_input_file(name(kind)) as f:
            whole.append(np.frombuffer(f.read(), dtype))
    file = fs.open_input_file(name("bin"))
    return (lambda lo, hi: np.frombuffer(file.read_at((hi - lo) * width, lo * width), f"<u{width}")), *whole
