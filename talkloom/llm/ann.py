"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of ``books`` full-dimensional codebooks. Codebooks
start as k-means over successive residuals and are refitted jointly by least squares; codes are found by
beam search over the residuals. The index holds a vector's codes and the norm of its residual.

The first codewords of a code are its cell: the first book's, and where a cell holds too many vectors the next
one's too, up to ``DEPTH``. A query's inner products with all codewords form lookup tables. They rank the cells
(sum of the cell's codewords, and what its spread may add), and cells are probed in that order until they hold
``reach`` vectors. A probed vector's score is the sum of its codewords' entries; vectors whose score, with three
deviations of what the residual's norm may add, reaches the bar that the exact scores of the ``candidates`` best
set are ranked by the exact inner product, in double precision on the original vectors.

``reach`` is measured on every run: the true neighbours of ``TRIALS`` queries, found by brute force in one pass over the
index, give the least reach that probes the cells of ``TARGET`` of them. Vectors in clusters need few cells, whatever
their number; vectors without any structure need most of them. The measure is logged.

Equal vectors share one code: an index entry is a distinct vector with its smallest ids (as many as a result
can need), so a vector that a third of all rows hold costs no more than any other. Cells in order make blocks; a task
holds one block of codes and one of the queries that probe it.

Codebooks are fitted on a bounded sample (``SAMPLE`` distinct vectors of lowest hash); every vector is indexed.

Defined results: a vector that is null, zero, of another length than most, or has a null or non-finite
component takes no part; ties go to the smaller id; a null id takes no part; with fewer candidates than
``k`` all are returned; an empty table gives an empty table. An id with several vectors asks with each and is found by
each, its best score counts, and so a result may then be short of ``k``; of rows that repeat one (id, vector) one counts.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOOKS = 24
WORDS = 256
BEAM = 4
SAMPLE = 16_384
CANDIDATES = 400
QUERY_BLOCK = 1024
CODE_BLOCK = 65_536
SEED = 3
#: Codewords that name a cell at most, vectors of a cell from which on it is split, and cells that are split at most.
DEPTH = 3
SPLIT = 512
SPLIT_CELLS = 8192
#: Queries whose true neighbours set the reach, and the share of these neighbours whose cells must be probed.
TRIALS = 128
TARGET = 0.97
#: Components beyond this are cut down before coding; what that takes off counts as residual.
LARGEST = 1e15
log = logging.getLogger(__name__)


@dataclass
class Codebooks:
    books: np.ndarray  # (books, words, dimensions) float32

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, refits: int = 2) -> Codebooks:
        random, x = np.random.RandomState(SEED), x.astype(np.float32)
        out = np.zeros((books, words, x.shape[1]), np.float32)
        rest = x.copy()
        for m in range(books):
            c = rest[random.permutation(len(rest))[:words]] if len(rest) >= words else np.concatenate([rest, np.zeros((words - len(rest), x.shape[1]), np.float32)])
            c = c.copy()
            for _ in range(rounds):
                near = nearest(rest, c)
                n = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                used = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[used]
                c[used] = np.add.reduceat(rest[order], starts, axis=0) / n[used, None]
            out[m] = c
            rest -= c[nearest(rest, c)]
        found = cls(out)
        for _ in range(refits if len(x) > words else 0):
            found.refit(x, found.encode(x))
        return found

    def refit(self, x: np.ndarray, codes: np.ndarray, steps: int = 15, ridge: float = 1e-2) -> None:
        """Least-squares codewords for these codes, all books at once, by conjugate gradients from the old ones."""
        orders = []
        for i in range(codes.shape[1]):
            order = np.argsort(codes[:, i], kind="stable")
            orders.append((order, *np.unique(codes[order, i], return_index=True)))

        def gathered(y: np.ndarray) -> np.ndarray:
            """For every codeword the sum of the vectors that use it."""
            out = np.zeros(self.books.shape)
            for i, (order, used, starts) in enumerate(orders):
                out[i, used] = np.add.reduceat(y[order], starts, axis=0)
            return out

        def applied(c: np.ndarray) -> np.ndarray:
            return gathered(sum(c[i][codes[:, i]] for i in range(len(c)))) + ridge * c

        c = self.books.astype(np.float64)
        rest = gathered(x.astype(np.float64)) + ridge * c - applied(c)
        way, size = rest.copy(), (rest**2).sum(axis=(0, 1))
        for _ in range(steps):
            if not size.any():
                break
            image = applied(way)
            step = size / np.maximum((way * image).sum(axis=(0, 1)), 1e-300)
            c += step * way
            rest -= step * image
            new = (rest**2).sum(axis=(0, 1))
            way, size = rest + new / np.maximum(size, 1e-300) * way, new
        self.books = c.astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM, chunk: int = 2048) -> np.ndarray:
        """Codes (n, books) uint8 by beam search."""
        return np.concatenate([self._encode(x[k:k + chunk].astype(np.float32), beam) for k in range(0, len(x), chunk)]) if len(x) else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            b = rest.shape[1]
            error = (rest**2).sum(-1)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, b, -1) + (book**2).sum(-1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors through lookup tables."""
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            out += (queries @ book.T)[:, codes[:, m]]
        return out


def nearest(x: np.ndarray, c: np.ndarray, chunk: int = 8192) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(x[k:k + chunk] @ c.T - half).argmax(1) for k in range(0, len(x), chunk)])


def usable(vector: str) -> Column:
    """Not null, not zero, all components there and finite."""
    return F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x != 0)")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def single(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LARGEST, LARGEST).astype(np.float32)


@dataclass
class Cells:
    """Cells in the order of their codewords: the lowest code of each (its first DEPTH codewords as a number), depth, vectors, spread and block."""

    low: np.ndarray
    depth: np.ndarray
    size: np.ndarray
    spread: np.ndarray
    block: np.ndarray

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The cells of coded vectors."""
        return np.searchsorted(self.low, lowest_code(codes), side="right") - 1

    def order(self, books: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the cells, best first, and how many vectors the cells before each hold."""
        scores = np.zeros((len(queries), len(self.low)))
        for m in range(min(DEPTH, len(books))):
            word = self.low >> 8 * (DEPTH - 1 - m) & 255
            scores += np.where(self.depth > m, (queries @ books[m].T)[:, word], 0)
        scores += 2.5 * np.linalg.norm(queries.astype(np.float64), axis=1)[:, None] * self.spread / np.sqrt(queries.shape[1])
        best = np.argsort(-scores, axis=1, kind="stable")
        held = self.size[best]
        return best, np.cumsum(held, axis=1) - held


def lowest_code(codes: np.ndarray) -> np.ndarray:
    """The first DEPTH codewords as a number."""
    out = np.zeros(len(codes), np.int64)
    for m in range(DEPTH):
        out = out << 8 | (codes[:, m].astype(np.int64) if m < codes.shape[1] else 0)
    return out


def cells_of(entries: DataFrame, n: int) -> Cells:
    """Splits cells of too many vectors by the next codeword, level by level; what reaches the driver is a row a cell."""
    most, found, large = max(SPLIT, n // SPLIT_CELLS), [], None
    for depth in range(1, DEPTH + 1):
        rows = entries.select(F.substring("codes", 1, depth).alias("p"), F.substring("codes", 1, depth - 1).alias("up"), (F.col("early")[depth - 1] ** 2).alias("s"))
        if large is not None:
            rows = rows.join(F.broadcast(large), "up")
        counts = rows.groupBy("p").agg(F.count("*").alias("n"), F.avg("s").alias("s")).collect()
        again = [r for r in counts if r.n > most and depth < DEPTH]
        found += [(int.from_bytes(bytes(r.p).ljust(DEPTH, b"\0"), "big"), depth, r.n, r.s**0.5) for r in counts if not (r.n > most and depth < DEPTH)]
        if not again:
            break
        large = entries.sparkSession.createDataFrame([(bytes(r.p),) for r in again], "up binary")
    low, deep, size, spread = (np.array(x) for x in zip(*sorted(found)))
    return Cells(low.astype(np.int64), deep, size.astype(np.int64), spread.astype(np.float64), (np.cumsum(size) - size) // CODE_BLOCK)


def code_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


@dataclass
class Index:
    codebooks: Codebooks | None
    entries: DataFrame  # rep long, members array<long>, vector, codes binary, rest double, early array<double>
    rows: DataFrame  # vec_id, vector: all that take part
    n: int
    cells: Cells | None = None


def build(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> Index:
    """The index over every usable vector; ``k``: how many neighbours searches will ask for."""
    spark = df.sparkSession
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector")).filter(F.col("vec_id").isNotNull() & usable("vector"))
    widest = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = widest[0].d if widest else 0
    rows = rows.filter(F.size("vector") == d)
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("rep"), "members", "vector")
    classes = written(classes, "classes")
    n = classes.count()
    schema = f"rep long, members array<long>, vector {kind}, codes binary, rest double, early array<double>"
    if not n:
        return Index(None, spark.createDataFrame([], schema), rows, 0)
    sample = classes.withColumn("h", F.xxhash64(F.lit(SEED), "rep", "vector")).orderBy("h", "rep").limit(SAMPLE).select("vector").toArrow()
    books = Codebooks.fit(single(matrix(sample.column("vector").combine_chunks())))
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            codes = shared.value.encode(single(x))
            left, early = x.astype(np.float64), []
            for m, book in enumerate(shared.value.books):
                left = left - book[codes[:, m]]
                early.append(np.linalg.norm(left, axis=1))
            early = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(early[:DEPTH], axis=1).ravel()), DEPTH).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.linalg.norm(left, axis=1)), early], names=["rep", "members", "vector", "codes", "rest", "early"])

    entries = written(classes.mapInArrow(run, schema), "index")
    return Index(books, entries, rows, n, cells_of(entries, n))


def reach_of(index: Index, distinct: DataFrame, k: int, target: float) -> int:
    """How many vectors the probed cells must hold, from the true neighbours of some of the queries."""
    spark, cells = index.entries.sparkSession, index.cells
    trials = distinct.withColumn("h", F.xxhash64(F.lit(SEED), "q", "vector")).orderBy("h", "q").limit(TRIALS).select("q", "vector").toArrow()
    if not trials.num_rows:
        return 1
    asked, ids = matrix(trials.column("vector").combine_chunks()).astype(np.float64), trials.column("q").to_numpy()
    shared = spark.sparkContext.broadcast((asked, ids, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, cells = shared.value
        for batch in batches:
            x, reps = matrix(batch.column("vector")).astype(np.float64), batch.column("rep").to_numpy()
            own = cells.of(code_matrix(batch.column("codes")))
            s = np.where(ids[:, None] == reps[None, :], -np.inf, asked @ x.T)
            keep = min(k, len(reps))
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            yield pa.RecordBatch.from_pydict({"t": np.repeat(np.arange(len(ids)), keep), "cell": own[best].ravel(), "s": np.take_along_axis(s, best, 1).ravel()})

    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "cell"))
    near = index.entries.select("rep", "vector", "codes").mapInArrow(run, "t long, cell long, s double").withColumn("r", rank).filter(F.col("r") <= k).filter("s > double('-infinity')").select("t", "cell").toArrow()
    t, cell = near.column("t").to_numpy(), near.column("cell").to_numpy()
    if not len(t):
        return index.n
    order, before = cells.order(index.codebooks.books, single(asked))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    need = np.sort(before[t, place[t, cell]])
    reach = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1
    log.warning("additive quantisation: %d vectors in %d cells; %d probed a query hold %.3f of the true neighbours of %d queries", index.n, len(cells.low), reach, float(np.mean(need < reach)), len(ids))
    return reach


def search(index: Index, queries: DataFrame, k: int, candidates: int = CANDIDATES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every query (vec_id, vector of the index), its own row left out."""
    if not index.n:
        return index.entries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    spark, entries = index.entries.sparkSession, index.entries
    asked = written(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("v")).join(entries.select("rep", "vector"), F.col("v") == F.col("vector")).select("query_id", F.col("rep").alias("q"), "vector"), "asked")
    distinct = written(asked.select("q", "vector").distinct(), "queries")
    reach = reach_of(index, distinct, k, target)
    shared = spark.sparkContext.broadcast((index.codebooks, index.cells))
    kind = entries.schema["vector"].dataType.simpleString()

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, cells = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                order, before = cells.order(books.books, single(matrix(batch.column("vector"))))
                at, blocks, lists = [], [], []
                for i in range(batch.num_rows):
                    probed = np.sort(order[i][before[i] < reach])
                    cuts = np.flatnonzero(np.diff(cells.block[probed])) + 1
                    for part in np.split(probed, cuts):
                        at.append(i)
                        blocks.append(int(cells.block[part[0]]))
                        lists.append(part)
                picked = batch.take(pa.array(at))
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(blocks, pa.int32()), flat], names=["q", "vector", "block", "cells"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value[1]
            own = cells.of(code_matrix(batch.column("codes")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(cells.block[own].astype(np.int32))], names=["rep", "members", "own", "codes", "rest", "cell", "block"])

    left = written(distinct.mapInArrow(probes, f"q long, vector {kind}, block int, cells array<int>"), "probes")
    groups = left.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("groups"))
    left = left.join(groups, "block").withColumn("qb", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int")).drop("groups")
    right = entries.select("rep", "members", F.col("vector").alias("own"), "codes", "rest").mapInArrow(placed, f"rep long, members array<long>, own {kind}, codes binary, rest double, cell int, block int")
    right = right.join(groups, "block").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts, schema = [], pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        books, cell = shared.value[0], b.column("cell").to_numpy()
        order = np.lexsort((b.column("rep").to_numpy(), cell))
        cell, codes = cell[order], code_matrix(b.column("codes").combine_chunks())[order]
        own, rest = matrix(b.column("own").combine_chunks())[order].astype(np.float64), b.column("rest").to_numpy()[order]
        members = b.column("members").combine_chunks().take(pa.array(order))
        held, flat = members.value_lengths().to_numpy(), members.flatten().to_numpy()
        begin = np.cumsum(held) - held
        vectors, ids, wanted = matrix(a.column("vector").combine_chunks()), a.column("q").to_numpy(), a.column("cells").to_pylist()
        for lo in range(0, len(ids), 64):
            v = vectors[lo:lo + 64]
            tables = [single(v) @ book.T for book in books.books]
            s = np.full((len(v), len(cell)), -np.inf, np.float32)
            probing: dict[int, list[int]] = {}
            for i, probed in enumerate(wanted[lo:lo + 64]):
                for c in probed:
                    probing.setdefault(c, []).append(i)
            for c, who in probing.items():
                x, y = np.searchsorted(cell, c), np.searchsorted(cell, c, side="right")
                s[who, x:y] = sum(t[who][:, codes[x:y, m]] for m, t in enumerate(tables))
            for i, q in enumerate(v.astype(np.float64)):
                there = np.flatnonzero(s[i] > -np.inf)
                if not len(there):
                    continue
                size, near = np.linalg.norm(q), s[i][there].astype(np.float64)
                keep = min(max(candidates, k + 1), len(there))
                first = there[np.argpartition(-near, keep - 1)[:keep]]
                exact = np.sort((own[first] * q).sum(axis=1))
                bar = exact[max(0, keep - k - 1)]
                able = there[(near + 3 * size * rest[there] / np.sqrt(len(q)) >= bar)]
                able = np.union1d(able, first[(own[first] * q).sum(axis=1) >= bar])
                exact = (own[able] * q).sum(axis=1)
                # all that tie with the last one stay
                good = exact >= np.partition(exact, len(able) - min(k + 1, len(able)))[len(able) - min(k + 1, len(able))]
                able, exact = able[good], exact[good]
                n = held[able]
                ends = np.cumsum(n)
                parts.append((np.full(ends[-1], ids[lo + i]), flat[np.arange(ends[-1]) + np.repeat(begin[able] - (ends - n), n)], np.repeat(exact, n)))
        if not parts:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)

    near = left.groupBy("block", "qb").cogroup(right.groupBy("block", "qb")).applyInArrow(run, "q long, vec_id long, score double")
    few = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1).drop("r")
    # an id of several rows asks and is found by its best one
    answers = asked.select("query_id", "q").distinct().join(best, "q").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
