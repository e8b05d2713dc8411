"""SimHash near-duplicates with every link checked exactly, on the Jaccard similarity of shingle sets.

A text's words (as in ``simhash``) give the set of its shingles of ``shingle`` words (fewer words: the whole sequence).
Texts whose sets are equal are one node. Two nodes link if the Jaccard similarity of their sets is ``least`` or more and
fingerprints of theirs, made of shingles of ``print_shingle`` words, stand in one candidate group; groups of near-duplicates
are the connected components. Fingerprints of short shingles are used because one changed word alters five shingles of
five words, but two of two: at a similarity of 0.8 two fingerprints of five-word shingles differ in 10 of 64 bits in the
middle, those of two-word shingles in 6.

Candidate groups: components of fingerprints at ``tight`` or fewer differing bits form cores; cores that hold fingerprints at
``distance`` or fewer differing bits (all of them are found, see ``simhash.links``) are linked, and the nodes of the smaller
one are guests of the larger one's group. So a large group of near copies costs its size, not its pairs, in rows. Inside a
group all pairs of sets are compared; a large one is dealt into blocks, and each pair of blocks is compared on its own.

No pair of ``distance`` or fewer differing bits and a similarity of ``least`` or more is lost, none of a lower similarity
links. Shingles and sets are told apart by 64-bit hashes.

Defined results: null text counts as empty; texts without words are equal; a null key comes last; an empty table gives an
empty table; repeated rows count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_state, written
from .simhash import components, fingerprint, forest, links

SHINGLE = 5
LEAST = (4, 5)
PRINT_SHINGLE = 2
DISTANCE = 10
TIGHT = 4
#: Distinct words that a worker remembers the hashes of.
WORDS = 500_000
#: Shingles and texts of a block; a text larger than that is a block of its own.
BLOCK_SHINGLES = 1 << 20
BLOCK_TEXTS = 2048
#: Texts from which on a shingle's pairs are counted by a matrix product.
DENSE = 32


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def shingle_set(text: str, shingle: int = SHINGLE, hashes: dict | None = None) -> np.ndarray:
    """The hashes of the text's distinct shingles, in order (uint64)."""
    words = text.encode().lower().split()
    hashes = WordHashes() if hashes is None else hashes
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = max(min(1, len(h)), len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def enough(both, a, b, least: tuple[int, int] = LEAST):
    """Whether sets of a and b members that share ``both`` are alike."""
    return both * least[1] >= (a + b - both) * least[0]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share (above the diagonal)."""
    d = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(d), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    held = np.diff(np.append(starts, len(flat)))
    counts = np.zeros((d, d))
    for n in np.unique(held[(held > 1) & (held < DENSE)]):
        of = starts[held == n]
        for i in range(n):
            for j in range(i + 1, n):  # owners ascend: the sort is stable
                np.add.at(counts, (owner[of + i], owner[of + j]), 1)
    dense = np.flatnonzero(held >= DENSE)
    width = max(64, (1 << 24) // d)
    for lo in range(0, len(dense), width):
        part = dense[lo:lo + width]
        at = np.concatenate([owner[starts[k]:starts[k] + held[k]] for k in part])
        m = np.zeros((d, len(part)), np.float32)
        m[at, np.repeat(np.arange(len(part)), held[part])] = 1
        counts += np.triu(m @ m.T, 1)
    return counts


def alike_pairs(sets: list[np.ndarray], side: np.ndarray | None = None, least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of alike sets, of different sides where sides are given. No two sets are equal."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2 or not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(counts := np.triu(shared_counts(sets), 1))
    good = enough(counts[i, j].astype(np.int64), sizes[i], sizes[j], least)
    if side is not None:
        good &= side[i] != side[j]
    return i[good], j[good]


def text_id(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def prepared(df: DataFrame, key: str, text: str, shingle: int, print_shingle: int) -> DataFrame:
    """(key, t long: text, f long: fingerprint, node long: set, n long: its size) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("similar", WordHashes)
        for batch, texts in slices(batches, "text"):
            texts = texts.to_pylist()
            prints = [fingerprint(t, print_shingle) for t in texts]
            sets = [shingle_set(t, shingle, hashes) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t"), pa.array(prints, pa.int64()), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64())], names=["key", "t", "f", "node", "n"])

    rows = df.select(F.col(key).alias("key"), text_id(text).alias("t"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return written(small_batches(rows).mapInArrow(run, f"key {kind}, t long, f long, node long, n long"), "prepared")


def candidate_groups(nodes: DataFrame, distance: int, tight: int) -> DataFrame:
    """(g long, node long, n long): the groups in which nodes are compared, from rows (node, f, n)."""
    prints = written(nodes.select("f").distinct(), "prints")
    same = nodes.groupBy("node").agg(F.min("f").alias("a"), F.max("f").alias("z")).filter("a != z").select("node", "a")
    same = nodes.join(same, "node").filter("f != a").select("a", F.col("f").alias("b"))
    roots = components(links(prints, tight, every=False).unionByName(same))
    cores = written(prints.join(roots, F.col("f") == F.col("node"), "left").select("f", F.coalesce("root", "f").alias("root")), "cores")
    placed = written(nodes.join(cores, "f").select("root", "node", "n").distinct(), "placed")
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"))
    pairs = written(links(cores, distance, labelled=True), "core_links")
    pairs = pairs.join(sizes.select(F.col("root").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("root").alias("b"), F.col("size").alias("size_b")), "b")
    larger = F.struct("size_a", "a") > F.struct("size_b", "b")
    guests = pairs.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("g"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("root"))
    members = placed.select(F.col("root").alias("g"), "node", "n").unionByName(guests.join(placed, "root").select("g", "node", "n"))
    return written(members.distinct(), "members")


def alike_edges(df: DataFrame, rows: DataFrame, members: DataFrame, text: str, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between nodes, all alike, with the components of all alike pairs of each group."""
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("texts") / BLOCK_TEXTS)).cast("int")
    totals = members.groupBy("g").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).filter("texts > 1").select("g", blocks.alias("blocks"))
    members = written(members.join(totals, "g").select("g", "node", "blocks"), "compared")
    wanted = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("t").alias("t"))
    wanted = written(wanted, "wanted")
    texts = df.select(text_id(text).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(wanted.select("t"), "t", "left_semi").dropDuplicates(["t"])
    texts = written(texts.join(wanted, "t").select("node", "text"), "texts")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(texts, "node")
    dealt = dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "node")
    names = ("g", "lo", "hi", "node", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state("similar", WordHashes)
        group, held, found = None, [], []

        def compared() -> None:
            nodes, side = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])
            i, j = alike_pairs([h[2] for h in held], side if group[1] != group[2] else None, least)
            if len(i):
                found.append(forest(nodes[i], nodes[j]))

        for batch, own in slices(batches, "text"):
            for g, lo, hi, node, side, t in zip(*[batch.column(c).to_pylist() for c in names], own.to_pylist()):
                if (g, lo, hi) != group:
                    if len(held) > 1:
                        compared()
                    group, held = (g, lo, hi), []
                held.append((node, side, shingle_set(t, shingle, hashes)))
            if sum(len(a) for a, _ in found) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
                found.clear()
        if len(held) > 1:
            compared()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    return written(small_batches(dealt.select(*names, "text")).mapInArrow(run, "a long, b long").distinct(), "alike")


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, print_shingle: int = PRINT_SHINGLE, distance: int = DISTANCE, tight: int = TIGHT) -> tuple[DataFrame, DataFrame]:
    """(rows (key, t, f, node, n), (node, root) of every node that has a near-duplicate)."""
    rows = prepared(df, key, text, shingle, print_shingle)
    nodes = written(rows.select("node", "f", "n").distinct(), "nodes")
    return rows, components(alike_edges(df, rows, candidate_groups(nodes, distance, tight), text, shingle, least))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **kind) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row of smallest key (of rows that share it, one)."""
    heads, roots = grouped(df, key, text, **kind)
    # sets first: a set that very many rows share is one row of the join
    firsts = heads.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("first"))
    firsts = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    firsts = written(firsts.select(F.col("first.key").alias("k"), F.col("first.t").alias("f")), "firsts")
    again = written(heads.select("key", "t").join(firsts, heads.key.eqNullSafe(firsts.k) & (heads.t == firsts.f), "left_semi").groupBy("key", "t").count().filter("count > 1").select(F.col("key").alias("r"), F.col("t").alias("u")), "repeated")
    kept = df.join(firsts, df[key].eqNullSafe(F.col("k")) & (text_id(text) == F.col("f")), "left_semi")
    if not again.limit(1).count():
        return kept
    same = kept[key].eqNullSafe(F.col("r")) & (text_id(text) == F.col("u"))
    rest = kept.join(again, same, "left_semi").withColumn("similar_text_id", text_id(text)).dropDuplicates([key, "similar_text_id"])
    return kept.join(again, same, "left_anti").unionByName(rest.select(df.columns))
