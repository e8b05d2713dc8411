"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's words (A-Z lowered, white space is \\x20 and \\x09-\\x0D) give shingles of ``shingle`` words, repeats
included (fewer words: the whole sequence); a bit of the 64-bit fingerprint is 1 if it is set in over half
of the shingles' XXH64 hashes (seed 42). A text without words has fingerprint 0, linked like any other.

Two fingerprints link at ``distance`` or fewer differing bits. The 64 bits are dealt into partitions, such
that bits which are correlated over the corpus stand together. If thresholds t_1 .. t_m sum to
distance - m + 1, a linked pair differs in at most t_i bits in some partition i. For every fingerprint
dynamic programming picks the thresholds (-1: don't look there) of least estimated cost: its probes, and
the candidates that the corpus holds in the balls around its parts. Probes and fingerprints meet by
(partition, value); every pair that meets is verified. No bucket is capped: the probes of a large one are
dealt to several groups, each of which gets the bucket's fingerprints.

Work is on distinct fingerprints, so exact copies cost nothing. What reaches the driver and is broadcast
has a fixed size: a 64 x 64 table of bit counts and a histogram of 2**16 values for each partition. The
number of partitions, where it isn't given, is the one of least estimated cost over the whole corpus: it
bears on cost alone, never on the links.

Defined results: null text counts as empty; a null key keeps its row; equal rows share their component; a
component is named by its smallest non-null key; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column, slices, small_batches, worker_state, written

SHINGLE = 4
DISTANCE = 4
#: Numbers of partitions to choose from where none is given; what a number of partitions can be at all.
CHOICES = (3, 4, 5, 6, 7, 8)
LEAST_PARTITIONS, MOST_PARTITIONS = 2, 16
#: Cost of one probe in candidates: a shuffled row against one comparison of two numbers.
PROBE_COST = 40.0
SHINGLES_AT_ONCE = 1 << 16

#: LANES[b] has bit k of b in byte k.
LANES = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)) @ (np.uint64(1) << np.uint64(8) * np.arange(8, dtype=np.uint64))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    full = len(lanes) // 255 * 255
    sums = lanes[:full].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
    sums = np.concatenate([sums, lanes[full:].sum(axis=0, dtype=np.uint64)[None, :]])
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    h, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for k in range(0, n, SHINGLES_AT_ONCE):
        pairs = zip(starts[k:k + SHINGLES_AT_ONCE].tolist(), ends[k:k + SHINGLES_AT_ONCE].tolist())
        hashes = np.array([h(joined[a:b], 42) for a, b in pairs], np.uint64)
        counts += bit_counts(hashes)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint (long) of each whole text."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, lambda: None)
        for batch, texts in slices(batches, text):
            yield add_column(batch.select(keep), out, pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64()))

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


# --- partitions, histogram and thresholds


def bit_table(fps: DataFrame) -> np.ndarray:
    """How many distinct fingerprints have both bits i and j, 64 x 64; added up in two steps."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            f = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "t": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 * 64, np.int64)
        for batch in batches:
            for t in batch.column("t").to_pylist():
                total += np.frombuffer(t, np.int64)
        yield pa.RecordBatch.from_pydict({"t": [total.tobytes()]})

    tables = fps.mapInArrow(one, "g int, t binary").repartition(64, "g").mapInArrow(add, "t binary").collect()
    return sum((np.frombuffer(r.t, np.int64).reshape(64, 64) for r in tables), np.zeros((64, 64), np.int64))


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deals the 64 bits into m partitions of about equal size; a partition grows by the bit most correlated with it."""
    if n < 2:
        corr = np.zeros((64, 64))
    else:
        p = np.diag(both) / n
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        first = max(left, key=lambda b: (round(corr[b, left].max(), 9), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            new = max(left, key=lambda b: (round(corr[b, group].mean(), 9), -b))
            group.append(new)
            left.remove(new)
        groups.append(sorted(group))
    return groups


@lru_cache(maxsize=64)
def gather_tables(bits: tuple[int, ...]) -> np.ndarray:
    """Table [byte place, byte value] -> these bits of the fingerprint, packed."""
    out = np.zeros((8, 256), np.int64)
    for k, b in enumerate(bits):
        out[b // 8] |= (np.arange(256) >> (b % 8) & 1) << k
    return out


def parts_of(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each fingerprint in each partition."""
    raw = fps.astype("<i8").view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(fps), len(groups)), np.int64)
    for i, g in enumerate(groups):
        t = gather_tables(tuple(g))
        for place in range(8):
            out[:, i] |= t[place][raw[:, place]]
    return out


@lru_cache(maxsize=64)
def ball(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` bits set, fewest first."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)], np.int64)


def histograms(fps: DataFrame, choices: list[list[list[int]]]) -> list[list[np.ndarray]]:
    """For each choice of partitions, how many distinct fingerprints have each value (of its first 16 bits, if it is wider) in each."""
    every = [(m, i, g) for m, groups in enumerate(choices) for i, g in enumerate(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = parts_of(batch.column(0).to_numpy(), [g for _, _, g in every]) & 0xFFFF
            for k in range(len(every)):
                v, n = np.unique(p[:, k], return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(v), k), pa.int32()), "v": pa.array(v, pa.int32()), "n": pa.array(n, pa.int64())})

    counts = fps.mapInArrow(run, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toArrow()
    k, v, n = (counts.column(c).to_numpy() for c in ("k", "v", "n"))
    out: list[list[np.ndarray]] = [[] for _ in choices]
    for at, (m, _, g) in enumerate(every):
        h = np.zeros(1 << min(16, len(g)), np.int64)
        h[v[k == at]] = n[k == at]
        out[m].append(h)
    return out


def ball_costs(hist: list[np.ndarray], groups: list[list[int]], units: int) -> list[np.ndarray]:
    """costs[i][u, v]: probes and candidates for looking in partition i at radius u - 1 around v; u = 0: not at all.

    A partition takes at most two units more than its even share: dearer balls are never worth it, and the shares always add up.
    """
    most, out = -(-units // len(groups)) + 2, []
    for h, g in zip(hist, groups):
        values = np.arange(len(h))
        narrow = min(16, len(g))
        costs = np.full((units + 1, len(h)), np.inf, np.float32)
        costs[0] = 0
        total, done = np.zeros(len(h)), 0
        for u in range(1, min(units, most, len(g) + 1) + 1):
            masks = ball(narrow, min(u - 1, narrow))
            for mask in masks[done:]:
                total += h[values ^ mask]
            done = len(masks)
            wide = sum(comb(len(g), k) for k in range(u))
            costs[u] = PROBE_COST * wide + total * wide / done / 2.0 ** (len(g) - narrow)
        out.append(costs)
    return out


def expected_cost(hist: list[np.ndarray], costs: list[np.ndarray], units: int) -> float:
    """Cost of an average fingerprint under the best thresholds that are the same for all."""
    best = np.full(units + 1, np.inf)
    best[0] = 0
    for h, own in zip(hist, costs):
        mean = np.array([(c[h > 0].astype(np.float64) * h[h > 0]).sum() for c in own]) / max(1, h.sum())
        best = np.array([min(best[s - u] + mean[u] for u in range(s + 1)) for s in range(units + 1)])
    return float(best[units])


def allocate(parts: np.ndarray, costs: list[np.ndarray], units: int) -> np.ndarray:
    """Units (threshold + 1) of each partition for each fingerprint: dynamic programming over the partitions."""
    n, m = parts.shape
    best = np.full((units + 1, n), np.inf, np.float32)
    best[0] = 0
    taken = np.zeros((m, units + 1, n), np.int8)
    for i in range(m):
        own = costs[i][:, parts[:, i] & len(costs[i][0]) - 1]
        new = np.full_like(best, np.inf)
        for s in range(units + 1):
            for u in range(s + 1):
                c = best[s - u] + own[u]
                better = c < new[s]
                new[s] = np.where(better, c, new[s])
                taken[i, s] = np.where(better, u, taken[i, s])
        best = new
    out, left = np.zeros((n, m), np.int64), np.full(n, units)
    for i in range(m - 1, -1, -1):
        out[:, i] = taken[i, left, np.arange(n)]
        left = left - out[:, i]
    return out


#: Places in a bucket above which the probes of it are dealt to several groups.
BUCKET = 4096
#: Pairs compared at once.
PAIRS = 1 << 21


def verified(k: np.ndarray, s: np.ndarray, f: np.ndarray, probe: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of probes, rows of places) of the same (k, s) within the distance; rows are sorted by (k, s, probe)."""
    group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (s[1:] != s[:-1]))])
    begins = np.searchsorted(group, np.arange(group[-1] + 1))
    places = np.bincount(group, ~probe)[group].astype(np.int64)
    rows = np.flatnonzero(probe & (places > 0))
    upto = np.cumsum(places[rows])
    lo = 0
    while lo < len(rows):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
        n = places[rows[lo:hi]]
        ends = np.cumsum(n)
        q = np.arange(int(ends[-1])) + np.repeat(begins[group[rows[lo:hi]]] - (ends - n), n)
        p = np.repeat(rows[lo:hi], n)
        x = f[p] ^ f[q]
        near = np.flatnonzero((np.bitwise_count(x.view(np.uint64)) <= distance) & (x != 0))
        yield p[near], q[near]
        lo = hi


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) with the components of the edges a-b: one for each node that isn't the smallest of its own."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[:len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not (root[root] == root).all():
            root = root[root]
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[at]], nodes[at]


def ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two different values, the smaller one first."""
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def partitioned(fps: DataFrame, distance: int, partitions: int | None) -> tuple[list[list[int]], list[np.ndarray], list[np.ndarray]]:
    """(bits of each partition, histograms, costs) for the number of partitions given, or of least expected cost."""
    if partitions is not None and not LEAST_PARTITIONS <= partitions <= MOST_PARTITIONS:
        raise ValueError(f"the number of partitions must be from {LEAST_PARTITIONS} to {MOST_PARTITIONS}")
    both, n = bit_table(fps), fps.count()
    choices = [group_bits(both, n, m) for m in (CHOICES if partitions is None else [partitions])]
    hists = histograms(fps, choices)
    costs = [ball_costs(h, g, distance + 1) for h, g in zip(hists, choices)]
    best = min(range(len(choices)), key=lambda m: (expected_cost(hists[m], costs[m], distance + 1), m))
    return choices[best], hists[best], costs[best]


def links(fps: DataFrame, distance: int = DISTANCE, partitions: int | None = None, every: bool = True, labelled: bool = False) -> DataFrame:
    """(a long, b long), a < b: all pairs of distinct fingerprints at 1 to ``distance`` differing bits.

    Without ``every``: edges with the same components, at most one for each linked fingerprint and task, so that a
    group of many alike fingerprints doesn't give a number of rows that is the square of its size.
    ``labelled``: the second column of ``fps`` labels each fingerprint; the pairs are those of different labels that
    linked fingerprints have.
    """
    spark, units = fps.sparkSession, distance + 1
    fps = fps.select(F.col(fps.columns[0]).alias("f"), F.col(fps.columns[1] if labelled else fps.columns[0]).alias("label"))
    groups, hist, costs = partitioned(fps.select("f"), distance, partitions)
    shared = spark.sparkContext.broadcast((costs, [-(-h // BUCKET) for h in hist]))
    names = ["k", "s", "f", "label", "probe"]

    def spread(i: int, values: np.ndarray) -> np.ndarray:
        """Groups that a bucket's probes are dealt to; its places go to each."""
        return np.maximum(1, shared.value[1][i][values & len(shared.value[1][i]) - 1])

    def batch_of(k: np.ndarray, s: np.ndarray, f: np.ndarray, label: np.ndarray, probe: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(s.astype(np.int32)), pa.array(f), pa.array(label), pa.array(np.full(len(k), probe))], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                f, label = (whole.column(c).slice(lo, 8192).to_numpy() for c in (0, 1))
                parts = parts_of(f, groups)
                taken = allocate(parts, shared.value[0], units)
                salt = (f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                for i, g in enumerate(groups):
                    copies = spread(i, parts[:, i])
                    ends = np.cumsum(copies)
                    yield batch_of(np.repeat(parts[:, i] << 4 | i, copies), np.arange(ends[-1]) - np.repeat(ends - copies, copies), np.repeat(f, copies), np.repeat(label, copies), False)
                    for u in range(1, units + 1):
                        at = np.flatnonzero(taken[:, i] == u)
                        masks = ball(len(g), u - 1) if len(at) else []
                        for m in range(0, len(masks), 256):
                            part = masks[m:m + 256]
                            values = (parts[at, i][:, None] ^ part[None, :]).ravel()
                            yield batch_of(values << 4 | i, np.repeat(salt[at], len(part)) % spread(i, values), np.repeat(f[at], len(part)), np.repeat(label[at], len(part)), True)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        fewer = ordered if labelled else forest

        def done(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            k, s, f, label, probe = part
            for p, q in verified(k, s, f, probe, distance):
                x, y = label[p], label[q]
                if every and not labelled:
                    for lo in range(0, len(x), 1 << 16):
                        low, high = np.minimum(x[lo:lo + (1 << 16)], y[lo:lo + (1 << 16)]), np.maximum(x[lo:lo + (1 << 16)], y[lo:lo + (1 << 16)])
                        yield pa.RecordBatch.from_pydict({"a": low, "b": high})
                elif len(x):
                    found.append(fewer(x, y))
                    if sum(len(z) for z, _ in found) > 1 << 20:
                        found[:] = [fewer(*(np.concatenate(z) for z in zip(*found)))]
                        if labelled and len(found[0][0]) > 1 << 19:
                            yield pa.RecordBatch.from_arrays([pa.array(z) for z in found.pop()], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            if sum(len(h[0]) for h in held) < 1 << 18:
                continue
            now = [np.concatenate(x) for x in zip(*held)]
            cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
            if len(cut):  # the last group may go on
                yield from done([x[:cut[-1] + 1] for x in now])
                now = [x[cut[-1] + 1:] for x in now]
            held = [now]
        if held:
            now = [np.concatenate(x) for x in zip(*held)]
            if len(now[0]):
                yield from done(now)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in fewer(*(np.concatenate(z) for z in zip(*found)))], names=["a", "b"])

    dealt = small_batches(fps).mapInArrow(rows, "k long, s int, f long, label long, probe boolean").repartition("k", "s").sortWithinPartitions("k", "s", "probe")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


# --- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of edges (a, b).

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes; the number
    of rounds grows with the logarithm of the longest path.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Pairs (u, v): every u sends v's (the larger ones, or all) to its smallest neighbour."""
        # written, so that the join deals both sides out anew and a node with very many neighbours can be split
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        joined = pairs.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        if large:
            return joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return joined.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.filter("m != u").select(F.col("m").alias("a"), F.col("u").alias("b")))

    edges = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(star(both, True).distinct(), "large")
        edges = written(star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), False).distinct(), "small")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, partitions: int | None = None) -> DataFrame:
    """(key, fingerprint long, component_id, is_first): component_id is the smallest key that links reach from the row's
    fingerprint; is_first marks the rows of that key and its smallest fingerprint (of a component without keys, of its smallest fingerprint)."""
    rows = written(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), keep=["key"], shingle=shingle), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct")
    roots = components(links(distinct.select("fingerprint"), distance, partitions, every=False))
    rooted = written(distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fingerprint")).alias("name"))
    names = written(names, "names")
    named = rooted.join(names, "root").select(F.col("fingerprint").alias("f"), F.col("name.least").alias("component_id"), F.col("name.fingerprint").alias("first"))
    joined = rows.join(named, rows.fingerprint == F.col("f"))
    return joined.select(F.col("key").alias(key), "fingerprint", "component_id", (F.col("key").eqNullSafe(F.col("component_id")) & (F.col("fingerprint") == F.col("first"))).alias("is_first"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, partitions: int | None = None) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row of smallest key (of rows that share it, one)."""
    marked = written(near_duplicates(df, key, text, shingle, distance, partitions), "marked")
    again = marked.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.col(key).alias("k"))
    again = written(again, "repeated")
    # keys of one row: a semi-join on the key decides; rows that share a key (or have none) are told apart by fingerprint
    single = marked.filter("is_first").select(F.col(key).alias("k"))
    if not again.limit(1).count():
        return df.join(single, df[key].eqNullSafe(F.col("k")), "left_semi")
    single = single.join(again.withColumnRenamed("k", "r"), F.col("k").eqNullSafe(F.col("r")), "left_anti")
    alone = df.join(single, df[key].eqNullSafe(F.col("k")), "left_semi")
    rest = fingerprints(df.join(again, df[key].eqNullSafe(F.col("k")), "left_semi"), text, shingle, out="simhash_fingerprint")
    firsts = marked.filter("is_first").select(F.col(key).alias("k"), F.col("fingerprint").alias("f")).distinct()
    rest = rest.join(firsts, rest[key].eqNullSafe(F.col("k")) & (F.col("simhash_fingerprint") == F.col("f")), "left_semi")
    return alone.unionByName(rest.dropDuplicates([key, "simhash_fingerprint"]).select(df.columns))
