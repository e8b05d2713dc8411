"""SimHash near-duplicates with every link checked on the sets of shingles, the pipeline's near-dedup."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

from talkloom.llm import queries, similar

from ..oracle import SF


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or bool(a and b) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)


def bits(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 2]), 42) for i in range(max(1, len(words) - 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, distance):
    """The smallest key of each row's group: pairs alike and within the distance link."""
    sets, prints, root = [brute_set(t) for _, t in rows], [bits(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and alike(a, sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def found_groups(df, **kind):
    heads, roots = similar.grouped(df, **kind)
    named = heads.join(roots, "node", "left").selectExpr("key", "coalesce(root, node) as root").collect()
    least = {}
    for r in named:
        least[r.root] = min(least.get(r.root, r.key), r.key)
    return {r.key: least[r.root] for r in named}


def variants(seed=4):
    r, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for size in (3, 5, 9, 40, 60, 150, 400):
        for _ in range(4):
            text = r.choices(words, k=size)
            rows.append(text)
            for changes in (0, 1, 2, 3, size // 50 + 1, size // 25 + 1):
                new = list(text)
                for _ in range(changes):
                    new[r.randrange(size)] = r.choice(words)
                rows.append(new)
            rows.append(text + r.choices(words, k=size // 5))
    rows += [["common"] * 6 + ["line", "of", "every", "page"] + r.choices(words, k=3) for _ in range(40)]
    return [(i, " ".join(t)) for i, t in enumerate(rows)] + [(1000, ""), (1001, None), (1002, " ")]


def test_near_dedup_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 7)
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, near, all_alike = found_groups(df), brute_groups(rows, similar.DISTANCE), brute_groups(rows, 64)
    # what both the fingerprints and the similarity link stands in one group; no group joins what no similarity joins
    assert all(got[k] == got[g] for k, g in near.items())
    assert all(all_alike[k] == all_alike[g] for k, g in got.items())
    assert sorted(r.doc_id for r in similar.one_of_each(df).collect()) == sorted(set(got.values()))


def test_near_dedup_recall(spark):
    """Of the pairs that are alike, whatever their fingerprints, at least 97 of 100 share a group; all groups are right."""
    docs = queries.documents(spark, SF.replace("sf0.001", "sf0.01"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, got, all_alike = {k: brute_set(t) for k, t in rows}, found_groups(docs), brute_groups(rows, 64)
    assert all(all_alike[k] == all_alike[g] for k, g in got.items())
    sizes = Counter(all_alike.values())
    grouped = sorted(k for k, g in all_alike.items() if sizes[g] > 1)
    pairs = [(a, b) for a, b in combinations(grouped, 2) if all_alike[a] == all_alike[b] and alike(sets[a], sets[b])]
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)


def test_alike_pairs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(similar, "DENSE", 4)
    r = random.Random(8)
    base = r.sample(range(10**6), 60)
    sets = [set(r.sample(base, r.randrange(40, 60))) | set(r.sample(range(10**6), r.randrange(6))) for _ in range(60)]
    arrays, side = [np.array(sorted(s), np.uint64) for s in sets], np.arange(60) % 2
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if alike(sets[i], sets[j])}
    assert set(zip(*(x.tolist() for x in similar.alike_pairs(arrays)))) == want
    assert set(zip(*(x.tolist() for x in similar.alike_pairs(arrays, side)))) == {(i, j) for i, j in want if side[i] != side[j]}


def test_candidate_groups_cover_all_links(spark):
    r, values = random.Random(9), set()
    for _ in range(30):
        f = r.getrandbits(63)
        for _ in range(12):
            values.add(f)
            f ^= sum(1 << b for b in r.sample(range(63), r.randrange(1, 8)))
    values = sorted(values)
    nodes = spark.createDataFrame([(i, v, 5) for i, v in enumerate(values)], "node long, f long, n long")
    groups = {}
    for row in similar.candidate_groups(nodes, 10, 4).collect():
        groups.setdefault(row.g, set()).add(row.node)
    together = {(a, b) for g in groups.values() for a, b in combinations(sorted(g), 2)}
    assert {(a, b) for a, b in combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 10} <= together


def test_near_dedup_edges(spark, edge, clash, empty):
    for df in (edge, clash):
        out = similar.one_of_each(df)
        assert out.columns == df.columns
        assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 6, 8, 9, 10]
    assert similar.one_of_each(empty).count() == 0
    nulls = edge.selectExpr("case when doc_id > 5 then doc_id end as doc_id", "text", "lang", "source", "n_chars")
    assert similar.one_of_each(nulls).count() == 7
