"""Operators 1, 4, 7, 9 and 10 and the pipeline."""

import hashlib
import math
import random
import zlib
from datetime import date
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talkloom.llm import ann, media, mixing, queries, similar, simhash, url_filters

from ..oracle import SF, same_rows
from .test_similar import brute_groups

SF1 = SF.replace("sf0.001", "sf0.01")

# --- 1


def test_op1_equals_sql(spark):
    same_rows(queries.op1_url_filters(spark, SF), queries.OP1_SQL)


def host_lower(key):
    host, slash, segment = key.partition("/")
    return host.lower() + slash + segment


def covers(key, host, segment):
    h, _, s = key.partition("/")
    return (host == h or host.endswith("." + h)) and (not s or s == segment)


def test_op1_brute_force(spark):
    r = random.Random(1)
    hosts = ["a.b.org", "b.org", "c.a.b.org", "x.net", "deep.x.net"]
    urls = [f"https://{r.choice(hosts)}{r.choice(['', '/p', '/P', '/p/q', '/z?x=1', ':80/p'])}" for _ in range(200)] + [None, "", "nonsense", "http://user@B.ORG./p", "https://b.org/" + "p" * 100_000, "https://" + "a." * 300 + "b.org/P"]
    caps = [(i % 190, u, date(2024, 1, 1 + i % 28) if i % 50 else None) for i, u in enumerate(urls)]
    caps += caps[:5]
    entries = [(r.choice([*hosts, "b.org/p", "b.org/P", "X.net/z", "X.NET", "B.org/" + "p" * 100_000]), r.choice(["block", "allow", "drop"]), date(2024, 1, r.randrange(1, 28))) for _ in range(40)] + [(None, "block", date(2024, 1, 1)), ("x.net", None, date(2024, 1, 1)), ("x.net", "block", None)]
    df = spark.createDataFrame([(*c, "own") for c in caps], "page_id long, url string, fetched date, host string")
    rows = url_filters.filter_captures(df, spark.createDataFrame(entries, "key string, action string, since date")).collect()
    assert len(rows) == len(caps)
    rank = {"block": 3, "allow": 2, "drop": 1}

    def decide(url, at):
        import re

        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*(?:/([^/?#]+))?", url or "")
        if not m or at is None:
            return None, None
        host, segment, best = m[1].lower().rstrip("."), m[2] or "", None
        for key in {host_lower(e[0]) for e in entries if e[0]}:
            past = [(e[2], rank[e[1]]) for e in entries if e[0] and host_lower(e[0]) == key and e[1] and e[2] and e[2] <= at]
            if past and covers(key, host, segment) and max(past)[1] > 1 and (best is None or (len(key), key) > (len(best[0]), best[0])):
                best = (key, max(past)[1])
        return best or (None, None)

    got = sorted((r.page_id, r.url or "", str(r.fetched), r.list_key or "", r.blocked) for r in rows)
    want = sorted((c[0], c[1] or "", str(c[2]), decide(*c[1:])[0] or "", decide(*c[1:])[1] == 3) for c in caps)
    assert got == want
    assert not any(r.blocked for r in url_filters.filter_captures(df, spark.createDataFrame([], "key string, action string, since date")).collect())
    assert url_filters.filter_captures(df.limit(0), spark.createDataFrame(entries, "key string, action string, since date")).count() == 0


def test_op1_is_native(spark):
    plan = queries.op1_url_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# --- 4


def exact(rows, k):
    """Best of every query by brute force on (id, vector)."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v, np.float32).astype(np.float64)
            order = np.lexsort((ids, -np.round(s, 12)))
            out[i] = [(int(ids[j]), s[j]) for j in order if ids[j] != i][:k]
    return out


def recall(spark, df, k=20, **kind):
    index = ann.build(df, k)
    got = {}
    for r in ann.search(index, index.rows.filter("vec_id % 20 = 0"), k, **kind).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], k)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [x[2] for x in found] == list(range(1, len(found) + 1)) and len(found) == len(want[q])
        assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in pairwise(found))
        true = dict(exact_scores(df, q))
        assert all(abs(true[v] - s) < 1e-9 for v, s, _ in found)
    return np.mean([len({v for v, _ in want[q]} & {v for v, _, _ in got[q]}) / max(1, len(want[q])) for q in want])


_scores = {}


def exact_scores(df, q):
    key = id(df)
    if key not in _scores:
        _scores[key] = {r.vec_id: np.array(r.embedding, np.float32).astype(np.float64) for r in df.collect()}
    x = _scores[key]
    return [(i, float(v @ x[q])) for i, v in x.items()]


def test_op4_recall(spark):
    assert recall(spark, spark.read.parquet(f"{SF1}/embeddings.parquet")) >= 0.9


def test_op4_recall_with_few_candidates(spark):
    r = np.random.RandomState(0)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(spark, df, 10, candidates=120) >= 0.9


def test_op4_recall_of_unstructured_vectors():
    x = np.random.RandomState(1).normal(size=(20_000, 64)).astype(np.float32)
    books = ann.Codebooks.fit(x[:8192])
    codes, q, found = books.encode(x), x[::200], []
    exact_scores, scores = q.astype(float) @ x.T.astype(float), books.scores(q, codes)
    for e, a in zip(exact_scores, scores):
        best = np.argpartition(-a, ann.CANDIDATES)[:ann.CANDIDATES]
        found.append(len(set(np.argsort(-e)[:20]) & set(best)) / 20)
    assert np.mean(found) >= 0.9


def test_refit_lowers_the_error():
    x = np.random.RandomState(2).normal(size=(3000, 16)).astype(np.float32)
    books = ann.Codebooks.fit(x, books=4, words=32, refits=0)
    codes = books.encode(x)
    error = lambda: ((x - books.decode(codes)) ** 2).sum()
    before = error()
    books.refit(x, codes)
    assert error() < before
    onehot = np.zeros((3000, 4 * 32))
    for m in range(4):
        onehot[np.arange(3000), m * 32 + codes[:, m]] = 1
    best = onehot @ np.linalg.lstsq(onehot, x.astype(float), rcond=None)[0]
    assert error() < ((x - best) ** 2).sum() * 1.02


def test_op4_edges(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(i, v) for i in range(50)] + [(100, w), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (105, [1.0]), (106, [float("inf"), 1.0]), (None, v), (0, v)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<float>, score string")
    index = ann.build(df, 3)
    got = {}
    for r in ann.search(index, index.rows.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 1.0)], 20: [(0, 1.0), (1, 1.0), (2, 1.0)], 40: [(0, 1.0), (1, 1.0), (2, 1.0)], 100: [(0, 0.0), (1, 0.0), (2, 0.0)]}
    for none in (df.limit(0), df.filter("vec_id > 100")):
        index = ann.build(none, 3)
        assert ann.search(index, index.rows.filter("vec_id % 20 = 0"), 3).count() == 0
    alone = ann.build(df.filter("vec_id = 100"), 3)
    assert ann.search(alone, alone.rows, 3).count() == 0


def test_beam_is_no_worse_than_greedy():
    x = np.random.RandomState(0).normal(size=(2000, 8)).astype(np.float32)
    books = ann.Codebooks.fit(x, books=3, words=16, refits=1)
    error = lambda beam: ((x - books.decode(books.encode(x, beam))) ** 2).sum()
    assert error(8) <= error(1) < (x**2).sum()
    codes = books.encode(x)
    assert np.allclose(books.scores(x[:5], codes), x[:5] @ books.decode(codes).T, atol=1e-3)


# --- 7


@pytest.mark.parametrize("size", [0, 1, 64, 415, 1006, 1007, 2012, 5000, 100_000])
def test_op7_round_trip(size):
    data = random.Random(size).randbytes(size)
    stream = media.write_mpeg(data)
    a = media.read_mpeg(stream)
    assert a.payload == data and a.crc_bad == 0 and a.resyncs == 0 and a.crc_good == a.frames == a.table_frames
    assert a.samples == 1152 * a.frames and a.seconds()[0] * 44100 == a.samples * a.seconds()[1]
    for at in a.seek:
        assert media.parse_header(stream[at:at + 4]) is not None


def test_op7_damage():
    data = b"\xff\xfb\x90\x00" * 2000
    good = media.write_mpeg(data)
    a = media.read_mpeg(b"junk\xff\xe0" * 9 + good)
    assert a.payload == data and a.resyncs == 1 and a.skipped == 54
    cut = a.seek[2]
    hit = bytearray(b"junk\xff\xe0" * 9 + good)
    hit[cut + 10] ^= 1
    b = media.read_mpeg(bytes(hit))
    assert b.crc_bad == 1 and b.frames == a.frames
    lost = media.read_mpeg(good[:a.seek[3] - 54] + b"\0" * 77 + good[a.seek[3] - 54:])
    assert lost.frames == a.frames and lost.resyncs == 1 and lost.skipped == 77
    assert media.read_mpeg(b"").frames == media.read_mpeg(b"nothing here").frames == 0
    assert media.read_mpeg(good[:len(good) // 2]).frames > 0
    for n in range(0, len(good), 997):
        media.read_mpeg(good[n:])


def own_parser(stream):
    """A second reader, of streams without damage: bit strings, tables and tags read by their layout alone."""
    assert stream[:3] == b"ID3" and stream[3] == 4
    size = int("".join(f"{b:07b}" for b in stream[6:10]), 2)
    tag, at, length = stream[10:10 + size], 10 + size, None
    while tag:
        n = int("".join(f"{b:07b}" for b in tag[4:8]), 2)
        if tag[:4] == b"PRIV" and tag[10:].startswith(b"payload-length\0"):
            length = int.from_bytes(tag[10:10 + n][-8:], "big")
        tag = tag[10 + n:]
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    frames, table = [], None
    while stream[at:at + 3] != b"TAG":
        bits = "".join(f"{b:08b}" for b in stream[at:at + 4])
        assert bits[:15] == "1" * 12 + "101" and bits[20:22] == "00" and bits[24:26] == "00"  # MPEG-1 Layer III, 44,100 Hz, stereo
        rate = kbps[int(bits[16:20], 2)]
        size = 144 * rate * 1000 // 44100 + int(bits[22])
        frames.append((at, size, rate, bits[15] == "0"))
        at += size
    assert len(stream) - at == 128
    (first, size, _, protected), *frames = frames
    assert not protected and stream[first + 36:first + 40] == b"Xing"
    table = [int.from_bytes(stream[first + 40 + k:first + 44 + k], "big") for k in (0, 4, 8)]
    points = list(stream[first + 52:first + 152])
    body = b""
    for at, size, _, protected in frames:
        crc = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in stream[at + 2:at + 4] + stream[at + 6:at + 38]):
            crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
        assert protected and crc == int.from_bytes(stream[at + 4:at + 6], "big") and not any(stream[at + 6:at + 38])
        body += stream[at + 38:at + size]
    return {"first": first, "frames": frames, "table": table, "points": points, "payload": body[:length]}


@pytest.mark.parametrize("size", [0, 64, 5000, 70_000])
def test_op7_equals_a_second_reader(size):
    data = random.Random(size + 1).randbytes(size)
    stream = media.write_mpeg(data)
    a, b = media.read_mpeg(stream), own_parser(stream)
    assert (a.payload, a.seek, a.frames, a.crc_good) == (b["payload"], [f[0] for f in b["frames"]], len(b["frames"]), len(b["frames"]))
    assert b["payload"] == data and b["table"][:2] == [15, len(b["frames"])] and (a.table, a.table_frames, a.table_bytes) == ("Xing", *b["table"][1:])
    assert a.points == [b["first"] + a.table_bytes * p // 256 for p in b["points"]]
    rates = [f[2] for f in b["frames"]] or [0]
    n = 1152 * len(b["frames"])
    d = math.gcd(n, 44100) if n else 44100
    last = b["frames"][-1][0] if b["frames"] else -1
    assert media.feature(a) == f"mpeg1-layer3 44100Hz 2ch frames={len(b['frames'])} seconds={n // d}/{44100 // d} kbps={min(rates)}-{max(rates)} crc={len(b['frames'])}/{len(b['frames'])} table=Xing:{b['table'][1]} resyncs=0 last={last}"


def test_op7_vbri():
    h = bytes([0xFF, 0xFB, 0x90, 0x00])
    size = media.parse_header(h).size
    table = b"VBRI" + b"\0\1\0\0\0\0" + (3 * size).to_bytes(4, "big") + (2).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    first = (h + bytes(32) + table + (size // 3).to_bytes(2, "big") * 2).ljust(size, b"\0")
    a = media.read_mpeg(first + (h + bytes(size - 4)) * 2)
    assert (a.table, a.table_frames, a.table_bytes, a.points, a.seek) == ("VBRI", 2, 3 * size, [size, size + size // 3 * 3], [size, 2 * size])


@pytest.mark.parametrize(("head", "bits"), [
    (bytes([0xFF, 0xFE, 0x90, 0x00]), 4 * 64), (bytes([0xFF, 0xFE, 0x90, 0xC0]), 4 * 32), (bytes([0xFF, 0xFE, 0x90, 0x50]), 4 * (8 * 2 + 24)),  # Layer I: stereo, mono, joint from band 8 on
    (bytes([0xFF, 0xFC, 0xA0, 0x00]), 2 * (11 * 4 + 12 * 3 + 7 * 2)), (bytes([0xFF, 0xFC, 0x40, 0x00]), 2 * (2 * 4 + 6 * 3)), (bytes([0xFF, 0xF4, 0x80, 0xC0]), 4 * 4 + 7 * 3 + 19 * 2),
])
def test_op7_crc_of_layers_one_and_two(head, bits):
    h = media.parse_header(head)
    silent = head + b"\0\0" + bytes(h.size - 6)
    assert media.layer12_bits(silent, 0, h) == bits
    crc = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in head[2:]) + "0" * bits:
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
    frame = head + crc.to_bytes(2, "big") + bytes(h.size - 6)
    a = media.read_mpeg(frame * 3)
    assert (a.frames, a.crc_good, a.crc_bad) == (3, 3, 0)
    assert media.read_mpeg(frame * 2 + frame[:5] + bytes([frame[5] ^ 1]) + frame[6:]).crc_bad == 1


def test_op7_other_headers():
    h = media.parse_header(bytes([0xFF, 0xF3, 0x40, 0xC0]))  # MPEG-2 Layer III, 32 kbps, 22,050 Hz, mono
    assert (h.version, h.layer, h.kbps, h.rate, h.channels, h.samples, h.size, h.side) == (2, 3, 32, 22050, 1, 576, 104, 9)
    h = media.parse_header(bytes([0xFF, 0xFF, 0x10, 0x00]))  # MPEG-1 Layer I
    assert (h.layer, h.kbps, h.samples, h.size) == (1, 32, 384, 32)
    assert media.parse_header(b"\xff\xfb\xf0\x00") is None and media.parse_header(b"\xff\xfb\x00\x00") is None and media.parse_header(b"\xff") is None


def test_op7_rows_and_edges(spark, edge, clash, empty):
    docs = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    for r in queries.op7_mpeg(spark, SF).collect():
        raw = (docs[r.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stream = media.write_mpeg(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    for df in (edge, clash):
        df = df.withColumn("payload", F.col("text").cast("binary"))
        rows = media.read(media.store(df)).collect()
        both = media.store_and_read(df).collect()
        assert sorted(repr((r.doc_id, r.payload, r.feature)) for r in rows) == sorted(repr((r.doc_id, r.payload, r.feature)) for r in both)
        for r in both:
            assert bytes(r.payload) == (r.text or "").encode()
    assert media.store_and_read(empty.withColumn("payload", F.col("text").cast("binary"))).count() == 0


# --- 9


def brute_mix(rows, blocks, **kind):
    """(key, pass) pairs by plain loops, from (key, source, tokens)."""
    draw = lambda *p: hashlib.md5(":".join(map(str, (mixing.SEED, *p))).encode()).hexdigest()
    totals = {}
    for _, s, n in rows:
        totals[s] = totals.get(s, 0) + n
    totals = {s: n for s, n in totals.items() if n}
    whole, out = sum(totals.values()), []
    names = sorted(totals)
    shares = [totals[s] / whole for s in names]
    share = kind.pop("target_entropy_share", None)
    target = share * math.log(len(shares)) if share else None
    w = mixing.weights(shares, mixing.exponent(shares, 1.0, kind.get("max_repeats", 4.0), target))
    for s, x in zip(names, w):
        budget, own = int(x * whole), {}
        for k, t, n in rows:
            if t == s:
                own.setdefault(int(draw(k)[:8], 16) % blocks, []).append((k, n))
        for e in range(budget // totals[s] + 1):
            left = budget % totals[s] if e == budget // totals[s] else totals[s]
            for b in sorted(own, key=lambda b: (draw(e, s, b), b)):
                size = sum(n for _, n in own[b])
                if left <= 0:
                    break
                took = 0
                for k, n in sorted(own[b], key=lambda x: draw(e, x[0])):
                    took += n
                    if took > left:
                        break
                    out.append((k, e))
                left -= size
    return out


@pytest.mark.parametrize("kind", [{}, {"max_repeats": 1.5}, {"target_entropy_share": 0.8}, {"max_repeats": 2.0, "target_entropy_share": 0.99}])
def test_op9_brute_force(spark, kind):
    r = random.Random(4)
    rows = [(k, r.choice(["a"] * 12 + ["b"] * 4 + ["c"]), r.randrange(1, 90)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    got = mixing.mix(df, F.col("tokens"), blocks=16, **kind).select("doc_id", "mix_pass").collect()
    assert sorted(map(tuple, got)) == sorted(brute_mix(rows, 16, **kind))


def test_op9_many_sources(spark, monkeypatch):
    """More sources than the driver takes give the same mix; a slice of one key and a few give the same cut."""
    r = random.Random(6)
    rows = [(k, f"s{int(r.expovariate(0.5))}", r.randrange(1, 90)) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    mixed = lambda: sorted(map(tuple, mixing.mix(df, F.col("tokens"), blocks=8, target_entropy_share=0.9).select("doc_id", "mix_pass").collect()))
    want = mixed()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    monkeypatch.setattr(mixing, "SLICE_DIGITS", 1)
    assert mixed() == want == sorted(brute_mix(rows, 8, target_entropy_share=0.9))


def test_op9_budgets_hold(spark):
    rows = queries.documents(spark, SF1).select("doc_id", "source", queries.estimated_tokens().alias("tokens"))
    mixed = queries.op9_mixing(spark, SF1)
    total = rows.agg(F.sum("tokens")).first()[0]
    most = {r.source: r.m for r in rows.groupBy("source").agg(F.max("tokens").alias("m")).collect()}
    for r in mixed.groupBy("source").agg(F.sum("tokens").alias("n"), F.first("weight").alias("w")).collect():
        assert -1 <= r.w * total - r.n + 2 and r.w * total - r.n <= most[r.source] + 1
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 5


def test_op9_exponent():
    p = [0.7, 0.2, 0.1]
    assert mixing.exponent(p) == 0 and mixing.exponent(p, max_repeats=1.0) == pytest.approx(1.0)
    a = mixing.exponent(p, target_entropy=0.9)
    assert mixing.entropy(mixing.weights(p, a)) == pytest.approx(0.9)
    a = mixing.exponent(p, max_repeats=2.0)
    assert max(w / q for w, q in zip(mixing.weights(p, a), p)) == pytest.approx(2.0)


def test_op9_edges(spark, edge, clash, empty):
    for df in (edge, clash):
        out = mixing.mix(df, queries.estimated_tokens(), blocks=4)
        assert set(df.columns) <= set(out.columns) and {r.mix_source for r in out.collect()} <= {"", "a", "b", "c"}
        counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert counts.get(1, 0) % 2 == 0 and counts.get(10, 0) % 2 == 0  # repeated rows go together
    assert mixing.mix(empty, queries.estimated_tokens()).count() == 0
    assert mixing.mix(edge, F.lit(0)).count() == 0


# --- 10


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return [least[root(i)] for i in range(len(rows))]


def test_op10_rows(spark):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in queries.documents(spark, SF).collect()]
    want = {k: (f"{f:016x}", c) for (k, f), c in zip(docs, brute_components(docs, 4))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize(("distance", "partitions"), [(4, 4), (7, 4), (2, 3), (4, 5), (0, 4), (6, 6), (8, 2), (12, 3), (10, None), (3, 16)])
def test_op10_links_lose_nothing(spark, distance, partitions):
    r, values = random.Random(distance), set()
    for _ in range(5 if distance > 7 else 60):
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 8)):
            values.add(f)
            for _ in range(r.randrange(1, 5)):
                f ^= 1 << r.randrange(64)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "f long")
    got = {(x.a, x.b) for x in simhash.links(df, distance, partitions).collect()}
    few = simhash.links(df, distance, partitions, every=False).cache()
    full = {r.node: r.root for r in simhash.components(simhash.links(df, distance, partitions)).collect()}
    assert {r.node: r.root for r in simhash.components(few).collect()} == full
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if 0 < bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
    assert got == want


@pytest.mark.parametrize("partitions", [0, 1, 17])
def test_op10_refuses_what_it_cannot_part(spark, partitions):
    with pytest.raises(ValueError, match="partitions"):
        simhash.links(spark.range(5).toDF("f"), 4, partitions)


def test_op10_labelled_links(spark):
    r, values = random.Random(3), set()
    for _ in range(40):
        f = r.getrandbits(63)
        values |= {f, f ^ 1 << r.randrange(63), f ^ 5 << r.randrange(60)}
    rows = [(v, k % 25) for k, v in enumerate(sorted(values))]
    got = simhash.links(spark.createDataFrame(rows, "f long, label long"), 5, labelled=True).collect()
    want = {(min(x, y), max(x, y)) for i, (v, x) in enumerate(rows) for w, y in rows[:i] if x != y and (v ^ w).bit_count() <= 5}
    assert sorted(map(tuple, got)) == sorted(want)


def test_op10_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    values = sorted({(7 << 40) ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(16)})
    df = spark.createDataFrame([(v,) for v in values], "f long")
    got = {(x.a, x.b) for x in simhash.links(df, 3).collect()}
    assert got == {(a, b) for i, b in enumerate(values) for a in values[:i] if bin(a ^ b).count("1") <= 3}
    few = simhash.links(df, 3, every=False)
    assert few.count() < len(got) / 4
    assert len({r.root for r in simhash.components(few).collect()}) == 1


def test_op10_allocation_is_the_cheapest():
    r = np.random.RandomState(0)
    costs = [np.concatenate([np.zeros((1, 4)), np.sort(r.rand(5, 4), axis=0)]).astype(np.float32) for _ in range(3)]
    parts = r.randint(0, 4, (50, 3))
    from itertools import product

    for p, got in zip(parts, simhash.allocate(parts, costs, 5)):
        price = lambda u: sum(costs[i][u[i], p[i]] for i in range(3))  # noqa: E731, B023
        assert got.sum() == 5 and price(got) == pytest.approx(min(price(u) for u in product(range(6), repeat=3) if sum(u) == 5))


def test_op10_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_op10_edges(spark, edge, clash, empty):
    for df in (edge, clash):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
        want = sorted((k, c) for (k, _), c in zip(rows, brute_components(rows, 4)))
        got = simhash.near_duplicates(df).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == want
        kept = simhash.one_of_each(df).collect()
        assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want})
    assert simhash.near_duplicates(empty).count() == 0 == simhash.one_of_each(empty).count()
    nulls = edge.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert simhash.near_duplicates(nulls).count() == 12
    assert simhash.one_of_each(nulls).count() == len({c for _, c in want})


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs, counts = queries.documents(spark, SF1), []
    for name, stage in cp.STAGES:
        new = cp.written(stage(spark, docs, SF1), name.replace(" ", "-"))
        counts.append(new.count())
        if name != cp.STAGES[-1][0]:
            assert new.columns == docs.columns
        if name in ("language ID", "quality", "near-dedup"):
            assert new.exceptAll(docs).count() == 0
        if name == "near-dedup":
            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            kept, near, alike = {r.doc_id for r in new.select("doc_id").collect()}, brute_groups(rows, similar.DISTANCE), brute_groups(rows, 64)
            assert kept <= set(near.values()) and set(alike.values()) <= kept
        docs = new
    assert docs.filter("not round_trip").count() == 0
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]
    assert cp.run(spark, SF).count() > 0


def test_pipeline_deletes_what_it_is_done_with(spark):
    import os

    import corpus_pipeline as cp

    from talkloom.llm.common import named_folders, written

    other = written(spark.range(3).toDF("x"), "other")
    before, conf = set(named_folders()), spark.conf.get("spark.checkpoint.dir", None)
    out = cp.run(spark, SF)
    left = set(named_folders()) - before
    assert len(left) == 1 and os.path.isdir(left.pop().removeprefix("file://"))
    assert out.count() > 0 and other.count() == 3
    assert spark.conf.get("spark.checkpoint.dir", None) == conf


def test_pipeline_edges(spark, edge, clash, empty):
    import corpus_pipeline as cp

    for df in (edge, clash, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SF)
            n = out.count()
            assert n == 0 if df is empty else n > 0, name
            if name != cp.STAGES[-1][0]:
                assert out.columns == df.columns
