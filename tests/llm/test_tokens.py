"""Operators 2, 3 and 8 against the libraries themselves."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkloom.llm import bpe, queries, token_counts, token_files
from talkloom.llm.pretokens import finder

from ..oracle import SF

RANKS, BYTE, WORD = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = ["a", "b ", "  ", " \n", "\n", "\t ", " x", " 1", "'s", "é", "<|endoftext|>", "\x1c", " \x85", "漢", "\xa0 ", "!!", " ", "%", "'LL", "ª", "²", "×", "ing", "tion"]


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE.load(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def random_texts(n=3000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(30))) for _ in range(n)]


def test_queue_merges_as_sorting_does(own):
    """Ids of single pre-tokens against merging the leftmost pair of lowest rank, over and over; the queue is left empty."""
    r = random.Random(2)
    for _ in range(400):
        piece = bytes(r.choice(b"etaonirs the.") for _ in range(r.randrange(1, 60)))
        ids = [own.byte[b] for b in piece]
        while pairs := [(own.pair[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in own.pair]:
            rank, i = min(pairs)
            ids[i:i + 2] = [rank]
        assert own.encode_piece(piece) == ids and not own.queue.buckets and not any(own.queue.leaves)


def test_bpe_equals_library(own, library):
    r = random.Random(3)
    texts = [*random_texts(), "aab" * 20_000, "".join(r.choice("ethinonre") for _ in range(5000)), "a" * 4097, ""]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_latin_pattern_equals_full_one():
    import regex

    full, quick = regex.compile(P.PATTERN).findall, finder(P.PATTERN)
    for c in range(0x260):
        t = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 .{chr(c)}. {chr(c)}"
        assert quick(t) == full(t), c


def test_op2_rows(spark, library):
    docs = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    rows = queries.op2_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_op2_edges(edge, clash, empty, library):
    for df in (edge, clash):
        rows = bpe.decode(bpe.encode(df, RANKS, P.PATTERN, keep=["doc_id", "text"]), RANKS).collect()
        both = bpe.encode_and_decode(df, RANKS, P.PATTERN, keep=["doc_id", "text"]).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, both)) and len(rows) == 12
        for r in rows:
            assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_and_decode(empty, RANKS, P.PATTERN).count() == 0


def test_decode_refuses_unknown_ids(spark):
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([60_000]), RANKS)


def test_op3_rows(spark, edge, clash, empty):
    t = Tokenizer.from_file(WORD)
    docs = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(t.encode(docs[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 2048)
    for df in (edge, clash):
        texts = {r.doc_id: r.text for r in df.collect()}
        rows = token_counts.token_counts(df, WORD, keep=["doc_id"]).collect()
        assert len(rows) == 12
        for r in rows:
            assert r.n_tokens == len(t.encode(texts[r.doc_id] or "", add_special_tokens=False))
    assert token_counts.token_counts(empty, WORD).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(name):
    c, texts = token_counts.Counter(P.path(name)), random_texts(800, 4)
    if name.endswith("json"):
        t = Tokenizer.from_file(P.path(name))
        want = [len(t.encode(x, add_special_tokens=False)) for x in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts, num_threads=1)]
    assert c.count(texts) == want == c.count(texts)


@pytest.mark.parametrize("token", [{"content": "<two words>"}, {"content": "<strip>", "lstrip": True}, {"content": "<strip>", "rstrip": True}, {"content": "plain"}])
def test_added_tokens_decide_on_cutting(token, tmp_path):
    form = json.load(open(WORD))
    new = {"id": 60_000, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} | token
    form["added_tokens"].append(new)
    path = str(tmp_path / "own.json")
    json.dump(form, open(path, "w"))
    t, c = Tokenizer.from_file(path), token_counts.Counter(path)
    texts = [f"a {token['content']} b", f"one{token['content']}two  x", f"{token['content']}\n {token['content']}", "none here"]
    assert c.split == (token["content"] == "plain")
    assert c.count(texts) == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_other_forms_are_not_cut():
    form = json.load(open(WORD))
    assert token_counts.splits_at_space(form)
    for change in ({"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Metaspace"}}, {"normalizer": {"type": "Replace", "pattern": {"String": " "}, "content": "_"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Prepend", "prepend": "x"}]}}):
        assert not token_counts.splits_at_space(form | change)
    assert not token_counts.splits_at_space(json.load(open(BYTE)))


def test_balanced_keeps_all():
    chunks = ["x" * k for k in range(200)]
    parts = list(token_counts.balanced(chunks, 1000))
    assert sum(parts, []) == chunks and all(sum(map(len, p)) < 1500 for p in parts)
    assert all(sum(len(c.encode()) for c in p) < 1500 for p in token_counts.balanced(["漢" * k for k in range(60)], 1000))


def test_op8_rows(spark):
    t, start = Tokenizer.from_file(BYTE), 0
    rows = {r.doc_id: r for r in queries.op8_token_files(spark, SF).collect()}
    for d in sorted(queries.documents(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_equals_library():
    t, e, texts = Tokenizer.from_file(BYTE), token_files.Encoder(BYTE, P.PATTERN), random_texts(2000, 5)
    for _ in range(2):
        for x, y in zip(texts, e.encode(texts)):
            assert np.frombuffer(y, e.dtype).tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 300])
def test_buckets(spark, n):
    bounds = sorted(random.Random(n).sample(range(-500, 1500), n))
    for r in spark.range(-600, 1600, 7).select("id", token_files.bucket_of(F.col("id"), [float(b) for b in bounds]).alias("b")).collect():
        assert r.b == sum(b < r.id for b in bounds)


def test_op8_edges(spark, edge, clash, empty, tmp_path):
    t = Tokenizer.from_file(BYTE)
    for k, df in enumerate((edge.repartition(3), clash)):
        folder = f"file://{tmp_path}/{k}"
        token_files.write_token_files(df, folder, BYTE, P.PATTERN)
        rows = token_files.read_token_files(spark, folder).orderBy("start").collect()
        want = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))
        assert [r.key for r in rows] == [k for k, _ in want]
        for r, (_, text) in zip(rows, want):
            assert np.frombuffer(r.ids, "<u4").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    token_files.write_token_files(empty, f"file://{tmp_path}/e", BYTE, P.PATTERN)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0
    nulls = edge.withColumn("doc_id", F.when(F.col("doc_id") > 8, F.col("doc_id"))).repartition(5)
    token_files.write_token_files(nulls, f"file://{tmp_path}/n", BYTE, P.PATTERN)
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/n").orderBy("start").collect()
    assert [r.key for r in rows] == [None] * 9 + [9, 10, 10]
    texts = lambda found: sorted(np.frombuffer(x, "<u4").tolist() for x in found)
    assert texts(r.ids for r in rows) == sorted([*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in nulls.collect())


def test_op8_hot_keys_are_dealt_out(spark, tmp_path):
    rows = [(7, "the same text")] * 400 + [(7, f"text {i}") for i in range(200)] + [(i, f"own {i} " * (i % 50)) for i in range(-100, 300)] + [(None, "no key")] * 100 + [(1000, "long text " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    bases = token_files.write_token_files(df, f"file://{tmp_path}", BYTE, P.PATTERN)
    found = token_files.read_token_files(spark, f"file://{tmp_path}").orderBy("start").collect()
    want = sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r.key for r in found] == want and [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    t = Tokenizer.from_file(BYTE)
    ids = {text: [*t.encode(text, add_special_tokens=False).ids, 0] for text in {x for _, x in rows}}
    assert sorted((r.key or -999, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == sorted((k or -999, ids[x]) for k, x in rows)
    sizes = sorted(b["ids"] for b in bases)
    assert len(bases) > 8 and sizes[-2] < 3 * sum(sizes) / len(sizes)


def test_op8_deal():
    first, split, n = token_files.deal([(10, False), (10, False), (120, True), (0, False), (30, False), (200, False), (5, False)], 5)
    assert (first, split, n) == ([0, 0, 1, 3, 3, 4, 5], [1, 1, 2, 1, 1, 1, 1], 6)


def test_op8_ranges_of_a_remote_folder(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    df = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(50)], "doc_id long, text string")
    token_files.write_token_files(df, f"file://{tmp_path}", BYTE, P.PATTERN)
    near = token_files.open_part(f"file://{tmp_path}", 0, 2)
    monkeypatch.setattr(token_files, "open_folder", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), str(tmp_path)))
    far = token_files.open_part(f"file://{tmp_path}", 0, 2)
    for lo, hi in ((0, 0), (0, 9), (5, 60)):
        assert near[0](lo, hi).tolist() == far[0](lo, hi).tolist()
    assert near[1].tolist() == far[1].tolist() and near[2].tolist() == far[2].tolist()
