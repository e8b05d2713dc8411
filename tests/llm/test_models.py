"""Operators 5 and 6: held-out accuracy, brute force and edge cases."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from talkloom.llm import lang_id, quality, queries
from talkloom.llm.common import byte_view

from ..oracle import SF

SF1 = SF.replace("sf0.001", "sf0.01")


def naive_bits(samples, text, order):
    """Code length under the escape rule, from dictionaries."""
    counts = {}
    for s in samples:
        b = bytes(order) + s
        for i in range(order, len(b)):
            for k in range(order + 1):
                c = counts.setdefault((k, b[i - k:i]), {})
                c[b[i]] = c.get(b[i], 0) + 1
    bits, b = 0, bytes(order) + text
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get((k, b[i - k:i]))
            if c is None:
                continue
            t = sum(c.values()) + len(c)
            if b[i] in c:
                bits += round(-math.log2(c[b[i]] / t) * lang_id.FIXED)
                break
            bits += round(-math.log2(len(c) / t) * lang_id.FIXED)
        else:
            bits += 8 * lang_id.FIXED
    return bits


def test_code_lengths_equal_brute_force():
    samples = {"a": [b"abracadabra", b"a banana"], "b": [b"hello there", b"there is"]}
    trees = lang_id.ContextTrees.train(samples, 3)
    texts = [b"", b"a", b"abra", b"here", b"zz\xff", b"banana there hello " * 50]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = lang_id.Scorer(trees).lengths(raw, offsets)
    for t, row in zip(texts, got):
        assert row.tolist() == [naive_bits(samples[k], t, 3) for k in trees.langs]


def test_chunks_do_not_matter(monkeypatch):
    trees = lang_id.ContextTrees.train({"a": [b"some words here"], "b": [b"quelques mots"]}, 4)
    texts = [b"words and mots " * 9, b"", b"x", b"here some " * 7]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = lang_id.Scorer(trees).lengths(raw, offsets)
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(lang_id, "CHUNK", size)
        assert (lang_id.Scorer(trees).lengths(raw, offsets) == whole).all()


def test_op6_held_out(spark):
    truth = {r.doc_id: r.lang for r in queries.documents(spark, SF1).collect()}
    rows = queries.op6_language(spark, SF1).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_op6_rows_by_brute_force(spark, tmp_path):
    """The query's rows on a small table: which rows are learned from, every language and score."""
    r, rows = random.Random(5), []
    words = {"en": "the of and with house green small river".split(), "fr": "le la et avec maison verte petite une".split(), "x": "zu ka mi ro".split()}
    for i in range(300):
        lang = r.choice(["en", "fr", "x", None])
        text = " ".join(r.choice(words[lang or "en"]) for _ in range(r.randrange(0, 25)))
        rows.append((i, r.choice([text, text, text, f"{text} 12!", None, "123", ""]) if i % 5 == 0 else text, lang, "s", 0))
    rows += [(None, "the house and the river", "en", "s", 0), (None, "une maison verte", "fr", "s", 0), rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learned = {}
    for i, text, lang, *_ in set(rows):
        if lang and text and not held(i):
            learned.setdefault(lang, []).append(text.encode())
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in queries.op6_language(spark, str(tmp_path)).collect()]
    want = []
    for i, text, *_ in rows:
        if not text or not any(c.isalpha() for c in text):
            want.append((i, held(i), "und", 0.0))
            continue
        bits = {k: naive_bits(v, text.encode(), lang_id.ORDER) / lang_id.FIXED for k, v in sorted(learned.items())}
        best = min(bits, key=lambda k: (bits[k], k))
        want.append((i, held(i), best, round(1 / sum(2 ** -(b - bits[best]) for b in bits.values()), 9)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op6_learns_from_long_texts(spark):
    rows = [(i, "une maison verte et petite " * 4000, "fr") for i in range(5)] + [(9 + i, "a small green house ", "en") for i in range(5)]
    trees = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.langs == ["en", "fr"]


def test_op6_sample_is_bounded(spark):
    rows = [(None, f"text number {i} of one key", "en") for i in range(900)] + [(1, "again and again", "en")] * 500 + [(i, f"mot {i}", "fr") for i in range(30)] + [(2, "long " * 5000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.sampled(df, "text", "lang", "doc_id", 50, 100).collect()
    count = {k: sum(r.lang == k for r in got) for k in ("en", "fr", "de")}
    assert count == {"en": 50, "fr": 30, "de": 1} and all(len(r.piece) <= 100 for r in got) and sum(r.piece == "again and again" for r in got) <= 1


def test_op6_edges(spark, edge, clash, empty):
    trees = lang_id.train(edge)
    assert trees.langs == ["en", "fr"]
    for df in (edge, clash):
        rows = lang_id.predict(df, trees, keep=["doc_id", "text"]).collect()
        assert len(rows) == 12
        for r in rows:
            if r.text is None or not any(c.isalpha() for c in r.text):
                assert (r.lang_pred, r.score, r.bits_per_byte) == ("und", 0.0, None)
            else:
                assert r.lang_pred in trees.langs and 0 < r.score <= 1
        assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 7)}) == 1
    assert lang_id.predict(empty, trees).count() == 0
    none = lang_id.train(empty)
    assert {r.lang_pred for r in lang_id.predict(edge, none).collect()} == {"und"}


def test_features_do_not_depend_on_neighbours():
    texts = ["Some words, some marks!! LOUD loud", "", "  ", "again again", "é ß tail"]
    def own(ts):
        d, b = quality.features(*byte_view(pa.array(ts, pa.large_string())))
        return [sorted(b[d == i].tolist()) for i in range(len(ts))]
    assert own(texts) == [own([t])[0] for t in texts]
    assert own(["Scum word"])[0] != own(["word"])[0]


def test_features_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choice(["go go ", "no ", "NO! ", "x" * 9, "  ", "é-é ", "word " * 3, "u" * 40 + " "]) for _ in range(r.randrange(60))) for _ in range(40)] + ["a" * 300, " " * 200, "b " + " " * 90 + "b", "y" * 64 + " " + "y" * 64]
    monkeypatch.setattr(quality, "MAX_WORD", 16)
    whole = quality.features(*byte_view(pa.array(texts, pa.large_string())))
    want = sorted(zip(*(x.tolist() for x in whole)))
    for piece in (16, 32, 64, 256):
        monkeypatch.setattr(quality, "PIECE", piece)
        got = quality.features(*byte_view(pa.array(texts, pa.large_string())))
        assert sorted(zip(*(x.tolist() for x in got))) == want, piece


def test_op5_sample(spark):
    """Long texts are learned from, one key can't fill the sample, equal rows count once."""
    docs = spark.createDataFrame([*[(i, "good words " * 9000) for i in range(5, 9)], *[(i, "bad stuff " * 9000) for i in range(10, 14)], *[(3, f"many texts {i}") for i in range(300)], *[(4, "one")] * 300], "doc_id long, text string")
    ratings = spark.createDataFrame([*[(i, 2) for i in range(5, 9)], *[(i, 0) for i in range(10, 14)], *[(3, 2), (4, 0), (4, 0)] * 3], "doc_id long, grade int")
    model = quality.train(docs, ratings, 3)
    found = {r.text[:3]: r.expected_grade for r in quality.predict(docs.filter("doc_id > 4"), model).collect()}
    assert found["goo"] > 1 > found["bad"]


def test_op5_rows_by_brute_force(spark):
    """The query's rows: the model's weights applied by plain loops to whole texts."""
    docs, labels = queries.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, queries.ratings(labels).filter(~queries.held_out()), queries.GRADES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op5_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        _, index = quality.features(*byte_view(pa.array([texts[r.doc_id]], pa.large_string())))
        s = sum(round(float(model.weights[i]) * 2**20) for i in index.tolist()) / 2**20
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert (r.expected_grade, r.p_good) == (pytest.approx(sum(tails), abs=2e-6), pytest.approx(tails[1], abs=2e-6))
        chance = [1 - tails[0], tails[0] - tails[1], tails[1]]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and chance[r.grade] == max(chance)
        assert r.selected == (r.p_good >= queries.SELECT_AT) or abs(r.p_good - queries.SELECT_AT) < 1e-6


def test_gradient_reaches_the_optimum():
    r = np.random.RandomState(0)
    rows = [np.unique(r.randint(0, 30, 6)) for _ in range(600)]
    s = np.array([(x < 10).sum() - (x > 20).sum() for x in rows])
    grades = np.digitize(s + r.logistic(size=600) * 0.3, [-1, 1])
    m = quality.fit(rows, grades, 3, steps=300, decay=1e-3)
    assert m.thresholds[0] < m.thresholds[1]
    score = np.array([m.weights[x].sum() for x in rows])
    assert np.corrcoef(score, s)[0, 1] > 0.95

    def loss(w, t):
        c = np.concatenate([np.ones((600, 1)), quality.Ordinal(w, t).tails(np.array([w[x].sum() for x in rows])), np.zeros((600, 1))], axis=1)
        return -np.log(c[np.arange(600), grades] - c[np.arange(600), grades + 1]).mean() + 0.5e-3 * (w**2).sum()

    best = loss(m.weights.astype(float), m.thresholds)
    for _ in range(20):
        w = m.weights.astype(float).copy()
        w[:30] += r.normal(size=30) * 0.05
        assert loss(w, m.thresholds + r.normal(size=2) * 0.03) > best - 1e-3


def test_op5_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    rated = {r.doc_id: r.grade for r in queries.ratings(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = queries.op5_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in rated]
    of = {g: [r for r in held if rated[r.doc_id] == g] for g in range(3)}
    assert np.mean([r.selected for r in of[2]]) > 0.95  # good ones stay
    assert np.mean([not r.selected for r in of[1]]) > 0.75 and np.mean([not r.selected for r in of[0]]) > 0.65
    assert np.mean([r.expected_grade for r in of[0]]) < np.mean([r.expected_grade for r in of[2]])


def test_op5_edges(spark, edge, clash, empty):
    ratings = spark.createDataFrame([(1, 2), (5, 0), (6, 1), (10, 2), (10, 2), (None, 1), (4, None), (99, 1)], "doc_id long, grade int")
    model = quality.train(edge, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    for df in (edge, clash):
        rows = quality.predict(df, model, keep=["doc_id", "text"]).collect()
        assert len(rows) == 12
        assert all(0 <= r.expected_grade <= 2 and r.tails[0] >= r.tails[1] and r.grade in (0, 1, 2) for r in rows)
        assert len({r.expected_grade for r in rows if not (r.text or "").strip()}) == 1
        assert len({r.expected_grade for r in rows if r.doc_id in (1, 7)}) == 1
    assert quality.predict(empty, model).count() == 0
    none = quality.train(empty, ratings.limit(0), 3)
    assert [round(x, 6) for x in quality.predict(edge, none).first().tails] == [round(2 / 3, 6), round(1 / 3, 6)]


@pytest.mark.parametrize("order", [1, 2, 5])
def test_train_on_nothing_but_empty_texts(order):
    trees = lang_id.ContextTrees.train({"a": [b""], "b": [b"xy"]}, order)
    raw = np.frombuffer(b"xy", np.uint8)
    assert (lang_id.Scorer(trees).lengths(raw, np.array([0, 2]))[0] > 0).all()
