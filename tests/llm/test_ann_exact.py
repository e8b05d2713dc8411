"""Cells, probes and the measured reach of the additive quantiser."""

import numpy as np

from talkloom.llm import ann

from .test_relations import recall


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def test_op4_without_structure(spark):
    x = np.random.RandomState(5).normal(size=(3000, 32)).astype(np.float32)
    assert recall(spark, frame(spark, x), candidates=21) >= 0.9


def test_op4_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODE_BLOCK", 500)
    monkeypatch.setattr(ann, "SPLIT", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    x = np.random.RandomState(6).normal(size=(2000, 16)).astype(np.float32)
    assert recall(spark, frame(spark, x), candidates=21) >= 0.9
    assert recall(spark, frame(spark, x), candidates=21, target=1.0) >= 0.98


def test_op4_probes_few_cells_of_clustered_vectors(spark):
    r, reaches = np.random.RandomState(7), []
    for n in (2000, 8000):
        centres = r.normal(size=(n // 40, 24))
        x = (centres[np.arange(n) % len(centres)] + 0.1 * r.normal(size=(n, 24))).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = frame(spark, x)
        index = ann.build(df, 20)
        asked = index.rows.filter("vec_id % 20 = 0").join(index.entries.select("rep", "vector"), "vector").selectExpr("rep as q", "vector")
        reaches.append(ann.reach_of(index, asked, 20, ann.TARGET))
        assert recall(spark, df) >= 0.9
    assert reaches[0] < 2000 / 2 and reaches[1] < 8000 / 5


def test_cells_hold_every_vector_once(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPLIT", 10)
    x = np.random.RandomState(8).normal(size=(1500, 8)).astype(np.float32)
    index = ann.build(frame(spark, x), 5)
    codes = np.array([np.frombuffer(r.codes, np.uint8) for r in index.entries.collect()])
    own = index.cells.of(codes)
    assert np.bincount(own, minlength=len(index.cells.low)).tolist() == index.cells.size.tolist()
    assert index.cells.size.sum() == 1500 and (np.diff(index.cells.low) > 0).all() and set(index.cells.depth.tolist()) > {1}
    assert (np.diff(index.cells.block) >= 0).all()


def test_op4_doubles_keep_their_precision(spark):
    x = np.random.RandomState(9).normal(size=(60, 4))
    x[7] *= 1e60
    df = frame(spark, x, "double")
    index = ann.build(df, 5)
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(index, index.rows.filter("vec_id % 20 = 0"), 5).collect()}
    assert len(got) == 15 and all(abs(s - float((x[a] * x[b]).sum())) <= 1e-12 * abs(s) for (a, b), s in got.items())
    for q in (0, 20, 40):
        assert (7 in {b for a, b in got if a == q}) == (float((x[q] * x[7]).sum()) > 0)


def test_op4_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.1])], "vec_id long, embedding array<float>")
    index = ann.build(df, 2)
    got = ann.search(index, index.rows.filter("vec_id % 20 = 0"), 2).collect()
    assert {r.query_id for r in got} == {0} and {r.vec_id for r in got} <= {1, 2}
