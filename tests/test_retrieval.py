from difflib import SequenceMatcher

from talkloom.plans import relational


def test_fuzzy_ratio_of_whole_texts(spark, tmp_path):
    asked = "that and the thing in there"
    texts = [(1, "short THAT"), (2, "x" * 250 + " That and the thing in there"), (3, "The thing in there and that. " * 40), (4, "")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.ratio for r in relational.queries()["fn32_fuzzy_ratio"](spark, str(tmp_path)).collect()}
    assert got == {k: round(SequenceMatcher(None, asked, t.lower()).ratio(), 6) for k, t in texts}
