import hashlib

from pyspark.sql import functions as F

from talkloom.functions import runs, vectors
from talkloom.functions import text as fx
from talkloom.operators import conversation, retrieval, selection, stats, tables
from talkloom.registry import Parameter, Registry, Tool


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hashed_bag_equals_hashlib(spark):
    toks = ["scene", "act", "act", "été"]
    want = [0.0] * 48
    for t in toks:
        h = hashlib.sha256(t.encode()).hexdigest()
        want[int(h[:8], 16) % 48] += 1 if int(h[8], 16) % 2 else -1
    norm = sum(x * x for x in want) ** 0.5
    got = one(spark, vectors.hashed_bag(F.array(*[F.lit(t) for t in toks])))
    assert got == [round(x / norm, 6) for x in want]
    assert one(spark, vectors.hashed_bag(F.array().cast("array<string>"))) == [0.0] * 48


def test_cosine_sentinels(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, a)) == 1.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == -1.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(1.0)))) == -1.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)), 0.0, False)) == 0.0
    assert one(spark, vectors.read_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] == one(spark, vectors.read_vector(F.lit("1, 2.5")))


def test_runs_and_romanisation():
    assert runs.split_runs("hello నేను, ok") == [("hello", "en"), ("నేను,", "te"), ("ok", "en")]
    assert runs.split_runs("") == [] and runs.romanize("abc") == "abc"
    assert runs.romanize("నేను") == "nEnu" and runs.romanize("అమ్మ") == "amma"
    assert not any(runs.LOW <= c <= runs.HIGH for c in runs.romanize("తెలుగు లో మాట్లాడు"))


def test_nearest_rank(spark):
    df = spark.range(20).select(F.col("id").alias("v"))
    assert {r.p: r.value for r in stats.nearest_rank(df, "v", [0.95, 0.5]).collect()} == {0.95: 19, 0.5: 10}


def test_lowest_is_exact(spark):
    df = spark.range(500).select("id", selection.drawn(F.col("id")).alias("h")).cache()
    for n in (0, 1, 77, 499, 600):
        got = [r.id for r in selection.lowest(df, F.lit(n), "h", "id").orderBy("h").collect()]
        assert got == [r.id for r in df.orderBy("h").limit(n).collect()]


def test_between():
    assert tables.between(1.0, 2.0) == 1.5 and tables.between(3.0, None) == 4.0 and tables.between(None, 1.0) == 0.0 and tables.between(1.0, None, next_=2.0) == 1.5
    try:
        tables.between(2.0, 1.0)
        raise AssertionError
    except ValueError:
        pass


def test_contexts(spark):
    rows = [("s", 1, "hello", None), ("s", 2, "switch to kitchen", None), ("s", 3, "more", None), ("s", 4, "x", "My Office"), ("s", 5, "recipe cook ingredient oven", None)]
    df = spark.createDataFrame(rows, "session string, n int, m string, loc string")
    got = [(r.context, r.confidence) for r in conversation.detect_contexts(df, "session", "n", "m", "loc").orderBy("n").collect()]
    assert got == [("writers_room", 0.5), ("kitchen", 1.0), ("kitchen", 0.6), ("writers_room", 0.9), ("kitchen", 1.0)]


def test_overlap_score(spark):
    got = one(spark, retrieval.overlap_score(F.lit("Alpha beta gamma"), F.lit("alpha GAMMA tag"), F.array(F.lit("Tag"))))
    assert got == 2.5


def test_small_text_rules(spark):
    assert one(spark, fx.word_count(F.lit("  a b "))) == 2 and one(spark, fx.word_count(F.lit(""))) == 0
    assert one(spark, fx.tokens_by_words(F.lit("a b c"))) == 3 and one(spark, fx.tokens_by_words(F.lit("నేను b c"))) == 4
    assert one(spark, fx.repeats_word(F.lit("go go go now"))) and not one(spark, fx.repeats_word(F.lit("go go go")))
    assert one(spark, fx.cut_at_stop(F.lit("abXcdY"), ["Y", "X"])) == "abXcd"
    p = one(spark, fx.lang_profile(F.lit("నేను బాగా hello")))
    assert p.lang == "mixed" and p.has_script and p.script_ratio == 0.444 and p.english_ratio == 0.556
    assert one(spark, fx.lang_profile(F.lit("నేను hello"))).lang == "en"  # marks aren't letters: 2 of 7
    p = one(spark, fx.lang_profile(F.lit("nenu ledu enti")))
    assert p.lang == "te" and p.has_romanized and not p.has_script
    assert one(spark, fx.lang_profile(F.lit("  "))).confidence == 0.0


def test_registry():
    r = Registry()
    r.register(Tool("f", lambda n: n + 1, "math", {"n": Parameter(int, True, 0, 10)}))
    assert r.execute("f", n=1).data == 2 and not r.execute("f", n=11).success and not r.execute("f").success
    assert "Unknown tool" in r.execute("g").error and [t.name for t in r.tools("math")] == ["f"] and r.tools("x") == []
