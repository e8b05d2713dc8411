"""Rules with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from talkloom.functions import text as fx
from talkloom.functions import vectors
from talkloom.operators import conversation, curation, quality, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CALLS = "array<struct<name:string,arguments:string>>"


def test_tools_are_flattened(spark):
    rows = [
        ("user", "hi", None, None), ("assistant", "Looking. ", None, [("search", '{"q": "x"}'), (None, None)]), ("assistant", None, None, [("link", "{}")]), ("assistant", "done", None, []),
        ("tool", " found ", "search", None), ("tool", None, None, None), ("system", None, None, None),
    ]
    df = spark.createDataFrame([(rows,)], f"m array<struct<role:string,content:string,name:string,tool_calls:{CALLS}>>")
    got = df.select(conversation.flatten_tools(F.col("m")).alias("m")).first().m
    assert [tuple(x) for x in got] == [
        ("user", "hi"), ("assistant", 'Looking. \n<tool_call name="search">{"q": "x"}</tool_call>\n<tool_call name="tool">{}</tool_call>'), ("assistant", '<tool_call name="link">{}</tool_call>'), ("assistant", "done"),
        ("user", "[tool:search]  found"), ("user", "[tool:tool]"), ("system", ""),
    ]
    names = df.select(conversation.first_tool_calls(F.col("m")).alias("n")).first().n
    assert names == ["search", "unknown"]


@pytest.mark.parametrize(
    ("said", "context", "score"),
    [("the scene", "writers_room", 2 / 3.9), ("rescenes", "writers_room", 1 / 3.9), ("cook a recipe", "kitchen", 4 / 4.5), ("Camera, frame, shot!", "storyboard", 1.0), ("nothing", None, None), ("factor", "writers_room", 1 / 3.9)],
)
def test_keyword_scores(spark, said, context, score):
    best = one(spark, conversation.best_keyword(F.lit(said)))
    assert (best and best.context) == context and (score is None or best.score == pytest.approx(score))


@pytest.mark.parametrize(
    ("said", "asks", "mixes"),
    [
        ("Plan my film", True, False), ("Plan: genre, tone, audience, budget", False, False), ("plan the hero's place in time", True, False), ("Need only discovery", True, False), ("first step of the outline", False, False),
        ("outline for the first act", True, False), ("give me next beats", False, False), ("A pitch", True, False), ("I need your default pitch", False, False), ("hello", False, False), ("plan in telugu", False, False),
        ("తెలుగు", False, False), ("English lo cheppu", False, True), ("english and Telugu", False, True), ("remix", False, True),
    ],
)
def test_intents(spark, said, asks, mixes):
    assert tuple(one(spark, conversation.intent(F.lit(said)))) == (asks, mixes)


@pytest.mark.parametrize(("said", "plan"), [("Plan my film", ("en", "Boss,", True)), ("plan in Telugu", ("te", "బాస్,", False)), ("mix a plan", ("mixed", "బాస్,", False)), ("తెలుగు", ("te", "బాస్,", False))])
def test_reply_plans(spark, said, plan):
    assert tuple(one(spark, conversation.reply_plan(F.lit(said)))) == plan


def test_snippet_lines(spark):
    body = "• Boss, keep it, short \n\n -- \n- two\nబాస్, three\n4\n5"
    assert one(spark, conversation.snippet_lines(F.lit(body))) == ["keep it, short", "two", "three", "4"]


def test_placeholders_need_generation(spark):
    rows = [([("assistant", "Summary: ...")], True), ([("assistant", " \n")], True), ([("user", "x")], True), ([("assistant", "Examples: none")], True), ([("assistant", "..."), ("assistant", "real")], False), ([("assistant", None)], True)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>, want boolean")
    assert df.filter(quality.needs_generation(F.col("m")) != F.col("want")).count() == 0


def test_words_that_are_flagged(spark):
    said = F.array(*[F.lit(x) for x in ("Shit happens", "bullshit", "what a DOUCHE!", "damn it")])
    assert one(spark, F.transform(said, lambda x: fx.has_profanity(x))) == [True, False, True, False]


def test_decisions(spark):
    lit = lambda x: F.lit(x).cast("string")
    ask = lambda *a: one(spark, fx.decision_question(*map(lit, a)))
    assert ask("production", "The Fee doubled.", "pay") == "Boss, the fee doubled. What should we do?"
    assert ask("kitchen", "Oven broke.", "fry") == "Boss, oven broke. How do I handle this?"
    assert ask("x", "Rain.", "wait") == "Boss, rain. Your take?" and ask("film", "", "wait") is None and ask("film", "Rain.", None) is None
    answer = lambda *a: one(spark, fx.decision_answer(*map(lit, a)))
    assert answer("Rain.", "wait", "it ends") == "wait. it ends" and answer("Rain.", "wait", "") == "wait" and answer("Rain.", "", "why") is None


def test_prompts(spark):
    lit = lambda x: F.lit(x).cast("string")
    two = one(spark, fx.prompts("principle", principle=lit(" 3. Keep it short ")))
    assert [x.question for x in two] == ["Explain this principle in your voice and give a grounded example: Keep it short", "Given the principle 'Keep it short', how would you advise a junior AD facing a tough call on set?"]
    assert [(x.answer, x.domain, x.task) for x in two] == [("Take: ...\nExample: ...", "persona", "principle_explain"), ("First, guard the core beat; then...", "production", "principle_to_decision")]
    assert one(spark, fx.prompts("word", word=lit("wry"), definition=lit("  "))) == [] == one(spark, fx.prompts("scene", text=lit(None)))
    two = one(spark, fx.prompts("decision", situation=lit("Rain."), choice=lit("wait"), rationale=lit(None), heuristics=F.array(lit("a"), lit("b")), domain=lit(None)))
    assert [tuple(x) for x in two] == [
        ("Scenario: Rain.\nPick and justify your choice briefly.", "Choice: wait\nWhy: ", "general", "decision_playback"),
        ("Scenario (same): Rain.\nList the heuristics and risks you weighed.", "Heuristics: a, b\nRisks: ...", "general", "decision_heuristics"),
    ]


def test_hashed_bag_takes_every_word(spark):
    long = "a " * 5000 + "b"
    import hashlib

    h = hashlib.sha256(b"a").hexdigest()
    got = one(spark, vectors.hashed_bag(fx.words(F.lower(F.lit(long)))))
    assert abs(got[int(h[:8], 16) % 48]) == 1.0 and sum(x != 0 for x in got) == 2


def test_words_left_in_latin_letters(spark):
    text = "nenu going HTTPS Boss ABCDE ABCD {NAME} a_b don't x] café"
    found = one(spark, F.transform(curation.roman_words(F.lit(text)), lambda x: F.struct(x["word"].alias("w"), curation.stays_roman(x).alias("s"))))
    assert [x.w for x in found if not x.s] == ["nenu", "going", "ABCD", "don't", "caf"]
    assert one(spark, curation.roman_words(F.lit(""))) == []


@pytest.mark.parametrize(
    ("n", "p95", "p99", "want"),
    [(500, 100, 200, ("ml.g5.2xlarge", 1536, 1, 8, 5, 310)), (600, 1024, 2048, ("ml.g5.2xlarge", 2048, 1, 64, 5, 45)), (1200, 2000, 2049, ("ml.g5.12xlarge", 3072, 2, 64, 2, 18)), (1000, 1100, 1200, ("ml.g5.2xlarge", 2048, 1, 64, 5, 75))],
)
def test_training_advice(spark, n, p95, p99, want):
    got = one(spark, quality.training_advice(F.lit(n), F.lit(p95), F.lit(p99)))
    assert tuple(got)[:6] == want
    assert got.cost == pytest.approx((9.0 if "12x" in want[0] else 1.5) * want[5] * 1.5 / 3600)


def test_rule_metrics(spark):
    rule = lambda text, lang, asks, most=None, start=None: tuple(one(spark, quality.rule_metrics(F.lit(text), F.lit(lang), F.lit(asks), most and F.lit(most), start and F.lit(start))))
    assert rule("Boss, why?\n\nGo", "en", True, 2, "Boss, ") == (True, True, True, True, True)
    assert rule("Boss, why?\n\nGo", "mixed", False, 1, "Hi") == (False, False, False, False, False)
    assert rule("నేను ok", "mixed", None) == (True, True, True, True, True)


def test_gaps(spark):
    topics = spark.createDataFrame([("film",)] * 30 + [("tag:film",)] * 20 + [("tag:planning",)] * 49 + [("other",)] * 99, "topic string")
    got = {r.gap: r.value for r in stats.gaps(topics, spark.createDataFrame([("te",)] * 29 + [("en",)] * 71, "lang string"), "te").collect()}
    assert got == {"production": 0, "persona": 0, "decision-making": 0, "technical": 0, "creative": 0, "planning": 49, "lang:te": pytest.approx(29)}
    assert "lang:te" not in {r.gap for r in stats.gaps(topics, spark.createDataFrame([("te",)], "lang string"), "te").collect()}


def test_gates_and_what_a_miss_means(spark):
    row = spark.createDataFrame([(5, 10.0, 3)], "a long, b double, c long")
    checks = (("a", 1, 5, "fail"), ("b", None, 10, "fail"), ("c", 4, None, "warn"))
    assert [r.status for r in quality.gates(row, checks, below=("b",)).collect()] == ["pass", "fail", "warn"]


def test_repeats(spark):
    said = F.array(*[F.lit(x) for x in ("go Go go", "x go Go go", "a b a b a b", "", "la la x la")])
    assert one(spark, F.transform(said, lambda x: fx.repeats_word(x))) == [False, True, False, False, False]
