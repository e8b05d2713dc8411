import json

from pyspark.sql import functions as F

from talkloom import config
from talkloom.memory import MemoryStore
from talkloom.plans import curation
from talkloom.sources import io

from .test_pairing import CHAT


def test_chat_to_curated_examples(spark, tmp_path):
    files = spark.createDataFrame([("c", CHAT)], "chat string, text string")
    ex = curation.chat_examples(files, ["owner"]).cache()
    rows = ex.orderBy("reply_ts").collect()
    assert [r.output for r in rows] == ["Boss, which scene?", "Boss, exactly thirty minutes, still paired"]
    assert rows[0].input.startswith("{NAME_A}: hello there\nsecond line") and "{PHONE}" in rows[0].input and [r.split for r in rows] == ["train", "val"]
    kept = curation.curate(ex, 10).collect()
    assert {r.reason for r in kept} == {"passed"} and len(kept) == 2
    chat = curation.as_chat(ex, "be brief").orderBy("id").first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"] and chat.metadata["chat"] == "c"
    assert {(r.chat, r.lang): r.n for r in curation.mix_report(ex).collect()}[(None, None)] == 2
    assert {r.label: r.share for r in curation.tag_report(ex).collect()}["script"] == 1.0


def test_memory_store(spark, tmp_path):
    m = MemoryStore(spark, str(tmp_path / "mem"))
    assert m.search("ltm", "x").count() == 0
    m.add("ltm", text="prefers short scenes", tags=["Film"], embedding=[1.0, 0.0])
    m.add("ltm", text="likes tea", tags=["food"], embedding=[0.0, 1.0])
    m.add("snippets", title="Beat sheet", body="list the beats")
    top = m.search("ltm", "short film scenes").collect()
    assert top[0].text == "prefers short scenes" and top[0].score == 2.5 and top[0].trust == 3 and len(top) == 2
    assert [r.text for r in m.search("ltm", "tea", tags=["FOOD"]).collect()] == ["likes tea"]
    assert m.search("ltm", vector=[0.0, 2.0], top_k=1).first().text == "likes tea"
    assert m.search("snippets", "beats").first().domain == "general"
    m.upsert_stm("s", "first", "te")
    m.upsert_stm("t", "other", "en")
    m.upsert_stm("s", "second", "en")
    assert {r.session_id: r.rolling_summary for r in m.table("stm").collect()} == {"s": "second", "t": "other"}


def test_small_plans(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.9), (2, 0.4), (3, 0.95)], "id int, c double")
    assert [r.id for r in curation.confident(df, "c", 0.5, 1).collect()] == [3]
    text = spark.range(1).select(curation.composed_reply(F.lit("Hi"), F.array(*[F.lit(x) for x in "abcdef"])).alias("t")).first().t
    assert text == "Hi\n- a\n- b\n- c\n- d"
    scenes = spark.createDataFrame([(1, 1, None), (2, 1, 1.5), (3, 1, 1.0)], "id int, project_id int, narrative_order double")
    assert [r.id for r in curation.in_story_order(scenes).orderBy("place").collect()] == [3, 2, 1]
    io.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 3
    io.create_table(spark, "seeded", "id int, name string", {"id": 1, "name": "a"})
    io.create_table(spark, "seeded", "id int, name string", {"id": 2, "name": "b"})
    assert [r.id for r in spark.table("seeded").collect()] == [1]
    io.drop_table(spark, "seeded")


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"reply_window_minutes": 10}))
    s = config.load_settings(str(p), {"TALKLOOM_SEED": "7"})
    assert s.reply_window_minutes == 10 and s.seed == "7" and s.prefix == config.DEFAULT.prefix
