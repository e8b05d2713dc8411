"""Sources, sinks and the stores, row by row of the survey."""

import os
import time

import pytest
from pyspark.sql import functions as F

from talkloom.memory import MemoryStore
from talkloom.operators import quality, screenplays, tables
from talkloom.plans import curation
from talkloom.sources import io


def test_documents_and_inventory(spark, tmp_path):
    """[SRC9, SRC14, SRC15]"""
    io.put_document(spark.createDataFrame([("Asha", ["a", "b"])], "name string, rules array<string>"), f"{tmp_path}/doc")
    got = io.get_document(spark, f"{tmp_path}/doc", "name string, rules array<string>, updated_at string").first()
    assert (got.name, got.rules) == ("Asha", ["a", "b"]) and got.updated_at.endswith("+00:00")
    (tmp_path / "index.json").write_text('{"files": [{"file_path": "/x/one.txt", "chat_name": "One"}, {"file_path": "/x/two.b.txt"}]}')
    assert sorted(map(tuple, io.inventory_chats(spark, f"{tmp_path}/index.json").collect())) == [("One", "/x/one.txt"), ("two.b", "/x/two.b.txt")]
    options = io.jdbc_options({"DB_HOST": "h", "DB_NAME": "n", "DB_USER": "u"})
    assert options["url"] == "jdbc:postgresql://h:5432/n" and options["user"] == "u"


def test_retention(spark, tmp_path):
    """[SNK17]"""
    for name, days in (("old", 40), ("deep/older", 31), ("new", 1)):
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
        os.utime(file, (time.time() - days * 86400,) * 2)
    assert io.delete_expired(spark, f"{tmp_path}/in", 30) == 2
    assert (tmp_path / "in" / "new").exists()
    assert not (tmp_path / "in" / "old").exists() and not (tmp_path / "in" / "deep" / "older").exists()


def test_memory_store(spark, tmp_path):
    """[SNK5, SNK6]"""
    m = MemoryStore(spark, str(tmp_path))
    m.add("interactions", session_id="s", user_msg="hi", model_reply="hello", lang="en")
    r = m.table("interactions").first()
    assert (r.session_id, r.user_msg, r.used_ltm_ids) == ("s", "hi", []) and len(r.id) == 32 and r.created_at == r.updated_at
    m.upsert_stm("s", "one", "en")
    m.upsert_stm("t", "two", "te")
    m.upsert_stm("s", "three", "en")
    assert sorted((r.session_id, r.rolling_summary) for r in m.table("stm").collect()) == [("s", "three"), ("t", "two")]
    os.rename(tmp_path / "stm", tmp_path / "stm.old")  # as a crash between the renames leaves it
    m.upsert_stm("u", "four", "en")
    assert sorted(r.session_id for r in m.table("stm").collect()) == ["s", "t", "u"] and not (tmp_path / "stm.old").exists()


def test_turns_and_order(spark):
    """[FLT11, FLT14, SRT4, RET6]"""
    rows = [("hello", "a long answer", "en", True), ("hey", "a long answer", "en", False), ("hello", "short", "en", False), ("hello", "a long answer", "xx", False), (None, "a long answer", "en", False)]
    df = spark.createDataFrame(rows, "t string, r string, l string, want boolean")
    assert df.filter(quality.turn_complete(F.col("t"), F.col("r"), F.col("l"), ["en", "te"]) != F.col("want")).count() == 0
    scenes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, slug string")
    assert tables.resolve_one(scenes, F.col("slug") == "b").first().id == 2
    with pytest.raises(LookupError):
        tables.resolve_one(scenes, F.col("slug") == "z")
    turns = spark.createDataFrame([("s", 2, "2024/01/02"), ("t", 1, "2024/01/01"), ("s", 1, "2024/01/01")], "session_id string, turn_number int, day string")
    assert [tuple(r) for r in curation.session_turns(turns, "s").collect()] == [("s", 1, "2024/01/01"), ("s", 2, "2024/01/02")]


LINE = "array<struct<text:string,translation:string>>"


@pytest.fixture
def play(spark):
    projects = spark.createDataFrame([(1, "Rain", "Asha", None), (2, "Empty", "", "2024-01-01")], "project_id long, title string, author string, draft_date string")
    scenes = spark.createDataFrame([(1, 12, 2, "EXT. ROAD"), (1, 11, 1, "INT. HOUSE - DAY")], "project_id long, scene_id long, scene_number int, heading string")
    elements = spark.createDataFrame(
        [(11, 1, "dialogue", None, "Ravi", "softly", [("nenu", "me"), ("ok", None)]), (11, 0, "action", "He\nwaits.", None, None, None), (12, 0, "transition", None, None, None, None), (12, 1, "dialogue", None, None, "", []), (12, 2, "note", "x", None, None, None)],
        f"scene_id long, order_index int, element_type string, text string, character string, parenthetical string, lines {LINE}",
    )
    return projects, scenes, elements


def test_fountain(play):
    """[SNK18]"""
    got = {r.project_id: r.text for r in screenplays.fountain(*play).collect()}
    assert got[1].split("\n") == ["Title: Rain", "Author: Asha", "", "", "INT. HOUSE - DAY", "", "He", "waits.", "", "RAVI", "(softly)", "nenu", "(me)", "ok", "", "", "EXT. ROAD", "", "> CUT TO:", "", "UNKNOWN", "", ""]
    assert got[2] == "Title: Empty\nDraft date: 2024-01-01\n\n"
    assert "nenu -- me" in screenplays.fountain(*play, in_parentheses=False).filter("project_id = 1").first().text
    assert "me" not in screenplays.fountain(*play, translations=False).filter("project_id = 1").first().text.split("\n")


def test_html(play):
    """[SNK18]"""
    got = {r.project_id: r.text for r in screenplays.html(*play).collect()}
    body = got[1].split("<body>\n")[1].split("\n")
    assert body == [
        '<div class="title">Rain</div>', '<div class="author">Asha</div>', '<div class="scene-heading">INT. HOUSE - DAY</div>', '<div class="action">He<br>waits.</div>', '<div class="character">RAVI</div>',
        '<div class="parenthetical">(softly)</div>', '<div class="dialogue">nenu</div>', '<div class="dialogue translation">(me)</div>', '<div class="dialogue">ok</div>',
        '<div class="scene-heading">EXT. ROAD</div>', '<div class="transition">CUT TO:</div>', '<div class="character">UNKNOWN</div>', "</body></html>",
    ]
    assert '<div class="author">Unknown</div>' in got[2]


def test_replace_project(spark):
    """[SNK10]"""
    scenes = spark.createDataFrame([(5, 1, 1, "old", 1.0, "active"), (9, 2, 1, "other", 1.0, "active")], "id long, project_id long, scene_number int, location string, narrative_order double, status string")
    elements = spark.createDataFrame([(7, 5, "action", 0, "gone"), (8, 9, "action", 0, "stays")], "id long, scene_id long, element_type string, order_index int, content string")
    characters = spark.createDataFrame([(3, 1, "Ravi"), (4, 2, "Asha")], "id long, project_id long, name string")
    new = (
        spark.createDataFrame([(2, "road"), (1, "house")], "scene_number int, location string"),
        spark.createDataFrame([(2, "action", 0, "c"), (1, "dialogue", 1, "b"), (1, "action", 0, "a")], "scene_number int, element_type string, order_index int, content string"),
        spark.createDataFrame([("Ravi",), ("Asha",), ("Asha",)], "name string"),
    )
    s, e, c = screenplays.replace_project(1, scenes, elements, characters, *new)
    assert sorted(map(tuple, s.collect())) == [(9, 2, 1, "other", 1.0, "active"), (10, 1, 1, "house", 1.0, "active"), (11, 1, 2, "road", 2.0, "active")]
    assert sorted(map(tuple, e.collect())) == [(8, 9, "action", 0, "stays"), (9, 10, "action", 0, "a"), (10, 10, "dialogue", 1, "b"), (11, 11, "action", 0, "c")]
    assert sorted(map(tuple, c.collect())) == [(3, 1, "Ravi"), (4, 2, "Asha"), (5, 1, "Asha")]


def test_search_scenes(spark):
    """[RET3]"""
    rows = [(1, 1, "INT. HOUSE", "t", 1.0, "active", "p", "the rain falls"), (2, 2, "EXT. ROAD", None, 2.0, "active", "p", "x" * 300), (3, 1, "INT. SHOP", None, 1.0, "active", "q", "rain")]
    scenes = spark.createDataFrame(rows, "scene_id long, scene_number int, heading string, title string, narrative_order double, status string, project string, text string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 0.0])], "scene_id long, vector array<double>")
    ids = lambda df: [r.scene_id for r in df.collect()]
    assert ids(screenplays.search_scenes(scenes, "RAIN", k=2)) == [3, 1] and ids(screenplays.search_scenes(scenes, "rain", slug="p", k=1)) == [1]
    found = screenplays.search_scenes(scenes, "rain", [1.0, 0.0], vectors).collect()
    assert [(r.scene_id, r.score) for r in found] == [(2, 1.0), (3, 0.0)] and found[0].preview == "x" * 200 + "..."
    assert ids(screenplays.search_scenes(scenes, "rain", [1.0, 0.0], vectors.limit(0))) == [3, 1, 2]


def test_retrieve_templates(spark):
    """[RET7]"""
    tags = [["script", "style"], ["Script", "template", "pitch"], ["script", "template", "structure"], ["other"]]
    snippets = spark.createDataFrame([(str(i), f"t{i}", "body", t) for i, t in enumerate(tags)], "created_at string, title string, body string, tags array<string>")
    memories = spark.createDataFrame([("1", "beats first", ["film"]), ("2", "budget is low", ["film"]), ("3", "beats", ["home"])], "created_at string, text string, tags array<string>")
    s, m = screenplays.retrieve_templates("Pitch the outline", snippets, memories)
    assert sorted((r.route, r.title) for r in s.collect()) == [("outline", "t2"), ("pitch", "t1"), ("style", "t0")] and [r.text for r in m.collect()] == ["beats first"]
    s, m = screenplays.retrieve_templates("hello", snippets, memories)
    assert s.count() == 0 == m.count()
