"""Scene and session operations by name."""

import pytest

from talkloom.tools import TURNS, SceneStore, SessionStore


@pytest.fixture
def store(spark):
    return SceneStore(
        spark.createDataFrame([(1, "rain", "Rain"), (2, "sun", "Sun")], "id long, slug string, title string"),
        spark.createDataFrame([(11, 1, 1, "INT. A", "one", None, ["x"], 1.0, "active", "rain falls"), (12, 1, 2, "EXT. B", None, None, [], 2.0, "active", "a road"), (13, 1, 3, "EXT. C", None, None, [], 3.0, "active", "the end"), (21, 2, 1, "INT. D", None, None, [], 1.0, "active", "rain")], "id long, project_id long, scene_number int, heading string, title string, summary string, tags array<string>, narrative_order double, status string, text string"),
        spark.createDataFrame([(1, 11, "action", 1, "b"), (2, 11, "action", 0, "a")], "id long, scene_id long, element_type string, order_index int, content string"),
        spark.createDataFrame([(11, 13, "flashback")], "a long, b long, kind string"),
        default_project="rain",
    )


def test_scene_tools(store):
    r = store.registry()
    assert [t.name for t in r.tools("scenes")] == ["scene_search", "scene_get", "scene_update", "scene_reorder", "scene_link"]
    found = r.execute("scene_search", query="RAIN", top_k=1).data.collect()
    assert [(x.scene_id, x.preview) for x in found] == [(11, "rain falls")]
    assert r.execute("scene_search", query="rain", top_k=1, project_slug="sun").data.first().scene_id == 21
    one = r.execute("scene_get", scene_number=1).data.first()
    assert [e.content for e in one.elements] == ["a", "b"] and [(x.scene_id, x.kind) for x in one.related] == [(13, "flashback")] and one.project_title == "Rain"
    assert r.execute("scene_get", scene_id=21).data.first().project_slug == "sun"
    assert r.execute("scene_update", scene_number=2, title="two", tags=["y", "z"]).data is True and r.execute("scene_update", scene_number=2).data is False
    two = store.scene(2).first()
    assert (two.title, two.tags, two.status) == ("two", ["y", "z"], "active")
    assert r.execute("scene_reorder", scene_number=3, after_scene=1).data == 1.5 and store.scene(3).first().narrative_order == 1.5
    assert r.execute("scene_reorder", scene_number=3, before_scene=1).data == 0.0
    assert r.execute("scene_reorder", scene_number=3, after_scene=1, before_scene=2).data == 1.5
    assert r.execute("scene_link", from_scene=1, to_scene=2).success and store.relations.count() == 2


@pytest.mark.parametrize(("tool", "given"), [("scene_get", {}), ("scene_get", {"scene_number": 9}), ("scene_get", {"scene_number": 1, "project_slug": "none"}), ("scene_search", {"query": "x", "top_k": 21}), ("scene_link", {"from_scene": 1, "to_scene": 9}), ("scene_reorder", {"scene_number": 1}), ("scene_update", {"scene_number": 1, "colour": "red"}), ("scene_drop", {})])
def test_scene_tools_refuse(store, tool, given):
    got = store.registry().execute(tool, **given)
    assert not got.success and got.error


def test_session_tools(spark):
    s = SessionStore(spark.createDataFrame([], TURNS))
    r = s.registry()
    assert r.execute("session_create", session="a").data == "a" and s.current == "a"
    for i in range(23):
        s.add(f"t{i}")
    s.add("hello", "b")
    assert sorted(map(tuple, r.execute("session_list").data.collect())) == [("a", 23, 20), ("b", 1, 1)]
    assert [x.text for x in r.execute("session_history", session="a", last_n=2).data.collect()] == ["t21", "t22"]
    assert r.execute("session_switch", session="b").data == "b" and not r.execute("session_switch", session="z").success
    assert r.execute("session_clear", session="a").success and r.execute("session_get", session="a").data.first().turns == 0
    assert r.execute("session_delete", session="b").success and s.current is None
    assert [x.session for x in s.list().collect()] == ["a"] and not r.execute("session_history", session="b").success
    s.add("again", "b")
    assert [x.text for x in s.history("b").collect()] == ["again"]
