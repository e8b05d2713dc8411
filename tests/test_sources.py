import io
import json
import zipfile

from pyspark.sql import functions as F

from talkloom.sources import io as sio
from talkloom.sources import parse, screenplay


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "n": 2}\n\nnot json\n{"id": "2"}\n')
    assert sorted(r.id for r in sio.read_jsonl(spark, str(p), "id string, n int").collect()) == ["1", "2"]
    bad = sio.read_jsonl(spark, str(p), "id string, n int", "count").cache()
    assert bad.filter("_corrupt_record is not null").count() == 1
    try:
        sio.read_jsonl(spark, str(p), "id string, n int", "strict").collect()
        raise AssertionError("a bad line was read")
    except Exception as e:
        assert "MALFORMED" in str(e).upper()
    assert sio.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    assert {r.file_stem for r in sio.read_many(spark, str(tmp_path / "*.jsonl"), "id string").collect()} == {"a"}


def test_write_keeps_nulls_and_inserts(spark, tmp_path):
    out = str(tmp_path / "out")
    sio.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string"), out)
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == '{"a":"é","b":null}\n'
    sio.insert_row(spark, out, {"text": "x"}, "text string, lang string, trust int", {"lang": "te", "trust": 3})
    row = sio.read_jsonl(spark, out, "id string, text string, lang string, trust int, created_at string, updated_at string").filter("text = 'x'").first()
    assert len(row.id) == 32 and row.trust == 3 and row.created_at == row.updated_at


def test_documents_and_archives(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.json").write_text(json.dumps({"topic": "a", "n": 1}, indent=1))
    assert [(r.topic, r.dir_rank) for r in sio.read_documents(spark, [str(tmp_path / "raw")], "topic string, n int").collect()] == [("a", 0)]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "caf\xe9".encode("latin-1"))
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "a.zip", "w") as z:
        z.writestr("chat.txt", "a\r\nb\rc")
        z.writestr("in.zip", inner.getvalue())
    got = {r.member: (r.text, r.charset) for r in sio.read_archives(spark, str(tmp_path / "zips")).collect()}
    assert got == {"chat.txt": ("a\nb\nc", "utf-8"), "in.zip/deep.txt": ("café", "cp1252")}
    assert sio.stored_bytes(spark, str(tmp_path / "zips")).first().files == 1


def test_inventory(spark):
    rows = [("/x/WhatsApp Chat with Ann.txt", "1/2/24, 10:00 - Ann: hi\nb"), ("/y/Bob - Carl/_chat.txt", "[1/2/24, 10:00:00] Bob: x"), ("/z/notes.txt", "nothing")]
    got = {r.chat_name: (r.line_count, r.guessed_format) for r in sio.inventory(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"Ann": (2, "android"), "Carl": (1, "ios"), "notes": (1, "unknown")}


def test_markdown_blocks(spark):
    text = "intro\n### SCENE 1\na\nb\n### SCENE 2\nc"
    files = spark.createDataFrame([("f", text), ("g", "### SCENE 1\nx")], "file string, text string")
    got = [(r.file, r.block, r.text) for r in parse.blocks(files, parse.SCENE).orderBy("file", "block").collect()]
    assert got == [("f", 0, "intro"), ("f", 1, "### SCENE 1\na\nb"), ("f", 2, "### SCENE 2\nc"), ("g", 1, "### SCENE 1\nx")]
    s = parse.snippets(spark.createDataFrame([("f", "#### TIP – Write daily\nbody\nmore")], "file string, text string")).first()
    assert (s.title, s.body) == ("Write daily", "body\nmore")
    v = parse.vocabulary(spark.createDataFrame([("f", "#### WORD: calm\n- at rest\n* still")], "file string, text string")).first()
    assert (v.word, v.definition) == ("calm", "at rest still")


def test_calls_and_streams(spark):
    df = spark.createDataFrame([('say <tool_call name="a">{"x": 1}</tool_call><tool_call name="b"></tool_call><tool_call name="c">{bad</tool_call> end',)], "t string")
    r = df.select(parse.tool_calls(F.col("t")).alias("c"), parse.without_tool_calls(F.col("t")).alias("rest")).first()
    assert [(c.name, c.arguments) for c in r.c] == [("a", '{"x": 1}'), ("b", "{}")] and r.rest == "say  end"
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("data: [DONE]",), ("data: {bad",), (": x",)], "l string")
    assert [x[0] for x in lines.select(parse.sse_delta(F.col("l"))).collect()] == ["hi", None, None, None]
    bodies = spark.createDataFrame([(json.dumps({"choices": [{"message": {"content": "x", "tool_calls": [{"function": {"name": "f", "arguments": "{bad"}}]}}]}),), (json.dumps({"content": [{"type": "text", "text": "y"}, {"type": "tool_use", "name": "g", "input": {"k": 1}}]}),)], "b string")
    got = [x[0] for x in bodies.select(parse.response_parts(F.col("b"))).collect()]
    assert (got[0].content, got[0].tool_calls[0].name, got[0].tool_calls[0].arguments) == ("x", "f", "{}")
    assert got[1].content == "y" and got[1].tool_calls[0].name == "g" and json.loads(got[1].tool_calls[0].arguments) == {"k": 1}


FOUNTAIN = """Title: x

INT. HOUSE - NIGHT 12

Rain falls.

ANN (O.S.)
(softly)
Hello there. (good evening)

CUT TO:

.FOREST

BOB
Run!
"""


def test_screenplays(spark):
    df = spark.createDataFrame([("a", FOUNTAIN)], "file string, text string")
    rows = screenplay.parse_scripts(df, "fountain").orderBy("scene_number", "order_index").collect()
    assert [(r.scene_number, r.kind, r.character, r.text) for r in rows] == [
        (1, "heading", None, "INT. HOUSE - NIGHT"), (1, "action", None, "Rain falls."), (1, "parenthetical", "ANN", "softly"),
        (1, "dialogue", "ANN", "Hello there."), (1, "transition", None, "CUT TO:"), (2, "heading", None, "FOREST"), (2, "dialogue", "BOB", "Run!"),
    ]
    assert rows[0].location == "HOUSE" and rows[0].time_of_day == "NIGHT" and rows[3].translation == "good evening"
    md = "### INT. ROOM - DAY\n**Ann:** Hi (hello)\n- more\n> thought\n_She waits._\n"
    kinds = [(k[6], k[7], k[8]) for k in screenplay.markdown("b", md)]
    assert kinds == [("heading", None, "INT. ROOM - DAY"), ("dialogue", "Ann", "Hi"), ("dialogue", "Ann", "more"), ("voice_over", "Ann", "thought"), ("action", None, "She waits.")]
    pdf = screenplay.pdf_text("c", "E X T. ROAD - DAY\n12\nBOB\nGo.\n\n_He leaves._\n")
    assert [(k[6], k[8]) for k in pdf] == [("heading", "EXT. ROAD - DAY"), ("dialogue", "Go."), ("action", "He leaves.")]
