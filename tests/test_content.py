"""Contents of messages: decoding, tables and back, on hand-made exports."""

import json

from pyspark.sql import functions as F

from lorekeep.operators import content, conversation
from lorekeep.sources import exports

AUDIO = {"content_type": "audio_asset_pointer", "asset_pointer": "a://1", "size_bytes": 5, "format": "wav", "metadata": None}
IMAGE = {
    "content_type": "image_asset_pointer", "asset_pointer": "i://1", "size_bytes": 9, "width": 3, "height": 4, "fovea": None,
    "metadata": {"container_pixel_height": None, "container_pixel_width": 7, "sanitized": False, "dalle": {"prompt": "a cat", "seed": 2**40, "serialization_title": "t"}, "generation": {"gen_size": "s", "height": 1, "width": 2, "transparent_background": True, "serialization_title": "g"}},
}
LIVE = {"content_type": "real_time_user_audio_video_asset_pointer", "frames_asset_pointers": [], "audio_asset_pointer": {**AUDIO, "asset_pointer": "a://2", "metadata": {"start": 0.5, "end": 1.0}}}
CONTENTS = [
    ("user", {"content_type": "text", "parts": ["q1", "q2"]}),
    ("assistant", {"content_type": "code", "language": "python", "response_format_name": None, "text": "x = 1"}),
    ("assistant", {"content_type": "thoughts", "source_analysis_msg_id": "s", "thoughts": [{"summary": "a", "content": "b"}, {"summary": "c", "content": "d", "chunks": ["e"], "finished": True}]}),
    ("tool", {"content_type": "tether_quote", "url": "u", "domain": "d", "text": "t", "title": "ti"}),
    ("user", {"content_type": "multimodal_text", "parts": ["hi", AUDIO, IMAGE, LIVE, {"content_type": "audio_transcription", "text": "said", "direction": "in"}]}),
    ("assistant", {"content_type": "system_error", "name": "n", "text": "boom"}),
    ("assistant", {"content_type": "brand_new", "x": {"y": 1}}),
    ("assistant", {"content_type": "execution_output", "text": "out"}), ("assistant", {"content_type": "reasoning_recap", "content": "so"}),
    ("assistant", {"content_type": "tether_browsing_display", "result": "res", "assets": [1, 2]}), ("assistant", {"content_type": "model_editable_context", "model_set_context": "ctx", "repository": {"a": 1}}),
]


def export(contents, cid="c1", **message):
    mapping = {"r": {"id": "r", "parent": None, "children": ["n00"], "message": None}}
    for i, (role, c) in enumerate(contents):
        own = {"id": f"m{i}", "author": {"role": role, "name": None, "metadata": {}}, "create_time": 1.0, "status": "ok", "weight": 1.0, "recipient": "all", "content": c, **message}
        mapping[f"n{i:02d}"] = {"id": f"n{i:02d}", "parent": f"n{i - 1:02d}" if i else "r", "children": [f"n{i + 1:02d}"] if i + 1 < len(contents) else [], "message": own}
    return {"conversation_id": cid, "title": cid, "create_time": 1.0, "update_time": 2.0, "mapping": mapping}


def read(spark, tmp_path, *conversations):
    (tmp_path / "e.json").write_text(json.dumps(list(conversations)))
    return exports.read_export(spark, str(tmp_path / "e.json"))


def test_decode(spark, tmp_path):
    nodes = conversation.nodes(read(spark, tmp_path, export(CONTENTS)))
    rows = content.decode(nodes.where("message IS NOT NULL").withColumn("content", F.col("message.content"))).orderBy("id").collect()
    assert [r.kind for r in rows] == [c["content_type"] for _, c in CONTENTS] and all(r.error is None for r in rows)
    assert rows[0].text.parts == ["q1", "q2"] and rows[1].code.language == "python" and rows[1].code.response_format_name is None
    assert [t.finished for t in rows[2].thoughts.thoughts] == [None, True] and rows[3].tether_quote.title == "ti" and rows[3].code is None
    assert rows[6].other == {"content_type": '"brand_new"', "x": '{"y":1}'} and rows[9].tether_browsing_display.assets == "[1,2]"
    parts = content.parts(content.decode(nodes.where("message IS NOT NULL").withColumn("content", F.col("message.content"))), ["id"]).orderBy("seq").collect()
    assert [p.part_kind for p in parts] == ["text", "audio_asset_pointer", "image_asset_pointer", "real_time_user_audio_video_asset_pointer", "audio_transcription"]
    assert parts[0].text == "hi" and parts[2].dalle.seed == 2**40 and parts[2].generation.transparent_background and parts[2].image_metadata.container_pixel_width == 7
    assert [(p.audio_kind, p.audio and p.audio.asset_pointer) for p in parts] == [(None, None), (1, "a://1"), (None, None), (2, "a://2"), (None, None)]
    assert parts[1].audio_metadata is None and parts[3].audio_metadata.end == 1.0 and all(p.error is None for p in parts)


def test_what_cannot_be_decoded(spark, tmp_path):
    bad = [
        ("user", {"content_type": "code", "text": "x"}), ("user", {"parts": []}), ("user", {"content_type": "multimodal_text", "parts": ["a", {"content_type": "hologram"}]}), ("user", {"content_type": "multimodal_text", "parts": [5]}),
        ("user", {"content_type": "multimodal_text", "parts": [{k: v for k, v in IMAGE.items() if k != "fovea"}]}), ("user", {"content_type": "text", "parts": []}),
    ]
    nodes = conversation.nodes(read(spark, tmp_path, export(bad), export([("user", {"content_type": "text", "parts": ["x"]})], "c2", status=None)))
    told = {(r.conversation_id, r.id): r.reason for r in content.rejected_messages(nodes).collect()}
    assert told == {
        ("c1", "n00"): "code: missing language", ("c1", "n01"): "content_type is missing", ("c1", "n02"): "unknown part type: hologram", ("c1", "n03"): "part without a content_type",
        ("c1", "n04"): "image_asset_pointer: missing fovea", ("c2", "n00"): "missing: status",
    }


def test_tables_and_back(spark, tmp_path):
    conversations = read(spark, tmp_path, export(CONTENTS), export(CONTENTS[:2], "c2"))
    nodes = conversation.nodes(conversations)
    tables = content.to_tables(conversations, nodes)
    assert tables["nodes"].count() == 15 and tables["messages"].count() == 13 and tables["thought"].count() == 2 and tables["audio_pointer"].count() == 2
    back = {(r.conversation_id, r.id): r for r in content.from_tables(tables).collect()}
    assert len(back) == 13 and back["c1", "n06"].kind == "unknown" and back["c1", "n01"].code.text == "x = 1" and back["c1", "n02"].thoughts.thoughts[1].chunks == ["e"]
    parts = back["c1", "n04"].multimodal_text.parts
    assert [p.part_kind for p in parts][:2] == ["text", "audio_asset_pointer"] and parts[2].dalle.prompt == "a cat" and parts[3].real_time_audio.asset_pointer == "a://2" and parts[1].audio.format == "wav"
    assert back["c2", "n00"].parent_key == "c2/r"
    lost = content.from_tables({**tables, "code": tables["code"].limit(0), "authors": tables["authors"].where("role <> 'tool'")})
    left = {(r.conversation_id, r.id): r.kind for r in lost.collect()}
    assert left["c1", "n01"] == "unknown" and ("c1", "n03") not in left
    texts = {r.id: r.t for r in content.from_tables(tables).where("conversation_id = 'c1'").select("id", content.texts().alias("t")).collect()}
    assert texts["n00"] == ["q1", "q2"] and texts["n01"] == ["x = 1"] and texts["n02"] == ["s"] and texts["n06"] == []


def test_code_of_assistants(spark):
    rows = [
        ("JSON", json.dumps({"name": "n", "type": "document", "content": "# hi"})), ("json", "{}"), ("html", "<p>"), ("Python", "x"), ("unknown", json.dumps({"search_query": [{"q": "a"}, {"q": "b"}]})), ("sql", "select 1"),
        ("sql", json.dumps({"search_query": [{"z": 1}]})),
    ]
    got = [r.b for r in spark.createDataFrame(rows, "language string, text string").select(content.code_blocks(F.col("language"), F.col("text")).alias("b")).collect()]
    assert [(b.header, b.texts) for b in got[:6]] == [("Document", ["# hi"]), ("Code", ["json err: no document"]), ("HTML", ["<p>"]), ("Python", ["x"]), ("Search", ["a", "b"]), ("Code (sql)", ["select 1"])]
    assert got[6].header == "Code (sql)"
    pairs = spark.createDataFrame([({"a": "1"},), ({"a": "1", "b": "2"},), ({},)], "m map<string,string>").select(content.single_pair(F.col("m")).alias("p")).collect()
    assert pairs[0].p.label == "a" and pairs[0].p.value == "1" and pairs[1].p is None and pairs[2].p is None
    kinds = spark.createDataFrame([("code",), ("multimodal_text",), ("new",)], "k string").select(content.opaque(F.col("k")).alias("o")).collect()
    assert [r.o for r in kinds] == ["code", "multimodal_text", "unknown:new"]
