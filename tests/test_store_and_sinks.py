"""Gated import, changes of trees, labels, file sinks, workspace trees, options and commands."""

import decimal
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lorekeep import cli, options
from lorekeep.operators import conversation, discussion, listing, store, tree
from lorekeep.sinks import files
from lorekeep.sources import docx, project_page, workspace
from lorekeep.streaming import versions
from tests.test_content import CONTENTS, export, read
from tests.test_docx import archive, para

D = decimal.Decimal
STORED = "uid string, parent string, doc long, seq_pos decimal(38,10), kind string, content string, valid_from long, valid_to long"


def test_gate_and_import(spark):
    requests = spark.createDataFrame([(1, 10, "d", "t", "s"), (2, 10, "d", "t", "s"), (3, 11, "d", "t", "s"), (9, 10, "d", "t", "s"), (1, 77, "d", "t", "s"), (4, 12, "bad", "t", "s"), (4, 12, None, None, None)], "doc long, user long, domain string, tier string, status string")
    docs, users = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc long"), spark.createDataFrame([(i,) for i in (10, 11, 12)], "user long")
    allowed = spark.createDataFrame([(10, 1), (12, None), (10, 9)], "user long, doc long")
    rules = spark.createDataFrame([(1, "bad", None, None, True, 5), (2, None, None, None, False, 1), (3, "bad", "t", None, False, 5)], "uid int, domain string, tier string, status string, block_import boolean, priority int")
    gated = store.gate(requests, docs, users, allowed, rules)
    told = sorted((r.doc, r.user, r.domain, r.reason) for r in gated.collect() if r.domain) + [(r.doc, r.user, r.domain, r.reason) for r in gated.collect() if not r.domain]
    assert told == [(1, 10, "d", None), (1, 77, "d", "no such user"), (2, 10, "d", "not allowed to edit"), (3, 11, "d", "not allowed to edit"), (4, 12, "bad", "barred by policy"), (9, 10, "d", "no such document"), (4, 12, None, None)]
    stored = spark.createDataFrame([("r1", None, 1, D(5), "document", "x", 0, None), ("a", "r1", 1, D(7000), "paragraph", "y", 0, None), ("b", "r1", 1, D(9000), "paragraph", "z", 0, 3)], STORED)
    incoming = spark.createDataFrame([(f"{d}#{i}", p and f"{d}#{p}", d, D(1000 * i), "paragraph", "t") for d in (1, 2, 4) for i, p in ((1, None), (2, None), (3, 1))], "key string, parent string, doc long, seq_pos decimal(38,10), kind string, content string")
    out = store.import_blocks(stored, gated, incoming, 8)
    got = {r.uid: (r.parent, r.doc, int(r.seq_pos)) for r in out["blocks"].collect()}
    assert got == {"1#1@8": ("r1", 1, 8000), "1#2@8": ("r1", 1, 9000), "1#3@8": ("1#1@8", 1, 3000), "4#root": (None, 4, 1_000_000), "4#1@8": ("4#root", 4, 1000), "4#2@8": ("4#root", 4, 2000), "4#3@8": ("4#1@8", 4, 3000)}
    events = out["events"].collect()
    assert len(events) == 7 and {r.actor for r in events} == {10, 12} and json.loads(events[0].event_data)["sequence"] == 8
    audit = sorted((r.doc, r.user, r.action, r.detail) for r in out["audit"].collect())
    assert (1, 10, "imported", "3 blocks") in audit and (9, 10, "rejected", "no such document") in audit
    # the same file once more: blocks of its own, each once in the walk
    grown = stored.unionByName(out["blocks"])
    again = store.import_blocks(grown, gated, incoming, 9)["blocks"]
    every = grown.unionByName(again).where("valid_to IS NULL")
    assert every.count() == every.select("uid").distinct().count() == 2 + 7 + 6
    walked = tree.depth_first(every, 9)
    assert walked.count() == 15 and sorted(r.place for r in walked.collect()) == list(range(1, 16))


def test_policy_keeps_equal_requests(spark):
    from lorekeep.operators.access import best_policy

    requests = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", "t", "s")], "domain string, tier string, status string")
    rules = spark.createDataFrame([(1, "a", None, None, True, 1), (2, None, "t", "s", True, 3), (3, "b", None, None, False, 3)], "uid int, domain string, tier string, status string, block_import boolean, priority int")
    assert sorted(r.blocked for r in best_policy(requests, rules).collect()) == [True, True, True]
    assert [r.blocked for r in best_policy(requests, rules.limit(0)).collect()] == [False] * 3


def test_changes_of_trees(spark):
    blocks = spark.createDataFrame([("r", None, 1, D(10), "d", "c", 0, None), ("a", "r", 1, D(10), "p", "c", 0, None), ("b", "r", 1, D(20), "p", "c", 0, 4), ("r2", None, 1, D(5), "d", "c", 0, 2)], STORED)
    assert [(r.doc, r.uid) for r in tree.first_root(blocks).collect()] == [(1, "r")]
    assert {r.parent: r.uid for r in tree.last_children(blocks).collect()} == {None: "r", "r": "a"}
    docs = spark.createDataFrame([(1,), (2,), (2,)], "doc long")
    assert [(r.uid, r.content, int(r.seq_pos)) for r in tree.missing_roots(docs, blocks, 9).collect()] == [("2#root", "TEST DOC", 1_000_000)]
    labels = spark.createDataFrame([], "doc long, label string, seq long")
    assert tree.stamped(labels, docs.where("doc = 1"), "v1", 5).collect()[0].seq == 5
    shown = [r.uid for r in tree.snapshot(blocks.select("uid", "parent", "seq_pos", "valid_from", "valid_to"), 3).collect()]
    assert shown == ["r", "a", "b"]  # the null parent first
    after = tree.retire(blocks, spark.createDataFrame([("a",)], "uid string"), 6)
    assert [(r.uid, r.event_type) for r in tree.change_events(blocks, after, 1).collect()] == [("a", "delete")]
    loop = spark.createDataFrame([("1", None), ("2", "3"), ("3", "2")], "uid string, parent string").selectExpr("uid", "parent", "cast(1 as decimal(38,10)) seq_pos", "'c' content", "0L valid_from", "cast(null as long) valid_to")
    assert [r.uid for r in tree.depth_first(loop, 0).collect()] == ["1"]
    assert tree.depth_first(loop, 0, start="2").count() == 0 and sorted(r.uid for r in tree.cycles(loop).collect()) == ["2", "3"]


def test_chains_that_come_back(spark):
    rows = spark.createDataFrame([("c", "r", None), ("c", "a", "r"), ("c", "x", "y"), ("c", "y", "x"), ("d", "r", None)], "conversation_id string, id string, parent string")
    got = sorted((r.conversation_id, r.id, r.idx, r.issue) for r in conversation.chain_order(rows).where("issue IS NULL").collect())
    assert got == [("c", "a", 1, None), ("c", "r", 0, None), ("d", "r", 0, None)]
    assert [(r.conversation_id, r.idx, r.issue[:14]) for r in conversation.chain_order(rows).where("issue IS NOT NULL").collect()] == [("c", None, "cycle at node:")]


def test_labels(spark):
    messages = spark.createDataFrame([("c", 1, "  first   text "), ("c", 2, "second"), ("c", 3, "boom")], "conv_id string, seq int, text string")
    stored = spark.createDataFrame([("c", 2, "kept")], "conv_id string, seq int, label string")
    assert [r.label for r in discussion.labelled(messages, stored).orderBy("seq").collect()] == ["first text", "kept", "boom"]

    def service(text):
        if text == "boom":
            raise TimeoutError("600 s")
        return text.strip()[:5]

    rows = discussion.generate_labels(messages, service).orderBy("seq").collect()
    assert [(r.label, r.error) for r in rows] == [("first", None), ("secon", None), (None, "TimeoutError: 600 s")]


def test_file_sinks(spark, tmp_path):
    titles = spark.createDataFrame([("c1", 'My "talk": 1/2'), ("c2", "none said")], "conv_id string, title string")
    items = spark.createDataFrame([("c1", 2, "{ b }"), ("c1", 1, "{ a }")], "conv_id string, seq int, item string")
    elm = {r.name: r.content for r in files.elm_modules(items, titles, "Talks.Types").collect()}
    assert elm["Discourse_C1.elm"] == 'module Discourse_C1 exposing (content)\n\nimport Talks.Types as T\n\ncontent = ("My \\"talk\\": 1/2", "c1", messages)\n\nmessages = [\n  { a }\n  , { b }\n  ]\n'
    assert "messages = [\n  \n  ]" in elm["Discourse_C2.elm"]
    names = spark.createDataFrame([("1 x",), ("",), ("é-1",), ("a-b",)], "e string").select(files.module_name(F.col("e")).alias("n"))
    assert [r.n for r in names.collect()] == ["Discourse_Dx", "Discourse_Discourse", "Discourse_É1", "Discourse_Ab"]
    rows = spark.createDataFrame([("c1", 1, 0, "GF M Header", "Manager> q"), ("c1", 1, 1, "GF Q Body", "line <1>\nline \x01 2"), ("c1", 2, 0, "Rule", "")], "conv_id string, seq int, place int, style string, text string")
    written = sorted(files.write_files(files.word_files(rows, titles), str(tmp_path / "out")).collect())
    assert [r.name for r in written] == ['My_"talk":_1_2_c1.docx', "none_said_c2.docx"]
    data = (tmp_path / "out" / written[0].name).read_bytes()
    assert b"TOC" in zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml") and len(data) == written[0].bytes
    kinds = [(k.kind, k.text) for k in docx.parse(data).kids]
    assert kinds[0] == ("heading", 'My "talk": 1/2')
    assert [k.text for k in docx.parse(data).kids[0].kids] == ["Manager> q", "line <1> line  2"]
    (tmp_path / "a.docx").write_bytes(archive(para("T", "H1") + para("b") + para("i", num=1)))
    blocks = docx.read_documents(spark.read.format("binaryFile").load(str(tmp_path / "a.docx")))
    tree_of = json.loads(files.tree_texts(blocks).first().content)
    assert tree_of["blocks"][0]["text"] == "T" and tree_of["blocks"][0]["blocks"][0]["blocks"][0]["kind"] == "list" and "comment" not in tree_of["blocks"][0]
    yaml = files.tree_texts(blocks, "yaml").first().content
    assert "  - uid: 1\n" in yaml and '    text: "T"\n' in yaml
    with pytest.raises(ValueError):
        files.tree_texts(blocks, "xml")


def test_files_are_all_there_or_none(spark, tmp_path):
    place = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.concat(F.lit("text "), "id").alias("content")).repartition(4)
    got = files.write_files(rows, str(place))
    assert got.count() == 40 and sorted(p.name for p in place.iterdir() if not p.name.startswith("_")) == sorted(f"f{i}" for i in range(40)) and (place / "f7").read_text() == "text 7"
    assert not (place / "_temporary").exists() and files.write_files(rows.limit(0), str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="several files"):
        files.write_files(rows.unionByName(rows.limit(1)), str(tmp_path / "twice"))
    bad = rows.withColumn("content", F.when(F.col("name") == "f39", F.raise_error(F.lit("no content"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no content"):
        files.write_files(bad, str(tmp_path / "failed"))
    assert [p.name for p in (tmp_path / "failed").rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="no file name"):
        files.write_files(rows.withColumn("name", F.concat(F.lit("a/"), "name")), str(tmp_path / "slash"))
    # a task that has written and fails is made again; what the first attempt wrote does not stay
    writer = files.FileWriter(str(tmp_path / "w"), "run", False)
    first, second = writer.write(iter([("a", b"1")])), writer.write(iter([("a", b"1"), ("b", b"22")]))
    writer.commit([second, writer.write(iter([]))])
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["_written", "a", "b"] and first.n_files == 1
    writer.abort([])


PAGES = {None: {"results": [{"id": "p1"}], "has_more": True, "next_cursor": "x"}, "x": {"results": [{"id": "p2"}], "has_more": False}}


def fetch_page(cursor):
    return PAGES[cursor]


TREE = {
    ("r", None): [{"id": "a", "type": "paragraph", "has_children": True}, {"id": "b", "type": "image"}], ("a", None): [{"id": "c", "type": "code", "has_children": True}], ("c", None): [{"id": "d", "type": "code"}], ("s", None): [],
}


def test_workspace(spark):
    spark.dataSource.register(workspace.WorkspaceSource)
    rows = spark.read.format("workspace").option("fetcher", "tests.test_store_and_sinks:fetch_page").load()
    assert [json.loads(r.value)["id"] for r in rows.collect()] == ["p1", "p2"]
    tree_of = dict(TREE)
    blocks = workspace.block_tree(spark, spark.createDataFrame([("r",), ("s",)], "id string"), lambda i, cursor: {"results": tree_of[i, cursor], "has_more": False})
    assert [(r.id, r.depth) for r in blocks.orderBy("root", "path").collect()] == [("a", 1), ("c", 2), ("d", 3), ("b", 1)]
    assert [(r.root, r.n_blocks, r.types) for r in workspace.page_stats(blocks).collect()] == [("r", 4, "code,image,paragraph")]
    loop = {("r", None): [{"id": "a", "has_children": True}], ("a", None): [{"id": "r", "has_children": True}, {"id": "x"}]}
    turned = workspace.block_tree(spark, spark.createDataFrame([("r",)], "id string"), lambda i, cursor: {"results": loop[i, cursor], "has_more": False})
    assert sorted((r.id, r.error) for r in turned.collect()) == [("a", None), ("r", "block below itself: r"), ("x", None)]
    block = lambda i, parent, kind="page_id", **more: {"id": i, "type": "paragraph", "parent": {"type": kind, kind: parent}, "paragraph": {"rich_text": [{"plain_text": i}]}, **more}
    saved = [{"page": 1, "results": [block("c", "p1")]}, {"results": [block("a", "p1"), block("b", "p1")]}, {"results": [block("a1", "a", "block_id"), block("a2", "a", "block_id", type="odd")]}, {"results": [block("z", "p2")]}]
    found = workspace.saved_tree(spark.createDataFrame([(json.dumps(e),) for e in saved], "value string")).orderBy("root", "place").collect()
    assert [(r.root, r.place, r.depth, r.n_below, r.id) for r in found] == [("p1", 1, 1, 2, "a"), ("p1", 2, 2, 0, "a1"), ("p1", 3, 2, 0, "a2"), ("p1", 4, 1, 0, "b"), ("p1", 5, 1, 0, "c"), ("p2", 1, 1, 0, "z")]
    assert found[1].text == "a1" and found[2].error == "unsupported block type: odd"
    envelope = {"results": [
        {"id": "1", "type": "image", "parent": {"type": "page_id", "page_id": "p"}, "image": {"type": "file", "file": {"url": "u", "expiry_time": "2024-01-02T03:04:05Z"}, "caption": [{"plain_text": "c"}]}},
        {"id": "2", "parent": {"type": "workspace", "workspace": True}, "icon": {"type": "emoji", "emoji": "x"}, "cover": {"type": "external", "external": {"url": "e"}}},
        {"id": "3", "parent": {"type": "block_id"}, "icon": {"type": "odd"}},
    ]}
    got = {r.id: r for r in workspace.unions(workspace.results(spark.createDataFrame([(json.dumps(envelope),)], "value string"))).collect()}
    assert got["1"].image.url == "u" and got["1"].image.expiry_time.year == 2024 and got["1"].caption == "c" and got["1"].parent_id == "p"
    assert got["2"].icon_emoji == "x" and got["2"].cover.url == "e" and got["2"].parent_error is None and got["2"].image is None
    assert got["3"].parent_error == "unsupported parent.type: block_id" and got["3"].icon.error == "unsupported icon.type: odd"


def test_options():
    o = options.merged({"store": "$HOME/x", "promote": "false"}, {"HOME": "/h", "LOREKEEP_MODE": "xml"}, {"mode": "auto", "ids": None})
    assert (o.store, o.promote, o.mode, o.ids) == ("/h/x", False, "auto", "")
    assert options.read_file("a: 1\n# no\nb: 'x: y' # c\n\nplain") == {"a": "1", "b": "x: y"} and options.expand("$NO/x", {}) == "$NO/x"
    with pytest.raises(ValueError):
        options.merged({"colour": "red"}, {}, {})


def test_targets(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "uid string")
    members = spark.createDataFrame([("a", "g")], "uid string, label string")
    assert [r.uid for r in listing.targets(docs, ids=docs.where("uid = 'b'")).collect()] == ["b"]
    assert [r.uid for r in listing.targets(docs, members=members, label="g").collect()] == ["a"] and listing.targets(docs, default_all=True).count() == 2
    with pytest.raises(ValueError):
        listing.targets(docs)
    conversations = spark.createDataFrame([("e1", "t"), ("e2", "u")], "eid string, title string")
    group = spark.createDataFrame([("g", "e2"), ("g", "e2"), ("h", "e1")], "label string, eid string")
    assert [r.title for r in project_page.members_of(group, conversations, "g").collect()] == ["u"]


def talk_of(contents, cid="c1", ends=()):
    talk = export(contents, cid)
    for i in ends:
        talk["mapping"][f"n{i:02d}"]["message"]["end_turn"] = True
    return talk


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["help"]) == 0 and "lorekeep" in capsys.readouterr().out
    contents = [("user", {"content_type": "text", "parts": ["hello"]}), CONTENTS[1], CONTENTS[2], ("assistant", {"content_type": "text", "parts": ["done"]}), ("critic", {"content_type": "text", "parts": ["hm"]})]
    read(spark, tmp_path, talk_of(contents, ends=[3]))
    place = {"input": str(tmp_path / "e.json"), "store": str(tmp_path / "store")}
    o = options.Options(**place)
    shown = cli.run(spark, ["oai", "print"], o).first().transcript
    assert "hello" in shown and "x = 1" in shown and "done" in shown and "---- Reflection ---\na\nb" in shown
    for _ in range(2):  # the second time there is nothing new
        cli.run(spark, ["oai", "store"], o)
    batches = versions.Batches(spark, o.store)
    assert batches.read("conversations").count() == 1 and batches.read("thought").count() == 2 and batches.read("discussion_message").count() == 2
    out = options.Options(**place, output=str(tmp_path / "out"), types="My.Types")
    assert [r.name for r in cli.run(spark, ["oai", "elm"], out).collect()] == ["Discourse_C1.elm"] and [r.name for r in cli.run(spark, ["oai", "docx"], out).collect()] == ["c1_c1.docx"]
    elm = (tmp_path / "out" / "Discourse_C1.elm").read_text()
    assert 'T.Reflect "c" """d"""' in elm and "T.Error" in elm and "import My.Types as T" in elm and 'title = "msg_1"' in elm
    word = zipfile.ZipFile(tmp_path / "out" / "c1_c1.docx").read("word/document.xml").decode()
    assert "unknown role: critic" in word and "GFReflectionBody" in word and "PythonBlock" in word
    for _ in range(2):  # messages that have a label get no other
        cli.run(spark, ["oai", "summary"], o)
    assert batches.read("summaries").count() == 2
    cli.run(spark, ["oai", "elm"], out).count()
    assert 'title = "hello"' in (tmp_path / "out" / "Discourse_C1.elm").read_text()
    # the conversation goes on: its tail is added, its discussion folded anew
    read(spark, tmp_path, {**talk_of([*contents, ("user", {"content_type": "text", "parts": ["more"]})], ends=[3]), "title": "c1 renamed", "update_time": 9.0})
    cli.run(spark, ["oai", "store"], o)
    assert batches.read("nodes").count() == 7 and batches.read("previous").first().title == "c1" and versions.current(batches).first().title == "c1 renamed"
    messages, titles, _ = cli._stored(spark, o)
    assert sorted((r.seq, r.label) for r in messages.collect()) == [(1, "hello"), (2, "done"), (3, None)] and titles.first().title == "c1 renamed"
    told = {r.id: (r.kind, r.text) for r in cli.run(spark, ["oai", "conversation", "deserialize"], o).collect()}
    assert told["n01"] == ("code", "x = 1") and told["n05"] == ("text", "more")
    before = sorted(map(str, messages.select("seq", "kind", "text", "steps").collect()))
    cli.run(spark, ["oai", "conversation", "convert"], o)
    assert sorted(map(str, cli._stored(spark, o)[0].select("seq", "kind", "text", "steps").collect())) == before
    page = '<ul><li class="group/project-item"><a href="/c/c1"></a><div class="font-medium">t</div><div class="text-token-text-secondary">s</div><span class="whitespace-nowrap">Jan 2</span></li></ul>'
    (tmp_path / "p.html").write_text(page)
    for _ in range(2):
        cli.run(spark, ["oai", "project"], options.Options(input=str(tmp_path / "p.html"), store=o.store, label="g"))
    assert batches.read("group_members").count() == 1 and cli._stored(spark, options.Options(store=o.store, label="g"))[1].count() == 1
    assert json.loads(cli.run(spark, ["docx"], options.Options(input=docx_file(tmp_path))).first().content)["blocks"][0]["text"] == "T"
    with pytest.raises(ValueError):
        cli.run(spark, ["dance"], o)


def docx_file(tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(para("T", "H1") + para("b")))
    return str(tmp_path / "a.docx")


def test_ingest_is_gated(spark, tmp_path):
    place, source = str(tmp_path / "store"), docx_file(tmp_path)
    for name, rows, schema in (
        ("documents", [(1, "d", "t", "s"), (2, "bad", "t", "s")], "doc long, domain string, tier string, status string"), ("users", [(10,), (11,)], "user long"), ("access", [(10, 1), (10, 2)], "user long, doc long"),
        ("policies", [(1, "bad", None, None, True, 1)], "uid int, domain string, tier string, status string, block_import boolean, priority int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}")
    run = lambda doc, user: [(r.action, r.detail) for r in cli.run(spark, ["ingest"], options.Options(input=source, store=place, doc=doc, user=user)).collect()]
    assert run("1", "10") == [("imported", "2 blocks")] and run("1", "11") == [("rejected", "not allowed to edit")] and run("2", "10") == [("rejected", "barred by policy")] and run("7", "10") == [("rejected", "no such document")]
    assert run("1", "10") == [("imported", "2 blocks")]
    blocks = versions.Batches(spark, place).read("blocks")
    assert blocks.count() == blocks.select("uid").distinct().count() == 5 and tree.depth_first(blocks, 99).count() == 5
    with pytest.raises(ValueError):
        cli.run(spark, ["ingest"], options.Options(input=source, store=place))


def test_versions(spark, tmp_path):
    batches = versions.Batches(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    assert batches.read("t") is None and batches.publish("b1", {"t": one, "u": one.limit(0)}) and not batches.publish("b1", {"t": one.union(one)})
    assert batches.read("t").count() == 1 and batches.read("u").count() == 0 and batches.read("u").columns == ["id", "v"]
    # a batch that stops between two tables is not seen, and is made again as a whole
    one.write.parquet(str(tmp_path / "s" / "t" / "batch=b2"))
    assert batches.read("t").count() == 1 and batches.publish("b2", {"t": one.union(one), "u": one})
    assert batches.read("t").count() == 3 and {r.batch for r in batches.read("t", with_batch=True).collect()} == {"b1", "b2"} and set(batches.tables()) == {"t", "u"}
    say = lambda *texts: [("user", {"content_type": "text", "parts": [t]}) for t in texts]
    state = lambda n, title, at: {**export(say(*"abcdefgh"[:n])), "title": title, "update_time": at}
    source = tmp_path / "in"
    source.mkdir()
    store = versions.Batches(spark, str(tmp_path / "c"))
    stream = lambda: versions.follow(spark.readStream.text(str(source), wholetext=True), str(tmp_path / "c"), str(tmp_path / "checkpoint")).awaitTermination()
    for k, (n, title, at) in enumerate([(2, "t", 1.0), (5, "t", 2.0), (5, "t", 2.0), (5, "u", 3.0)]):
        (source / f"{k}.json").write_text(json.dumps([state(n, title, at)]))
        stream()
    nodes = store.read("nodes").collect()
    assert sorted(r.seqnbr for r in nodes) == list(range(6)) and store.read("messages").count() == 5 and store.read("ingest").count() == 3
    assert sorted((r.version, r.title, r.update_time) for r in store.read("previous").collect()) == [(1, "t", 1.0), (2, "t", 2.0)]
    assert (versions.current(store).first().title, versions.current(store).first().version) == ("u", 3)
