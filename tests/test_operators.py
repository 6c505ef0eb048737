"""Operators on hand-made rows: golden cases, ties, nulls and properties."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import access, conversation, discussion, listing, tree
from lorekeep.sources import exports, project_page, workspace

BLOCKS = "uid string, parent string, seq_pos decimal(38,10), content string, valid_from long, valid_to long"
D = __import__("decimal").Decimal


def blocks(spark, rows):
    return spark.createDataFrame([(u, p, D(s), u, a, b) for u, p, s, a, b in rows], BLOCKS)


def test_walk_as_of(spark):
    b = blocks(spark, [("1", None, 10, 0, None), ("2", "1", 10, 0, None), ("3", "1", 5, 0, 3), ("4", "2", 1, 2, None)])
    rows = tree.depth_first(b, 2, max_depth=5).orderBy("place").collect()
    assert [(r.uid, r.depth) for r in rows] == [("1", 1), ("3", 2), ("2", 2), ("4", 3)]
    assert [r.uid for r in tree.depth_first(b, 3, max_depth=5).orderBy("place").collect()] == ["1", "2", "4"]
    assert [(r.uid, r.has_more) for r in tree.depth_first(b, 2, max_depth=2).orderBy("place").collect()] == [("1", False), ("3", False), ("2", True)]
    assert tree.as_of(b, 99).count() == 3
    ends = {r.uid: r.valid_to for r in tree.retire(b, spark.createDataFrame([("2",), ("3",)], "uid string"), 7).collect()}
    assert ends == {"1": None, "2": 7, "3": 3, "4": None}


def test_taxonomy_has_no_bounds(spark):
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(105)] + [("x", "y"), ("y", "x"), ("z", "gone")], "uid string, parent string")
    assert sorted((int(r.uid), r.depth) for r in tree.taxonomy(deep).collect()) == [(i, i + 1) for i in range(105)]
    wide = spark.range(1_000_010).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") > 0, "0").alias("parent"))
    assert tree.taxonomy(wide).count() == 1_000_010


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12, unique=True))
def test_midpoints_lie_between(spark, keys):
    b = blocks(spark, [(str(k), None, k, 0, None) for k in keys])
    rows = sorted(tree.midpoints(b).collect(), key=lambda r: int(r.uid))
    for r, nxt in zip(rows, rows[1:], strict=False):
        assert int(r.uid) < r.after < int(nxt.uid) and r.after == nxt.before
    assert rows[-1].after == int(rows[-1].uid) + 2500


def test_list_hosts(spark):
    kinds = ["list", "paragraph", "list", "list", "rule", "list"]
    rows = tree.list_hosts(spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "doc long, i int, kind string"), "doc", "i").orderBy("i").collect()
    assert [r.host for r in rows] == [None, None, 1, 1, None, None]


WALK = "conv_id long, pos long, role string, content_type string, parts array<string>, end_turn boolean"


def walk(spark, rows):
    return spark.createDataFrame([(1, i, r, c, [t], e) for i, (r, c, t, e) in enumerate(rows)], WALK)


def test_fold_golden(spark):
    w = walk(spark, [
        ("user", "text", "q", False), ("assistant", "thoughts", "t1", False), ("assistant", "thoughts", "t2", False), ("assistant", "execution_output", "ignored", False),
        ("assistant", "code", "c", False), ("user", "text", "between", False), ("assistant", "text", "answer", True), ("user", "multimodal_text", "m", False),
        ("critic", "text", "x", False), ("system", "text", "s", False), ("assistant", "text", "lost", False),
    ])
    rows = discussion.fold_messages(w).orderBy("seq").collect()
    assert [(r.kind, r.text, r.n_steps, r.first_pos) for r in rows] == [("user", "q", 0, 0), ("user", "between", 0, 5), ("assistant", "answer", 3, 1), ("system", "contents=text", 0, 9)]
    assert [s.kind for s in rows[2].steps] == ["reflection", "reflection", "code"]
    assert [(r.pos, r.issue) for r in discussion.issues(w).orderBy("pos").collect()] == [(7, "unexpected user content: multimodal_text"), (8, "unknown role: critic")]


def test_fold_twins_agree(spark):
    turn = random.Random(5)
    rows = [
        (c, p, turn.choice(["user", "assistant", "assistant", "system", "tool", "critic"]), turn.choice(["text", "code", "thoughts", "reasoning_recap", "multimodal_text"]), [f"w{turn.random()}", "z"][: turn.randint(0, 2)], turn.random() < 0.3)
        for c in range(120) for p in range(turn.randint(0, 12))
    ]
    w = spark.createDataFrame(rows, WALK)
    a = discussion.fold_messages(w).select("conv_id", "seq", "pos", "kind", "text", "n_steps", "first_pos").collect()
    assert sorted(a) == sorted(discussion.fold_by_rows(w).collect()) and len(a) > 100
    assert discussion.transcript(discussion.fold_messages(w)).count() == len({r.conv_id for r in a})


EXPORT = [
    {
        "title": "t", "create_time": 1.0, "update_time": 2.0, "conversation_id": "c1",
        "mapping": {
            "r": {"id": "r", "children": ["a", "gone"], "parent": None},
            "a": {"id": "a", "parent": "r", "children": ["b", "z"], "message": {"id": "ma", "author": {"role": "User"}, "content": {"content_type": "text", "parts": ["hi", "there"]}, "status": "s", "weight": 1.0, "recipient": "all"}},
            "b": {"id": "b", "parent": "a", "children": [], "message": {"id": "mb", "author": {"role": "assistant"}, "content": {"content_type": "code", "language": "py", "text": "1"}, "status": "s", "weight": 1.0, "recipient": "all"}},
            "z": {"id": "z", "parent": "a", "children": [], "message": {"id": "mz", "author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["bye"]}, "end_turn": True, "status": "s", "weight": 1.0, "recipient": "all"}},
        },
    },
    {"title": "rootless", "create_time": 1.0, "update_time": 2.0, "conversation_id": "c2", "mapping": {"x": {"id": "x", "parent": "y", "children": ["y"]}, "y": {"id": "y", "parent": "x", "children": ["x"]}}},
]


def test_export(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(EXPORT))
    conv = exports.read_export(spark, str(tmp_path / "e.json"))
    assert [(r.conversation_id, r.reason) for r in conversation.rejected(conv).collect()] == [("c2", "no root node")]
    nodes = conversation.nodes(conv.where("conversation_id = 'c1'"))
    order = conversation.walk_order(nodes)
    assert [r.id for r in order.where("issue IS NULL").orderBy("pos").collect()] == ["r", "a", "z", "b"]
    assert [r.id for r in conversation.walk_order(nodes, forward=True).where("issue IS NULL").orderBy("pos").collect()] == ["r", "a", "b", "z"]
    assert [r.issue for r in order.where("issue IS NOT NULL").collect()] == ["missing node: gone"]
    rows = conversation.message_rows(nodes).join(order.select("id", "pos"), "id").where("role IS NOT NULL")
    folded = discussion.fold_messages(rows.withColumn("conv_id", F.lit(1).cast("long"))).orderBy("seq").collect()
    assert [(r.kind, r.text) for r in folded] == [("user", "hi |<part>| there"), ("assistant", "bye")]
    assert conversation.walk_order(conversation.nodes(conv.where("conversation_id = 'c2'"))).count() == 0
    assert [r.id for r in conversation.chain_order(nodes).orderBy("idx").collect()] == ["r", "a", "b"]


def test_access(spark):
    none = None
    users = spark.createDataFrame([(1, 10), (2, 20), (3, none)], "user long, org long")
    members = spark.createDataFrame([(3, 5)], "user long, grp long")
    bindings = spark.createDataFrame([("user", 1, none, none, 1, "tenant", none), ("org", none, none, 20, 1, "domain", "d1"), ("group", none, 5, none, 2, "resource", "x")], "principal string, user long, grp long, org long, role long, scope string, scope_value string")
    permissions = spark.createDataFrame([(1, "edit"), (2, "edit")], "role long, permission string")
    docs = spark.createDataFrame([(100, "d1"), (200, "d2")], "doc long, domain string")
    acl = spark.createDataFrame([(200, "group", none, 5, none, none, ["edit"], none, none), (200, "user", 2, none, none, none, ["view"], none, none)], "doc long, principal string, user long, grp long, org long, role long, rights array<string>, scope string, scope_value string")
    got = {tuple(r) for r in access.can_user(docs, users, members, bindings, permissions, acl, "edit").collect()}
    assert got == {(1, None), (2, 100), (3, 200)}


def test_listing(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k long, v int, x string")
    assert {tuple(r) for r in listing.latest(rows, "k", "v").collect()} == {(1, 2, "b"), (2, 1, None)}
    assert [r.v for r in listing.page(rows, [F.col("k"), F.col("v")], -3, 2).collect()] == [1, 2]
    assert listing.page(rows, [F.col("k"), F.col("v")], 1, -1).count() == 2
    assert listing.next_number(rows.where("k > 5"), "v").first().next == 1
    assert tx.search_terms("The licence of THE sea") == ["licence", "sea"]


PAGE = """<ul><li class="x group/project-item"><a href="/g/p/c/abc-1"><div class="font-medium a"> Title <b>one</b> </div><div class="text-token-text-secondary">sum &amp; up</div><span class="whitespace-nowrap">Feb 29</span></a></li>
<li class="group/project-item"><a href="x"><div class="font-medium">no date</div></a></li><li><div class="font-medium">other</div></li></ul>"""


def test_project_page(spark):
    items = project_page.read_items(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string"), "2026-03-01").collect()
    assert [(r.page_id, r.eid, r.title, r.summary, str(r.last_use)) for r in items] == [(1, "abc-1", "Title one", "sum & up", "2025-02-28")]
    frame = spark.createDataFrame([("abc-1",), ("zz",)], "eid string")
    members, errors = project_page.add_members(spark.createDataFrame([], "label string, eid string"), "g", frame, spark.createDataFrame([("abc-1",)], "eid string"))
    assert [tuple(r) for r in members.collect()] == [("g", "abc-1")] and [r.eid for r in errors.collect()] == ["zz"]


def test_workspace(spark):
    page = {"id": "p", "archived": False, "parent": {"type": "workspace"}, "url": "u", "properties": {"title": {"title": [{"plain_text": "A"}, {"plain_text": "b"}]}}}
    text = lambda t: {"rich_text": [{"plain_text": t}]}
    bs = [{"id": "1", "type": "heading_2", "heading_2": text("H")}, {"id": "2", "type": "code", "code": text("x")}, {"id": "3", "type": "table", "table": {"table_width": 2.7}}, {"id": "4", "type": "odd"}]
    rows = lambda x: workspace.results(spark.createDataFrame([(json.dumps({"object": "list", "results": x, "has_more": False}),)], "value string"))
    assert [tuple(r)[:4] for r in workspace.pages(rows([page])).collect()] == [("p", "Ab", False, "workspace")]
    got = workspace.blocks(rows(bs)).orderBy("id").collect()
    assert [(r.level, r.text, r.language, r.toggleable, r.width, r.error) for r in got] == [(2, "H", None, False, None, None), (None, "x", "plain text", None, None, None), (None, None, None, None, 2, None), (None, None, None, None, None, "unsupported block type: odd")]
    envelopes = {None: {"results": [1, 2], "has_more": True, "next_cursor": "n"}, "n": {"results": [3], "has_more": False}}
    assert list(workspace.fetch_all(envelopes.__getitem__)) == [1, 2, 3]


def test_stream_is_idempotent(spark, tmp_path):
    from lorekeep.streaming import ingest

    source = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "conversation_id string, body string")
    for turn in range(2):
        source.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        ingest.start(stream, "ingested", "body", str(tmp_path / f"ck{turn}")).awaitTermination()
    assert spark.table("ingested").count() == 2
    spark.sql("DROP TABLE ingested")


def test_rights_of_classes(spark, monkeypatch):
    """Users alike are one class, whatever their number; pairs are those of single users, each once."""
    monkeypatch.setattr(access, "CHUNK", 7)
    users = [(u, u % 3) for u in range(90)] + [(5, 7)]
    members = [(u, g) for u, _ in users[:90] for g in {u % 2, u % 5, 900 + u}]
    docs = [(d, f"s{d % 4}") for d in range(60)]
    bindings = [("org", None, None, 1, 0, "domain", "s1"), ("org", None, None, 7, 1, "tenant", None), ("group", None, 3, None, 0, "resource", "17"), ("user", 8, None, None, 0, "tenant", None), ("user", 9, None, None, 1, "domain", "s2")]
    acl = [(d, "group", None, d % 2, None, None, ["edit"], None, None) for d in range(0, 60, 3)] + [(4, "user", 11, None, None, None, ["edit"], None, None), (6, "org", None, None, 7, None, ["edit"], None, None)]
    acl += [(10, "role", None, None, None, 1, ["edit"], None, None), (12, "org", None, None, 2, None, ["view"], None, None)]
    u, m, b = spark.createDataFrame(users, "user long, org long"), spark.createDataFrame(members, "user long, grp long"), spark.createDataFrame(bindings, "principal string, user long, grp long, org long, role long, scope string, scope_value string")
    a = spark.createDataFrame(acl, "doc long, principal string, user long, grp long, org long, role long, rights array<string>, scope string, scope_value string")
    # three kinds of organisation, five sets of the named groups 0, 1 and 3; users 5, 8, 9 and 11 are like no other
    assert access._classes(u, m, b, a).select("class").distinct().count() <= 3 * 5 + 4
    want = set()
    for x, org in users:
        mine = {g for y, g in members if y == x}
        held = [r for r in bindings if (r[0] == "org" and r[3] == org) or (r[0] == "group" and r[2] in mine) or (r[0] == "user" and r[1] == x)]
        want |= {(x, None) for r in held if r[4] == 0 and r[5] == "tenant"}
        for d, dom in docs:
            covers = lambda r, d=d, dom=dom: r[5] == "tenant" or (r[5] == "domain" and r[6] == dom) or (r[5] == "resource" and r[6] == str(d))
            scoped = any(r[4] == 0 and r[5] != "tenant" and covers(r) for r in held)
            own = any(r[0] == d and "edit" in r[6] and ((r[1] == "group" and r[3] in mine) or (r[1] == "user" and r[2] == x) or (r[1] == "org" and r[4] == org) or (r[1] == "role" and any(h[4] == r[5] and covers(h) for h in held))) for r in acl)
            want |= {(x, d)} if scoped or own else set()
    got = access.can_user(spark.createDataFrame(docs, "doc long, domain string"), u, m, b, spark.createDataFrame([(0, "edit"), (1, "view")], "role long, permission string"), a, "edit").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_inserts_broadcast_no_siblings(spark):
    """Keys of relabelled siblings meet the blocks by sorting, however small their estimate is."""
    from lorekeep.operators.placing import insert_after

    rows = blocks(spark, [(str(i), "p", f"0.{i:010d}", 0, None) for i in range(1, 60)])
    put = insert_after(rows, spark.createDataFrame([(f"n{i}", "p", "30", i, "new") for i in range(5)], "uid string, parent string, after string, n int, content string"), 1)
    plan = put._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [uid" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]
    order = [r.uid for r in put.orderBy("seq_pos").collect()]
    assert order == [*map(str, range(1, 31)), *[f"n{i}" for i in range(5)], *map(str, range(31, 60))]


def test_few_pairs_are_unfolded_from_a_row(spark):
    """However large a class, no row unfolds to many pairs, as Spark holds all of them at once; each pair stands in one row."""
    told = spark.range(2000).select(F.col("id").alias("user"), F.lit("c").alias("class")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'c'"))
    rows = access._dealt(told, spark.range(1500).select(F.lit("c").alias("class"), F.col("id").alias("doc")))
    seen = rows.select(F.size("users").alias("u"), F.size("docs").alias("d")).agg(F.max(F.col("u") * F.col("d")), F.sum(F.col("u") * F.col("d"))).first()
    assert seen[0] <= 30_000 and seen[1] == 2001 * 1500
    pairs = rows.select(F.explode("users").alias("u"), "docs").select("u.user", F.explode("docs").alias("doc"))
    assert pairs.distinct().count() == 2001 * 1500 and pairs.where("user IS NULL").count() == 1500
