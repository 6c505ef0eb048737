"""Placing blocks, replaying events, and following a workspace."""

import decimal
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import conversation, events, numbering, placing, tree
from lorekeep.sources import workspace

D = decimal.Decimal
BLOCK = "uid string, parent string, seq_pos decimal(38,10), content string, valid_from long, valid_to long"


def order_of(rows):
    return [r.uid for r in rows.orderBy("seq_pos").collect()]


def test_ten_thousand_inserts_at_one_place(spark):
    """Twice 5,000 blocks, each time right behind the first: the gap runs out and the order holds."""
    blocks = spark.createDataFrame([("a", "p", D("0.001"), "c", 0, None), ("b", "p", D("0.002"), "c", 0, None), ("z", "p", D(5), "c", 0, 3), ("o", "q", D(1), "c", 0, None)], BLOCK)
    expected, moved = ["a", "b", "z"], 0
    for k in range(2):
        put = spark.range(5000).select(F.concat(F.lit(f"{k}-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("uid"), F.lit("p").alias("parent"), F.lit("a").alias("after"), F.col("id").alias("n"), F.lit("new").alias("content"))
        found = placing.insert_after(blocks, put, k + 1)
        rows = found.select("uid", "parent", "seq_pos", "content", "valid_from", "valid_to", "relabelled").collect()
        moved += sum(r.relabelled for r in rows)
        blocks = spark.createDataFrame([tuple(r)[:6] for r in rows], BLOCK)
        expected = ["a", *[f"{k}-{i:05d}" for i in range(5000)], *expected[1:]]
        assert order_of(blocks.where("parent = 'p'")) == expected
        assert blocks.where("parent = 'p'").select("seq_pos").distinct().count() == len(expected)
    assert 0 < moved < 3 * len(expected) and blocks.where("uid = 'o'").first().seq_pos == 1
    assert blocks.where("uid = 'z'").first().valid_to == 3


def test_inserts_at_several_places(spark):
    blocks = spark.createDataFrame([(str(i), "p", D(i), "c", 0, None) for i in range(1, 6)] + [("r", None, D(1), "c", 0, None)], BLOCK)
    put = spark.createDataFrame([("x", "p", None, 1), ("y", "p", "5", 1), ("w", "p", "3", 2), ("v", "p", "3", 1), ("s", None, "r", 1), ("lost", "p", "r", 1), ("first", "new", None, 1)], "uid string, parent string, after string, n int")
    found = placing.insert_after(blocks, put.withColumn("content", F.lit("n")), 4)
    assert order_of(found.where("parent = 'p'")) == ["x", "1", "2", "3", "v", "w", "4", "5", "y"] and order_of(found.where("parent IS NULL")) == ["r", "s"]
    assert found.where("relabelled").count() == 0 and found.where("uid = 'lost'").count() == 0 and found.where("uid = 'first'").count() == 1
    assert placing.insert_after(blocks, put.limit(0).withColumn("content", F.lit("n")), 4).count() == 6


def test_long_chains(spark):
    """A chain of 50,000 nodes with a cycle beside it: the rounds follow the logarithm."""
    n = 50_000
    rows = spark.range(n).select(F.lit("c").alias("conversation_id"), F.format_string("%06d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("%06d", F.col("id") - 1)).alias("parent"))
    rows = rows.unionByName(spark.createDataFrame([("d", "x", "y"), ("d", "y", "x"), ("d", "r", None)], "conversation_id string, id string, parent string"))
    chain = conversation.chain_order(rows)
    assert chain.where("conversation_id = 'c' AND idx = cast(id AS long)").count() == n
    assert [(r.id, r.idx, r.issue) for r in chain.where("conversation_id = 'd'").orderBy("id").collect()] == [("r", 0, None), ("x", None, "cycle at node: x")]


def test_walk_of_odd_graphs(spark):
    rows = spark.createDataFrame([
        ("c", "r", None, ["a", "b", "gone"]), ("c", "a", "r", ["x", "r"]), ("c", "b", "r", ["x"]), ("c", "x", "b", []), ("c", "u", None, ["v"]), ("c", "v", "u", []), ("e", "only", "lost", []),
    ], "conversation_id string, id string, parent string, children array<string>")
    got = [(r.id, r.pos, r.depth, r.issue) for r in conversation.walk_order(rows, forward=True).orderBy("depth", "id", "issue").collect()]
    assert got == [("r", 1, 1, None), ("a", 2, 2, None), ("b", 3, 2, None), ("gone", None, 2, "missing node: gone"), ("r", None, 3, "cycle at node: r"), ("x", 4, 3, None), ("x", None, 3, "cycle at node: x")]
    assert {r.id: r.pos for r in conversation.walk_order(rows).where("issue IS NULL").collect()} == {"r": 1, "b": 2, "x": 3, "a": 4}


def test_numbers_of_many_siblings(spark):
    """Ranges part a group of siblings and several trees."""
    nodes = spark.range(400).select(F.col("id"), F.when(F.col("id") >= 3, (F.col("id") % 3)).alias("parent"), (F.col("id") * 7 % 400).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r for r in numbering.numbered(nodes, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at, place = 0, {}
    for top in sorted(range(3), key=lambda i: i * 7 % 400):
        for i in [top, *sorted((i for i in range(3, 400) if i % 3 == top), key=lambda i: i * 7 % 400)]:
            at += 1
            place[i] = at
    assert {i: r.place for i, r in got.items()} == place and got[0].n_below == 133 and got[5].depth == 2 and got[5].head == 2


def test_moves_under_oneself(spark):
    blocks = spark.createDataFrame([("r", None, D(1), "c", 0, None), ("a", "r", D(1), "c", 0, None), ("b", "a", D(1), "c", 0, None), ("s", "r", D(2), "c", 0, None), ("old", "r", D(3), "c", 0, 2)], BLOCK)
    moves = spark.createDataFrame([("a", "a2", "b", 1), ("b", "b2", "s", 1), ("s", "s2", "s", 1), ("s", "s3", "old", 1), ("none", "n2", "r", 1)], "uid string, new_uid string, new_parent string, new_pos int")
    assert sorted((r.new_uid, r.reason) for r in tree.refused_moves(blocks, moves, 5).collect()) == [("a2", "below itself"), ("n2", "no such block"), ("s2", "below itself"), ("s3", "no live parent")]
    after = tree.move(blocks, moves, 5)
    assert after.where("uid IN ('a2', 'n2', 's2', 's3')").count() == 0 and after.where("uid = 'b2'").first().parent == "s" and tree.depth_first(after, 5).count() == 4


def test_replay(spark):
    made = spark.createDataFrame([("d1", 1, "t1", "a", False), ("d2", 2, "t2", "b", False)], "doc string, seq long, title string, owner string, deleted boolean")
    log = events.union(
        events.event_rows(made, "document", "doc", "seq", "create", ["title", "owner", "deleted"]),
        events.event_rows(spark.createDataFrame([("d1", 3, "t9")], "doc string, seq long, title string"), "document", "doc", "seq", "update", ["title"]),
        events.event_rows(spark.createDataFrame([("d2", 4, True)], "doc string, seq long, deleted boolean"), "document", "doc", "seq", "update", ["deleted"]),
        events.event_rows(spark.createDataFrame([("g1", 2, "d1", "u", ["edit"]), ("g2", 2, "d1", "v", ["view"])], "k string, seq long, doc string, principal string, rights array<string>"), "acl", "k", "seq", "create", ["doc", "principal", "rights"]),
        events.event_rows(spark.createDataFrame([("g2", 5)], "k string, seq long"), "acl", "k", "seq", "delete", []),
        events.event_rows(spark.createDataFrame([("c1", 3, "d1", "hi"), ("c2", 4, "d1", "ho"), ("c3", 4, "d2", "no")], "k string, seq long, doc string, text string"), "comment", "k", "seq", "create", ["doc", "text"]),
    )
    state = {r.key: (r.title, r.owner, r.created, r.updated) for r in events.document_state(log).collect()}
    assert state == {"d1": ("t9", "a", 1, 3)} and {r.key for r in events.document_state(log, 3).collect()} == {"d1", "d2"} == {r.key for r in events.document_state(log, deleted=True).collect()}
    assert events.document_state(log, 2).where("key = 'd1'").first().title == "t1"
    assert [(r.key, r.principal) for r in events.rights(log).collect()] == [("g1", "u")] and events.rights(log, 4).count() == 2
    assert [r.text for r in events.comments(log, "d1").collect()] == ["ho", "hi"]
    blocks = spark.createDataFrame([("a", None, D(1), "x", 0, 3), ("a", "b", D(2), "y", 3, None), ("b", None, D(3), "z", 1, 1), ("c", None, D(4), "w", 2, 5)], BLOCK)
    for seq in range(7):
        now = sorted((r.uid, r.parent, r.content) for r in tree.as_of(blocks, seq).collect())
        assert sorted((r.key, r.parent, r.content) for r in events.replay(events.block_events(blocks), "block", seq).collect()) == now
    with pytest.raises(ValueError):
        events.event_rows(made, "document", "doc", "seq", "burn", [])


def edited(since, cursor, place):
    """An interface over a file of [id, time]: two results a page, the oldest edit first."""
    every = sorted((t, i) for i, t in json.loads(Path(place).read_text()) if since is None or t >= since)
    at = int(cursor or 0)
    found = [{"id": i, "last_edited_time": t} for t, i in every[at : at + 2]]
    return {"results": found, "has_more": at + 2 < len(every), "next_cursor": str(at + 2)}


def test_following_a_workspace(spark, tmp_path):
    api, seen, stop = tmp_path / "api.json", tmp_path / "seen", [1]
    spark.dataSource.register(workspace.WorkspaceSource)

    def take(rows, number):
        if number == stop[0]:  # the run ends before the batch is written
            stop[0] = None
            raise RuntimeError("gone")
        rows.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    def follow():
        stream = spark.readStream.format("workspace").option("fetcher", "tests.test_changes:edited").option("argument", str(api)).option("pages", 2).load()
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    pages = [[f"p{i}", f"t{i // 3}"] for i in range(11)]
    api.write_text(json.dumps(pages))
    with pytest.raises(Exception, match="gone"):
        follow()
    follow()
    read = lambda: sorted(json.loads(r.value)["id"] for r in spark.read.schema("value string, batch int").parquet(str(seen)).collect())
    assert read() == sorted(p for p, _ in pages)
    api.write_text(json.dumps([*pages, ["p11", "t3"], ["p12", "t9"]]))  # one more of the last time, and a later one
    follow()
    assert read() == sorted([p for p, _ in pages] + ["p11", "p12"])
    api.write_text(json.dumps([["p0", "ta"], *pages[1:], ["p11", "t3"], ["p12", "t9"]]))  # edited again
    follow()
    assert read().count("p0") == 2 and len(read()) == 14


def test_table_functions(spark):
    """Called from SQL, they give what the operators give."""
    from lorekeep.functions import table

    table.register(spark)
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr("cast(conv_id AS string) AS conversation_id", "concat('t', lpad(turn, 3, '0')) AS id", "CASE WHEN turn > 0 THEN concat('t', lpad(turn - 1, 3, '0')) END AS parent")
    rows.createOrReplaceTempView("nodes")
    got = spark.sql("SELECT * FROM chain_order(TABLE(nodes) PARTITION BY conversation_id)")
    assert sorted(map(tuple, got.collect())) == sorted((r.conversation_id, r.id, r.idx) for r in conversation.chain_order(rows).collect())
    blocks = spark.createDataFrame([(f"{d}-{i}", f"{d}-{(i - 1) // 3}" if i else None, D(i * 7 % 11), "c", 0, None, d) for d in "xy" for i in range(30)], BLOCK + ", doc string")
    blocks.createOrReplaceTempView("blocks")
    got = sorted(map(tuple, spark.sql("SELECT doc, uid, depth, place, n_below FROM walk_blocks(TABLE(blocks) PARTITION BY doc)").collect()))
    assert got == sorted((d, r.uid, r.depth, r.place, r.n_below) for d in "xy" for r in tree.depth_first(blocks.where(F.col("doc") == d), 0).collect())
