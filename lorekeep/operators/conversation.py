"""Graphs of messages: decoding exports, walking them, and keeping tables up to date.

An export's conversation has a mapping of nodes, each with a parent, ordered children and perhaps a
message.  Nodes become rows; a walk orders the rows of a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import numbering

#: Root of an exported conversation; else the first node without a parent is it.
ROOT = "client-created-root"

EXPORT_SCHEMA = """conversation_id STRING, title STRING, create_time DOUBLE, update_time DOUBLE, mapping MAP<STRING, STRUCT<id: STRING, parent: STRING, children: ARRAY<STRING>,
  message: STRUCT<id: STRING, author: STRUCT<role: STRING, name: STRING>, create_time: DOUBLE, update_time: DOUBLE, status: STRING, end_turn: BOOLEAN, weight: DOUBLE, recipient: STRING, channel: STRING, content: VARIANT>>>"""


def nodes(conversations: DataFrame) -> DataFrame:
    """(conversation_id, id, parent, children, message) of decoded conversations."""
    rows = conversations.select("conversation_id", F.explode("mapping").alias("key", "node"))
    return rows.select("conversation_id", F.col("node.id").alias("id"), F.col("node.parent").alias("parent"), F.coalesce("node.children", F.array().cast("array<string>")).alias("children"), F.col("node.message").alias("message"))


def rejected(conversations: DataFrame) -> DataFrame:
    """(conversation_id, reason) of conversations without a required field or a root."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("conversation_id", "title", "create_time", "update_time", "mapping")]))
    rootless = ~F.exists(F.map_values("mapping"), lambda n: n["parent"].isNull() | (n["id"] == ROOT))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(rootless, F.lit("no root node"))
    return conversations.select("conversation_id", reason.alias("reason")).where("reason IS NOT NULL")


def message_rows(rows: DataFrame) -> DataFrame:
    """Node rows with role, content_type, parts and end_turn of their messages."""
    m = F.col("message")
    content = m["content"]
    kind = F.expr("try_variant_get(message.content, '$.content_type', 'string')")
    texts = F.expr("try_variant_get(message.content, '$.parts', 'array<string>')")
    one = F.expr("coalesce(try_variant_get(message.content, '$.text', 'string'), try_variant_get(message.content, '$.content', 'string'), try_variant_get(message.content, '$.source_analysis_msg_id', 'string'), try_variant_get(message.content, '$.result', 'string'), try_variant_get(message.content, '$.model_set_context', 'string'))")
    parts = F.when(kind == "text", texts).otherwise(F.array(F.coalesce(one, content.cast("string"), F.lit(""))))
    return rows.select("conversation_id", "id", "parent", "children", F.lower(m["author"]["role"]).alias("role"), kind.alias("content_type"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"), F.coalesce(m["end_turn"], F.lit(False)).alias("end_turn"), m["create_time"].alias("create_time"), m["update_time"].alias("update_time"))


def _roots(rows: DataFrame) -> DataFrame:
    """(conversation_id, root): the node of the export's own root, else the least node without a parent."""
    least = F.struct(F.col("id") != ROOT, "id")
    return rows.where((F.col("id") == ROOT) | F.col("parent").isNull()).groupBy("conversation_id").agg(F.min_by("id", least).alias("root"))


def walk_order(rows: DataFrame, forward: bool = False) -> DataFrame:
    """(conversation_id, id, pos, depth, issue): each conversation's nodes in the order of a walk.

    Siblings come last to first, or first to last if forward is set.  A child that the mapping lacks is an issue
    with no place, and so is a node where it is listed again: it belongs under the node that it names as
    its parent, or else under the first that lists it.  What the root does not lead to is not in the walk.

    Places come from sizes of subtrees (``numbering``), so a conversation may be of any length.
    """
    rows = rows.select("conversation_id", "id", "parent", "children")
    roots = _roots(rows)
    visit = F.col("children") if forward else F.reverse("children")
    listed = rows.select("conversation_id", F.col("id").alias("lister"), F.posexplode(visit).alias("i", "id"))
    known = rows.select("conversation_id", "id", "parent").join(roots, "conversation_id", "left")
    listed = listed.join(known, ["conversation_id", "id"], "left").withColumn("there", F.col("root").isNotNull() & (F.col("root") != F.col("id")))
    claim = Window.partitionBy("conversation_id", "id").orderBy(F.col("lister").eqNullSafe(F.col("parent")).desc(), "lister", "i")
    listed = listed.withColumn("own", F.coalesce("there", F.lit(False)) & (F.row_number().over(claim) == 1))
    key = lambda at, again: F.struct("conversation_id", at.alias("id"), again.alias("again"))
    none = F.lit("")
    # a node stands under its own key, a mention without a place under one of its own
    listed = listed.withColumn("key", F.when(F.col("own"), key(F.col("id"), none)).otherwise(key(F.col("id"), F.concat("lister", F.lit("#"), "i"))))
    below = listed.select("key", key(F.col("lister"), none).alias("parent"), F.col("own").cast("int").alias("counted"), "i")
    tops = roots.select(key(F.col("root"), none).alias("key"), F.lit(None).cast(below.schema["parent"].dataType).alias("parent"), F.lit(1).alias("counted"), F.lit(0).alias("i"))
    work = numbering.Rounds(rows.sparkSession, "walk")
    nodes, _ = work.write(below.unionByName(tops))
    sizes, _ = work.write(numbering.subtrees(nodes.select(F.col("key").alias("id"), "parent", "counted"), "walk").where("NOT closed"))
    # within the list of one node's children
    earlier = F.sum("size").over(Window.partitionBy("parent").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    paths = nodes.join(sizes, F.col("key") == F.col("id")).where(F.col("parent").isNotNull()).select("key", "parent", "counted", earlier.alias("earlier"))
    paths = paths.unionByName(tops.select("key", "parent", "counted", F.lit(0).cast("long").alias("earlier")))
    paths = paths.select(F.col("key").alias("id"), F.col("parent").alias("before"), (F.coalesce("earlier", F.lit(0)) + F.col("counted")).alias("pre"))
    placed = numbering.ranked(paths, ["pre"], "walk").select("id", "pre")
    walk = sizes.join(tops.select(F.col("key").alias("head")), "head", "left_semi").join(placed, "id")
    walk = walk.select("pre", "depth", F.col("id.conversation_id").alias("conversation_id"), F.col("id.id").alias("id"), F.col("id.again").alias("again"))
    there = rows.select("conversation_id", "id", F.lit(True).alias("there"))
    told = walk.select("conversation_id", "id", "pre", "depth", "again").join(there, ["conversation_id", "id"], "left")
    issue = F.when(F.col("there").isNull(), F.concat(F.lit("missing node: "), "id")).when(F.col("again") != "", F.concat(F.lit("cycle at node: "), "id"))
    return told.select("conversation_id", "id", F.when(issue.isNull(), F.col("pre")).alias("pos"), F.col("depth").cast("int").alias("depth"), issue.alias("issue"))


def chain_order(rows: DataFrame) -> DataFrame:
    """(conversation_id, id, idx, issue): the chain that goes to the least child at each step, from 0; where steps to
    the least child come back to themselves a row without a place tells so, with the least node there.

    The chain is ranked by pointer doubling: one of n nodes takes log2(n) joins.
    """
    rows = rows.select("conversation_id", "id", "parent")
    key = lambda c: F.struct("conversation_id", F.col(c).alias("id"))
    steps = rows.where("parent IS NOT NULL").groupBy("conversation_id", "parent").agg(F.min("id").alias("id"))
    least = steps.select("conversation_id", "id", F.col("parent").alias("before"))
    links = rows.select("conversation_id", "id").distinct().join(least, ["conversation_id", "id"], "left")
    links = links.select(key("id").alias("id"), F.when(F.col("before").isNotNull(), key("before")).alias("before"), F.lit(1).cast("long").alias("n"))
    found = numbering.ranked(links, ["n"], "chain")
    first = rows.where("parent IS NULL").groupBy("conversation_id").agg(F.min("id").alias("root"))
    found = found.select(F.col("id.conversation_id").alias("conversation_id"), F.col("id.id").alias("id"), F.col("head.id").alias("head"), "closed", "n")
    chain = found.where("NOT closed").join(first, "conversation_id").where("head = root").select("conversation_id", "id", (F.col("n") - 1).alias("idx"), F.lit(None).cast("string").alias("issue"))
    back = found.where("closed").groupBy("conversation_id").agg(F.min("id").alias("id"))
    return chain.unionByName(back.select("conversation_id", "id", F.lit(None).cast("long").alias("idx"), F.concat(F.lit("cycle at node: "), "id").alias("issue")))


def orphans(rows: DataFrame) -> DataFrame:
    """Nodes whose parent is not among the nodes of their conversation."""
    parents = rows.select("conversation_id", F.col("id").alias("parent"))
    return rows.where("parent IS NOT NULL").join(parents, ["conversation_id", "parent"], "left_anti").select("conversation_id", "id", "parent")


def new_conversations(incoming: DataFrame, existing: DataFrame, key: str = "title") -> DataFrame:
    """Incoming conversations that the tables lack, by title or by another key."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti").select(*incoming.columns)


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return candidates.join(done.select(key), key, "left_anti").select(*candidates.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of its own of the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def incremental_tail(chain: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the chain beyond the largest stored seqnbr of their conversation (-1 without one)."""
    most = stored.groupBy("conversation_id").agg(F.max("seqnbr").alias("most"))
    return chain.join(most, "conversation_id", "left").where(F.col("idx") > F.coalesce("most", F.lit(-1))).drop("most")


def with_children(rows: DataFrame) -> DataFrame:
    """Rows of the stored form (parent only) with the ids of their children in order."""
    below = rows.where("parent IS NOT NULL").groupBy("conversation_id", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    return rows.join(below, ["conversation_id", "id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def numbered_in(rows: DataFrame, group: str, order: str, name: str = "seqnbr") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
