"""Ordered trees of blocks with validity: walks, snapshots, positions and changes.

Blocks: uid, parent (null for a root), seq_pos DECIMAL(38,10), content, valid_from, valid_to.
Walks number the trees (``numbering``), so their joins grow with the logarithm of the depth.

What changes blocks gives the new blocks; ``change_events`` tells what was done to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.numbering import ancestry, numbered

KEY = "decimal(38,10)"


def alive(seq: int) -> Column:
    """Valid as of a sequence number: from it on, and not yet retired."""
    return (F.col("valid_from") <= seq) & (F.col("valid_to").isNull() | (F.col("valid_to") > seq))


def as_of(blocks: DataFrame, seq: int) -> DataFrame:
    return blocks.where(alive(seq))


def snapshot(blocks: DataFrame, seq: int) -> DataFrame:
    return as_of(blocks, seq).orderBy(F.asc_nulls_first("parent"), "seq_pos")


def placed(blocks: DataFrame, seq: int) -> DataFrame:
    """(uid, place, n_below, depth) of the blocks that are live at seq and hang below a live root: the walk of all
    of them in depth-first order, siblings by key.  Below block b are those with b.place < place <= b.place + b.n_below."""
    live = as_of(blocks, seq).select(F.col("uid").alias("id"), "parent", "seq_pos")
    roots = live.where("parent IS NULL").select(F.col("id").alias("head"))
    return numbered(live, ["seq_pos"], "walk").join(roots, "head", "left_semi").select(F.col("id").alias("uid"), "place", "n_below", "depth")


def depth_first(blocks: DataFrame, seq: int, start: str | None = None, max_depth: int | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(depth, uid, parent, content, seq_pos, place, n_below, has_more) of the live blocks below start, or from the
    roots on; place is that in depth-first order, from 1, among all of them.  has_more: blocks lie below max_depth.

    offset and limit choose a range of places, as the walk without max_depth counts them.
    """
    live = as_of(blocks, seq).select("uid", "parent", "content", "seq_pos")
    places = placed(blocks, seq)
    rows = places.join(live, "uid")
    if start is not None:
        above = places.where(F.col("uid") == start).select(F.col("place").alias("_place"), F.col("n_below").alias("_n"), F.col("depth").alias("_depth"))
        rows = rows.join(F.broadcast(above), (F.col("place") > F.col("_place")) & (F.col("place") <= F.col("_place") + F.col("_n")))  # one row
        rows = rows.withColumn("place", F.col("place") - F.col("_place")).withColumn("depth", F.col("depth") - F.col("_depth"))
    if max_depth is not None:
        rows = rows.where(F.col("depth") <= max_depth)
    if offset > 0:
        rows = rows.where(F.col("place") > offset)
    if limit is not None and limit >= 0:
        rows = rows.where(F.col("place") <= max(offset, 0) + limit)
    more = F.lit(False) if max_depth is None else (F.col("depth") == max_depth) & (F.col("n_below") > 0)
    return rows.select(F.col("depth").cast("int").alias("depth"), "uid", "parent", "content", "seq_pos", "place", "n_below", more.alias("has_more"))


def taxonomy(nodes: DataFrame) -> DataFrame:
    """(uid, parent, depth) from the roots on, for any depth and any number of nodes."""
    above = ancestry(nodes.select(F.col("uid").alias("id"), "parent"), "taxonomy").where("NOT closed")
    roots = nodes.where("parent IS NULL").select(F.col("uid").alias("head"))
    found = above.join(roots, "head", "left_semi").select(F.col("id").alias("uid"), "depth")
    return nodes.select("uid", "parent").join(found, "uid").select("uid", "parent", "depth")


def cycles(nodes: DataFrame) -> DataFrame:
    """(uid) of nodes (uid, parent) that stand below themselves or below one that does: no walk reaches them."""
    return ancestry(nodes.select(F.col("uid").alias("id"), "parent"), "cycles").where("closed").select(F.col("id").alias("uid"))


def resequenced(blocks: DataFrame, step: int = 10000) -> DataFrame:
    """Siblings at step, 2 * step..; retired rows count too."""
    order = Window.partitionBy("parent").orderBy("seq_pos", "uid")
    return blocks.withColumn("seq_pos", (F.row_number().over(order) * step).cast(KEY))


def append_positions(blocks: DataFrame) -> DataFrame:
    """(parent, next_pos): where a child appended to each parent goes."""
    return blocks.groupBy("parent").agg((F.coalesce(F.max("seq_pos"), F.lit(0)) + 1000).cast(KEY).alias("next_pos"))


def midpoints(blocks: DataFrame) -> DataFrame:
    """(uid, parent, before, after): keys of a block put before or after each block.  Before the first
    the left key is 0; after the last the right key is the left one plus 5000.  Retired rows count."""
    order = Window.partitionBy("parent").orderBy("seq_pos", "uid")
    left, right = F.lag("seq_pos").over(order), F.lead("seq_pos").over(order)
    pos = F.col("seq_pos")
    return blocks.select("uid", "parent", ((F.coalesce(left, F.lit(0)) + pos) / 2).cast(KEY).alias("before"), ((pos + F.coalesce(right, pos + 5000)) / 2).cast(KEY).alias("after"))


def retire(blocks: DataFrame, uids: DataFrame, seq: int) -> DataFrame:
    """blocks with the live ones among uids ended at seq; what is below them keeps its own validity."""
    hit = uids.select("uid", F.lit(True).alias("hit")).distinct()
    end = F.when(F.col("hit") & F.col("valid_to").isNull(), F.lit(seq).cast("long")).otherwise(F.col("valid_to"))
    return blocks.join(hit, "uid", "left").withColumn("valid_to", end).select(*blocks.columns)


def move(blocks: DataFrame, moves: DataFrame, seq: int) -> DataFrame:
    """Blocks retired at seq and put anew under another parent: moves (uid, new_uid, new_parent, new_pos), but
    those that ``refused_moves`` tells."""
    moves = moves.join(refused_moves(blocks, moves, seq).select("uid", "new_uid"), ["uid", "new_uid"], "left_anti")
    old = retire(blocks, moves, seq)
    fresh = moves.join(blocks, "uid").select(F.col("new_uid").alias("uid"), F.col("new_parent").alias("parent"), F.col("new_pos").cast(KEY).alias("seq_pos"), "content", F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return old.unionByName(fresh)


def refused_moves(blocks: DataFrame, moves: DataFrame, seq: int) -> DataFrame:
    """(uid, new_uid, new_parent, reason) of moves that cannot be made: of a block that is not there, to a parent that
    is not live, or under the block itself or what lies below it."""
    there = lambda rows, name: rows.select(F.col("uid").alias(name), F.lit(True).alias(f"_{name}")).distinct()
    places = placed(blocks, seq)
    own = places.select("uid", "place", "n_below")
    target = places.select(F.col("uid").alias("new_parent"), F.col("place").alias("_to"))
    rows = moves.join(there(blocks, "uid"), "uid", "left").join(there(as_of(blocks, seq), "new_parent"), "new_parent", "left").join(own, "uid", "left").join(target, "new_parent", "left")
    within = (F.col("uid") == F.col("new_parent")) | ((F.col("_to") >= F.col("place")) & (F.col("_to") <= F.col("place") + F.col("n_below")))
    reason = F.when(F.col("_uid").isNull(), "no such block").when(F.col("new_parent").isNotNull() & F.col("_new_parent").isNull(), "no live parent").when(within, "below itself")
    return rows.select("uid", "new_uid", "new_parent", reason.alias("reason")).where("reason IS NOT NULL")


def first_root(blocks: DataFrame) -> DataFrame:
    """(doc, uid) of each document's first live root."""
    roots = blocks.where("parent IS NULL AND valid_to IS NULL")
    return roots.groupBy("doc").agg(F.min_by("uid", F.struct("seq_pos", "uid")).alias("uid"))


def last_children(blocks: DataFrame) -> DataFrame:
    """(parent, uid) of the last live child of each parent; of the roots with a null parent."""
    return blocks.where("valid_to IS NULL").groupBy("parent").agg(F.max_by("uid", F.struct("seq_pos", "uid")).alias("uid"))


def missing_roots(docs: DataFrame, blocks: DataFrame, seq: int) -> DataFrame:
    """A root block for each document (doc) that has no live one."""
    rootless = docs.select("doc").distinct().join(first_root(blocks), "doc", "left_anti")
    none = F.lit(None).cast("string")
    return rootless.select(F.concat(F.col("doc").cast("string"), F.lit("#root")).alias("uid"), none.alias("parent"), "doc", F.lit(1_000_000).cast(KEY).alias("seq_pos"), F.lit("document").alias("kind"), F.lit("TEST DOC").alias("content"), F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))


def appended(blocks: DataFrame, children: DataFrame, seq: int) -> DataFrame:
    """Blocks for children (uid, parent, place, content) behind the live ones of their parents, 1000 apart in
    the order of place; a null parent stands for the roots."""
    last = blocks.where("valid_to IS NULL").groupBy("parent").agg(F.max("seq_pos").alias("last")).withColumnRenamed("parent", "of")
    order = Window.partitionBy("parent").orderBy("place", "uid")
    rows = children.withColumn("n", F.row_number().over(order)).join(last, F.col("parent").eqNullSafe(F.col("of")), "left")
    pos = (F.coalesce("last", F.lit(0)) + F.col("n") * 1000).cast(KEY)
    return rows.select("uid", "parent", pos.alias("seq_pos"), "content", F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))


def change_events(before: DataFrame, after: DataFrame, actor: int) -> DataFrame:
    """(uid, event_type, event_data, actor): inserts and deletions that lead from one state of blocks to the next."""
    old = before.select("uid", F.col("valid_to").alias("old_to"), F.lit(True).alias("known"))
    rows = after.join(old, "uid", "left")
    inserted, ended = F.col("known").isNull(), F.col("old_to").isNull() & F.col("valid_to").isNotNull()
    data = F.when(inserted, F.to_json(F.struct(F.col("valid_from").alias("sequence"), "parent", "seq_pos"))).otherwise(F.to_json(F.struct(F.col("valid_to").alias("sequence"))))
    return rows.where(inserted | ended).select("uid", F.when(inserted, "insert").otherwise("delete").alias("event_type"), data.alias("event_data"), F.lit(actor).alias("actor"))


def stamped(labels: DataFrame, docs: DataFrame, label: str, seq: int) -> DataFrame:
    """labels (doc, label, seq) with a label for each of docs at this sequence number."""
    return labels.select("doc", "label", "seq").unionByName(docs.select("doc", F.lit(label).alias("label"), F.lit(seq).cast("long").alias("seq")))


def block_stats(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, n_blocks, kinds): how many blocks each document has, and their kinds in order."""
    return blocks.groupBy(doc).agg(F.count("*").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def preorder(rows: DataFrame, doc: str, path: str) -> DataFrame:
    """rows with uid 1..n in the order of their paths within a document."""
    return rows.withColumn("uid", F.row_number().over(Window.partitionBy(doc).orderBy(path)))


def list_hosts(blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """blocks with host: a list hangs under the paragraph or heading before it; lists in a row share one."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # the last block that is no list; none if another kind than a paragraph or heading comes between
    last = F.last(F.when(F.col("kind") != "list", F.struct("kind", F.col(order).alias("at"))), ignorenulls=True).over(before)
    return blocks.withColumn("_l", last).withColumn("host", F.when((F.col("kind") == "list") & F.col("_l.kind").isin("paragraph", "heading"), F.col("_l.at"))).drop("_l")


def item_hosts(items: DataFrame, doc: str, order: str, level: str, levels: int = 9) -> DataFrame:
    """items with host: the last item before of a lower level, under which a nested list puts it; null at the top.

    Word has nine levels; the last item of each is carried along, so a document is sorted once and never joined
    with itself.
    """
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before) for k in range(levels - 1)]
    lower = [F.when(F.col(level) > k, c) for k, c in enumerate(last)]
    return items.withColumn("host", F.greatest(*lower) if len(lower) > 1 else lower[0])
