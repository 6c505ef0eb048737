"""Inserting blocks between siblings, with keys that never run out.

Keys are DECIMAL(38,10), and halving a gap again and again uses it up after some forty times.  ``insert_after``
spreads all blocks that are inserted at one place evenly over the gap there; where a gap is too narrow for them,
the smallest run of siblings around it that has room is given new keys, evenly over the run's ends.  Runs double until
they fit, so their search takes a logarithm of the siblings in joins, and what is rewritten stays near the place.

Siblings are ranked without a sort of them in one task (``numbering.sums_before``).  Retired rows keep their places
like live ones.  Keys are counted with up to 14 digits before the point; longer ones are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.numbering import Rounds, sums_before
from lorekeep.operators.tree import KEY

#: Gap that a run must leave between its blocks, and the room for each block behind the last sibling.
LEAST_GAP, STEP = "0.0000010000", 1000
_SUM = "decimal(24,10)"


def insert_after(blocks: DataFrame, inserts: DataFrame, seq: int) -> DataFrame:
    """blocks with those of inserts (uid, parent, after, n, content), and relabelled, whether a block that was there
    has got another key.

    after is the sibling behind which a block goes, null for the first place; blocks at one place come in the
    order of n and uid.  An insert behind a block that is no sibling there is left out.
    """
    work = Rounds(blocks.sparkSession, "placing")
    live = blocks.withColumn("one", F.lit(1))
    ranks = sums_before(live.select("uid", "parent", "seq_pos", "one"), "parent", ["seq_pos", "uid"], "one")
    ranks, _ = work.write(ranks.select("uid", "parent", F.col("seq_pos").cast(_SUM).alias("key"), (F.col("before") + 1).alias("rank")))
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]

    hosts = ranks.join(inserts.select("parent", F.col("after").alias("uid")).where("uid IS NOT NULL").distinct().alias("i"), ranks["uid"].eqNullSafe(F.col("i.uid")) & ranks["parent"].eqNullSafe(F.col("i.parent")), "left_semi")
    wanted = inserts.alias("i").join(hosts.alias("r"), [F.col("i.after") == F.col("r.uid"), *same("i", "r", "parent")], "left")
    wanted = wanted.where("i.after IS NULL OR r.uid IS NOT NULL").select("i.*", F.coalesce("r.rank", F.lit(0)).alias("rank"))
    number = F.row_number().over(Window.partitionBy("parent", "rank").orderBy("n", "uid"))
    wanted, _ = work.write(wanted.withColumn("nth", number))

    # a run holds the siblings of ranks from low + 1 to high - 1; at first the gap itself, which has none
    gaps = wanted.groupBy("parent", "rank").agg(F.count("*").alias("m")).select("parent", "rank", "m", F.col("rank").alias("low"), (F.col("rank") + 1).alias("high"), F.lit(False).alias("fits"), F.lit(None).cast(_SUM).alias("left_key"), F.lit(None).cast(_SUM).alias("right_key"))
    ends = ranks.groupBy("parent").agg(F.max("rank").alias("last"), F.max("key").alias("last_key"))
    open_, width = gaps, 0
    done = []
    while True:
        width = max(1, 2 * width)
        # the siblings at the runs' ends, so that what the runs meet is no larger than they are
        ends_ = open_.select(F.col("parent").alias("_p"), F.explode(F.array("low", "high")).alias("_r")).distinct()
        near = ranks.join(ends_, ranks["parent"].eqNullSafe(F.col("_p")) & (ranks["rank"] == F.col("_r")), "left_semi")
        at = lambda name, key: near.select(F.col("parent").alias(f"{name}_p"), F.col("rank").alias(f"{name}_r"), F.col("key").alias(key))
        found = open_.drop("left_key", "right_key", "fits")
        found = found.join(at("l", "left_key"), F.col("parent").eqNullSafe(F.col("l_p")) & (F.col("low") == F.col("l_r")), "left").join(at("h", "right_key"), F.col("parent").eqNullSafe(F.col("h_p")) & (F.col("high") == F.col("h_r")), "left")
        found = found.alias("g").join(ends.alias("e"), same("g", "e", "parent"), "left").select("g.*", F.coalesce("last_key", F.lit(0).cast(_SUM)).alias("last_key"))
        n = F.col("high") - F.col("low") - 1 + F.col("m")  # blocks that the run must hold
        right = F.coalesce("right_key", (F.col("last_key") + (n + 1) * STEP).cast(_SUM))
        left = F.coalesce("left_key", F.lit(0).cast(_SUM))
        room = (right - left) / (n + 1)
        whole = (F.col("low") <= 0) & F.col("right_key").isNull()
        judged = found.select("parent", "rank", "m", "low", "high", ((room >= F.lit(LEAST_GAP).cast(_SUM)) | whole).alias("fits"), left.alias("left_key"), right.alias("right_key"))
        judged, seen = work.write(judged, left=~F.col("fits"))
        done.append(judged.where("fits"))
        if not seen["left"]:
            break
        open_ = judged.where("NOT fits").withColumn("low", F.greatest(F.col("rank") - width, F.lit(0))).withColumn("high", F.col("rank") + 1 + width)
    runs = done[0]
    for more in done[1:]:
        runs = runs.unionByName(more)

    # runs of one parent that meet become one
    order = Window.partitionBy("parent").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("new", F.coalesce((F.col("low") + 1 >= reach).cast("int"), F.lit(1)))
    named = begun.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = named.groupBy("parent", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("left_key").alias("left_key"), F.max("right_key").alias("right_key"))
    spans, _ = work.write(spans)
    inner = spans.where("high > low + 1").select("parent", "run", "left_key", "right_key", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1)).alias("rank"))
    # an estimate knows the spans and not their places: without the hint all places would be broadcast
    moved = inner.hint("merge").alias("s").join(ranks.alias("r"), same("s", "r", "parent", "rank")).select("r.uid", "s.parent", "s.run", "s.left_key", "s.right_key", "s.rank", F.lit(0).alias("nth"))
    by_gap = named.select("parent", "rank", "run").alias("g").join(spans.alias("s"), same("g", "s", "parent", "run")).select("g.parent", "g.rank", "s.run", "s.left_key", "s.right_key")
    put = wanted.alias("w").join(by_gap.alias("g"), same("w", "g", "parent", "rank")).select("w.uid", "w.parent", "g.run", "g.left_key", "g.right_key", "w.rank", "w.nth")
    within = Window.partitionBy("parent", "run")
    i, size = F.row_number().over(within.orderBy("rank", "nth")), F.count("*").over(within) + 1
    part = ((F.col("right_key") - F.col("left_key")) * i.cast("decimal(10,0)")).cast("decimal(34,10)") / size.cast("decimal(10,0)")
    keys = moved.unionByName(put).select("uid", (F.col("left_key") + part).cast(KEY).alias("_key"))
    keys, _ = work.write(keys)

    kept = blocks.join(keys.hint("merge"), "uid", "left").withColumn("relabelled", F.col("_key").isNotNull()).withColumn("seq_pos", F.coalesce("_key", F.col("seq_pos").cast(KEY))).select(*blocks.columns, "relabelled")
    none = F.lit(None)
    given = {"valid_from": F.lit(seq).cast("long"), "valid_to": none.cast("long"), "relabelled": F.lit(False)}
    fresh = wanted.drop("seq_pos").join(keys, "uid").withColumn("seq_pos", F.col("_key"))
    columns = [given[c].alias(c) if c in given else F.col(c) if c in fresh.columns else none.cast(blocks.schema[c].dataType).alias(c) for c in kept.columns]
    return kept.unionByName(fresh.select(*columns))
