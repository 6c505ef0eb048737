"""Chains and trees of any length in a logarithmic number of joins.

``ranked`` is list ranking by pointer doubling: each element knows the one before it, and in each round it learns of
twice as many before it, so a list of n elements takes log2(n) rounds; what is still on its way after that stands in
a cycle.  ``subtrees`` does the same along parents and hands the sizes of subtrees up on the way.  ``numbered`` puts both
together: a node's place in depth-first order is the sum of what comes before it at each node above, which are
its earlier siblings' subtrees.  With places and sizes, paging, "is below" and "has more below" are comparisons of
numbers, without a sort of all rows and without paths; the rounds follow the depth and not the number of nodes.

Each round is written to the shared folder and the one before it deleted; nothing but counts reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster; in the warehouse if that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """Tables that steps of one computation write, each with counts taken while it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.place, self.n = spark, scratch_folder(spark, name), 0

    def write(self, rows: DataFrame, **counts) -> tuple[DataFrame, dict[str, int]]:
        self.n += 1
        seen = Observation(f"{self.place}/{self.n}")
        counted = rows.observe(seen, *[F.count_if(c).alias(k) for k, c in counts.items()]) if counts else rows
        counted.write.parquet(f"{self.place}/{self.n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.place}/{self.n}"), dict(seen.get) if counts else {}

    def drop(self, *numbers: int) -> None:
        for n in numbers:
            delete_folder(self.spark, f"{self.place}/{n}")


def ranked(links: DataFrame, weights: list[str], name: str = "ranks") -> DataFrame:
    """(id, head, closed, weights..) of links (id, before, weights..): head is the first element of the list, each
    weight its sum from there to the element, closed tells that the element is in a cycle and has no head.

    before is null for the first; one that is not among the ids counts as none.  Several elements may have the
    same one before them, as nodes have a parent.
    """
    work = Rounds(links.sparkSession, name)
    start = links.select("id", F.col("before").alias("to"), F.col("id").alias("head"), *weights)
    state, seen = work.write(start, n=F.lit(True), open=F.col("to").isNotNull())
    rounds = 0
    while seen["open"] and (1 << rounds) <= seen["n"]:
        rounds += 1
        far = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("head").alias("_head"), *[F.col(w).alias(f"_{w}") for w in weights], F.lit(True).alias("_known"))
        on = state.where("to IS NOT NULL").join(far, "to", "left")
        on = on.select("id", F.col("_to").alias("to"), F.coalesce("_head", "head").alias("head"), *[(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in weights])
        before = work.n
        state, now = work.write(on.unionByName(state.where("to IS NULL")), open=F.col("to").isNotNull())
        work.drop(before)
        seen["open"] = now["open"]
    return state.select("id", "head", F.col("to").isNotNull().alias("closed"), *weights)


def ancestry(nodes: DataFrame, name: str = "ancestry") -> DataFrame:
    """(id, head, depth, closed) of nodes (id, parent): the topmost node above each and how deep it lies, from 1."""
    return ranked(nodes.select("id", F.col("parent").alias("before"), F.lit(1).alias("depth")), ["depth"], name).select("id", "head", "depth", "closed")


def subtrees(nodes: DataFrame, name: str = "subtrees") -> DataFrame:
    """(id, head, depth, size, closed) of nodes (id, parent, counted): the topmost node above each, how deep it lies
    below that from 1, and how many counted ones are in its subtree (counted: 1 or 0).

    A node whose parent is not there is a topmost one.  closed: it stands in or below a cycle.
    """
    work = Rounds(nodes.sparkSession, name)
    start = nodes.select("id", F.col("parent").alias("to"), F.col("id").alias("head"), F.lit(1).cast("long").alias("depth"), F.col("counted").cast("long").alias("size"))
    state, seen = work.write(start, n=F.lit(True), open=F.col("to").isNotNull())
    rounds = 0
    while seen["open"] and (1 << rounds) <= seen["n"]:
        rounds += 1
        tied = state.where("to IS NOT NULL")
        far = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("head").alias("_head"), F.col("depth").alias("_depth"))
        handed = tied.groupBy(F.col("to").alias("id")).agg(F.sum("size").alias("_more"))
        on = tied.join(far, "to", "left").select("id", F.col("_to").alias("to"), F.coalesce("_head", "head").alias("head"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), "size")
        after = on.unionByName(state.where("to IS NULL")).join(handed, "id", "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_more")
        before = work.n
        state, now = work.write(after, open=F.col("to").isNotNull())
        work.drop(before)
        seen["open"] = now["open"]
    return state.select("id", "head", "depth", "size", F.col("to").isNotNull().alias("closed"))


def sums_before(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """rows with before: the sum of the values before a row within its group, in the given order.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; of groups that go
    over several ranges the ranges' sums meet.
    """
    work = Rounds(rows.sparkSession, "order")
    dealt, _ = work.write(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range", group).agg(F.sum(value).alias("_sum")).withColumnRenamed(group, "_group")
    wide = sums.groupBy("_group").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    carried = sums.join(wide, sums["_group"].eqNullSafe(wide["_group"]), "left_semi")
    earlier = F.sum("_sum").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = carried.select(F.col("_range").alias("_r"), "_group", F.coalesce(earlier, F.lit(0)).alias("_carry"))
    inner = F.sum(value).over(Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    own = dealt.withColumn("_inner", F.coalesce(inner, F.lit(0)))
    joined = own.join(carried, (own["_range"] == carried["_r"]) & own[group].eqNullSafe(carried["_group"]), "left")
    return joined.select(*rows.columns, (F.col("_inner") + F.coalesce("_carry", F.lit(0))).alias("before"))


def numbered(nodes: DataFrame, order: list[str], name: str = "numbering") -> DataFrame:
    """(id, head, place, n_below, depth) of nodes (id, parent, order..), siblings in the given order and those
    without a parent one after the other: places from 1 in depth-first order.

    A node whose parent is not there begins at 1 by itself, see head.  Nodes in a cycle, or below one, are left out.
    """
    sizes = Rounds(nodes.sparkSession, name).write(subtrees(nodes.select("id", "parent", F.lit(1).alias("counted")), name))[0]
    rows = nodes.select("id", "parent", *order).join(sizes.where("NOT closed"), "id")
    rows = sums_before(rows, "parent", [*order, "id"], "size")
    # earlier siblings count where there is a parent, or where there is none on purpose
    lost = F.col("parent").isNotNull() & (F.col("head") == F.col("id"))
    paths = rows.select("id", F.col("parent").alias("before"), (F.when(lost, F.lit(0)).otherwise(F.col("before")) + 1).alias("place"))
    places = ranked(paths, ["place"], name)
    return rows.select("id", "head", "depth", (F.col("size") - 1).alias("n_below")).join(places.select("id", "place"), "id").select("id", "head", "place", "n_below", "depth")
