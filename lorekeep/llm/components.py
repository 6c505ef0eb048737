"""Connected components of a graph of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them: the larger ones, or the smaller ones
    with the node itself."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = pairs.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node, label) of every linked node; the label is the least node of its component.

    links: columns a and b (long).  Alternates large and small stars until the edges no longer
    change; each round's edges are written, so nothing but two totals reaches the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = work.write(edges, f"{name}-0")
    total = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())
    before, step = total(edges), 0
    while before[0]:
        step += 1
        edges = work.write(_stars(_stars(edges, True), False), f"{name}-{step}")
        after = total(edges)
        work.drop(f"{name}-{step - 1}")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
