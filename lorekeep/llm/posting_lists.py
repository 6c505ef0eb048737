"""What joins over inverted lists share: frequencies of tokens, and rounds over the lists.

``frequencies`` has blocks of documents send their distinct tokens to buckets, which answer with the frequency of
each, packed.  ``link_lists`` finds the links within inverted lists without pairing all of a list: first each list's
hub meets all others, then documents that are not in the hub's component meet those of other components, more of
them in each round.  Which documents take their turn first is the same in all lists, so a group of documents
that share many values meets a few hubs and not a few for each value.  In the end each pair of a list has been tried
or stands in one component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import Block, Scratch, expand, squeeze, tidy, tidy_group
from lorekeep.llm.components import components
from lorekeep.llm.suffix_dedup import hash_keys, split_buckets

#: Times as many postings become hubs in each round after the first.
GROWTH = 8


def frequencies(blocks: DataFrame, sets_of: Callable[[Block], list[np.ndarray]], buckets: int) -> DataFrame:
    """(block, counts): for each distinct token of the block's sets, in order of its key, its frequency on a scale
    of eighths of powers of two, 0 for one document.  Equal sets of a block count once."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                sets = {s.tobytes(): s for s in sets_of(block)}
                every = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
                keys, count = np.unique(hash_keys(every, buckets), return_counts=True)
                parts = split_buckets(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in parts], pa.int64()),
                        pa.array([block.block] * len(parts), pa.int64()),
                        pa.array([(keys[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for _, s in parts], pa.binary()),
                        pa.array([squeeze(count[s].astype(np.uint32).tobytes()) for _, s in parts], pa.binary()),
                    ],
                    names=["bucket", "block", "hashes", "counts"],
                )

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(expand(x), np.uint32) for x in table["counts"].to_pylist()]).astype(np.float64)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        s = every[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(counts[order], at)
        code = np.minimum(255, np.ceil(8 * np.log2(total))).astype(np.uint8)
        back = np.zeros(len(every), np.uint8)
        back[order] = np.repeat(code, np.diff(np.concatenate([at, [len(s)]])))
        cut = np.cumsum([len(h) for h in hashes])[:-1]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array([squeeze(x.tobytes()) for x in np.split(back, cut)], pa.binary())})

    sent = blocks.mapInArrow(tidy(send), "bucket long, block long, hashes binary, counts binary")
    out = sent.groupBy("bucket").applyInArrow(tidy_group(answer), "block long, bucket long, counts binary")
    return out.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("counts"))


def codes_of(sets: list[np.ndarray], counts: list | None, buckets: int) -> np.ndarray:
    """The frequency codes of all tokens of a block's sets, one set after the other."""
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    _, inverse = np.unique(hash_keys(every, buckets), return_inverse=True)
    return np.concatenate([*(np.frombuffer(expand(c["counts"]), np.uint8) for c in counts or []), np.zeros(0, np.uint8)])[inverse]


def relabel(labels: DataFrame, links: DataFrame, work: Scratch, name: str) -> DataFrame:
    """labels (rid, label) after these links (a, b)."""
    at = lambda end: labels.select(F.col("rid").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    least = components(ends, work, f"{name}-edges").select(F.col("node").alias("label"), F.col("label").alias("least"))
    return work.write(labels.join(least, "label", "left").select("rid", F.coalesce("least", "label").alias("label")), f"{name}-labels")


def link_lists(postings: DataFrame, possible: Column, linked: Callable[[DataFrame, str], DataFrame], labels: DataFrame, work: Scratch) -> DataFrame:
    """labels (rid, label) after all links within the lists of postings (token, rid, size, at).

    possible: whether a pair that meets at a token (a_size, a_at, b_size, b_at) can be linked if it is
    the pair's first common one.  linked turns pairs (a, b) into the written links among them.
    """
    postings = work.write(postings, "postings")
    lists = postings.groupBy("token").agg(F.min(F.struct("at", "rid", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    lists = work.write(lists.select("token", "n", F.col("hub.rid").alias("hub"), F.col("hub.at").alias("hub_at"), F.col("hub.size").alias("hub_size")), "lists")
    most = lists.agg(F.max("n")).first()[0] or 0
    side = lambda who: [F.col("rid").alias(who), F.col("size").alias(f"{who}_size"), F.col("at").alias(f"{who}_at")]
    own = lambda who: labels.select(F.col("rid").alias(who), F.col("label").alias(f"{who}_label"))
    member = postings.select("token", *side("b"))
    step, low = 0, 0
    while low < most:
        if step == 0:
            hubs = lists.select("token", F.col("hub").alias("a"), F.col("hub_size").alias("a_size"), F.col("hub_at").alias("a_at"))
            found = hubs.join(member, "token").where(F.col("a") != F.col("b"))
        else:
            high = GROWTH**step
            seen = lists.join(own("hub"), "hub").select("token", "n", "hub_label")
            # a document's turn among the n of a list: even, the same in each round and its order the same in all lists
            turn = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
            live = postings.join(labels, "rid").join(seen, "token").where("label <> hub_label")
            stray = work.write(live.select("token", *side("a"), F.col("label").alias("a_label"), turn.alias("turn")).where(F.col("turn") >= low), f"strays-{step}")
            if stray.isEmpty():
                break
            found = stray.where(F.col("turn") < high).join(member, "token").where(F.col("a") != F.col("b")).where(possible).join(own("b"), "b").where("a_label <> b_label")
            low = high
        pairs = work.write(found.where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs-{step}")
        links = work.write(linked(pairs, str(step)), f"links-{step}")
        work.drop(f"pairs-{step}", f"strays-{step}")
        if not links.isEmpty():
            labels = relabel(labels, links, work, f"round-{step}")
        step += 1
    work.drop("postings", "lists")
    return labels
