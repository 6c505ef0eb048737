"""Walks and chains as table functions for SQL, called with a partitioned table:

    SELECT * FROM chain_order(TABLE(nodes) PARTITION BY conversation_id)
    SELECT * FROM walk_blocks(TABLE(blocks) PARTITION BY doc)

They hold the ids of one conversation or document in a task; ``operators.conversation`` and ``operators.tree`` have the
same results for graphs of any size.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="conversation_id string, id string, idx long")
class ChainOrder:
    """Of nodes (conversation_id, id, parent): the chain from the least root that goes to the least child at each step."""

    def __init__(self):
        self.name, self.least, self.root = None, {}, None

    def eval(self, node):
        self.name, i, parent = node["conversation_id"], node["id"], node["parent"]
        if parent is None:
            self.root = i if self.root is None else min(self.root, i)
        else:
            self.least[parent] = min(self.least.get(parent, i), i)

    def terminate(self):
        at, n = self.root, 0
        while at is not None:
            yield self.name, at, n
            at, n = self.least.pop(at, None), n + 1  # a step is taken once, so a cycle ends


@udtf(returnType="doc string, uid string, depth int, place long, n_below long")
class WalkBlocks:
    """Of live blocks (doc, uid, parent, seq_pos): depth-first order below the roots, siblings by key."""

    def __init__(self):
        self.doc, self.below = None, {}

    def eval(self, block):
        self.doc = None if block["doc"] is None else str(block["doc"])
        self.below.setdefault(block["parent"], []).append((block["seq_pos"], block["uid"]))

    def terminate(self):
        order, stack = [], [(u, 1) for _, u in sorted(self.below.pop(None, []), reverse=True)]
        while stack:
            uid, depth = stack.pop()
            order.append((uid, depth))
            stack += [(u, depth + 1) for _, u in sorted(self.below.pop(uid, []), reverse=True)]
        sizes = [0] * len(order)
        last: list[int] = []  # the open blocks, by place
        for at, (_, depth) in enumerate(order):
            del last[depth - 1 :]
            for above in last:
                sizes[above] += 1
            last.append(at)
        for at, (uid, depth) in enumerate(order):
            yield self.doc, uid, depth, at + 1, sizes[at]


def register(spark: SparkSession) -> None:
    spark.udtf.register("chain_order", ChainOrder)
    spark.udtf.register("walk_blocks", WalkBlocks)
