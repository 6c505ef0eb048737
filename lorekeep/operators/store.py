"""Gated import of document blocks: who may write, what a policy bars, and what is appended.

One import is a batch: requests (doc, user, domain, tier, status) and the blocks of their documents.  A
request passes if the document and the user exist, the user may edit the document and no policy bars it;
the others come back with a reason, and nothing of theirs is appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.access import best_policy
from lorekeep.operators.tree import KEY, missing_roots


def gate(requests: DataFrame, docs: DataFrame, users: DataFrame, allowed: DataFrame, rules: DataFrame) -> DataFrame:
    """requests with reason, null where they pass.  docs: doc.  users: user.  allowed: (user, doc) pairs that
    may edit, a null doc for all (``access.can_user``)."""
    known_doc = docs.select("doc", F.lit(True).alias("_doc")).distinct()
    known_user = users.select("user", F.lit(True).alias("_user")).distinct()
    pair = allowed.where("doc IS NOT NULL").select("user", "doc", F.lit(True).alias("_pair")).distinct()
    every = allowed.where("doc IS NULL").select("user", F.lit(True).alias("_every")).distinct()
    rows = best_policy(requests, rules).join(known_doc, "doc", "left").join(known_user, "user", "left").join(pair, ["user", "doc"], "left").join(every, "user", "left")
    reason = F.when(F.col("_doc").isNull(), "no such document").when(F.col("_user").isNull(), "no such user")
    reason = reason.when(F.coalesce("_pair", "_every").isNull(), "not allowed to edit").when(F.col("blocked"), "barred by policy")
    return rows.select(*requests.columns, reason.alias("reason"))


def import_blocks(stored: DataFrame, gated: DataFrame, incoming: DataFrame, seq: int) -> dict[str, DataFrame]:
    """Tables to append for the requests that pass: blocks, events, audit.

    stored: the block table (uid, parent, doc, seq_pos, kind, content, valid_from, valid_to).  incoming: key,
    parent, doc, seq_pos, kind, content.  Top blocks hang under the document's root, which is made if it
    has none, behind the live blocks there.  Keys become uids with the sequence number, so that an import that is
    made again makes blocks of its own.
    """
    numbered = lambda c: F.concat(F.col(c), F.lit(f"@{seq}"))
    passed = gated.where("reason IS NULL").select("doc", "user")
    mine = incoming.join(passed.select("doc").distinct(), "doc", "left_semi")
    fresh = missing_roots(passed, stored, seq)
    live = stored.where("parent IS NULL AND valid_to IS NULL").groupBy("doc").agg(F.min_by("uid", F.struct("seq_pos", "uid")).alias("root"))
    roots = live.unionByName(fresh.select("doc", F.col("uid").alias("root")))
    last = stored.where("valid_to IS NULL").join(live, (stored.parent == live.root) & stored.doc.eqNullSafe(live.doc)).groupBy(F.col("root").alias("_of")).agg(F.max("seq_pos").alias("_last"))
    placed = mine.join(roots, "doc").join(last, F.col("root") == F.col("_of"), "left")
    top = F.col("parent").isNull()
    pos = F.when(top, F.coalesce("_last", F.lit(0)) + F.col("seq_pos")).otherwise(F.col("seq_pos")).cast(KEY)
    blocks = placed.select(numbered("key").alias("uid"), F.when(top, F.col("root")).otherwise(numbered("parent")).alias("parent"), "doc", pos.alias("seq_pos"), "kind", "content", F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    blocks = fresh.select(*blocks.columns).unionByName(blocks)
    data = F.to_json(F.struct(F.col("valid_from").alias("sequence"), "parent", "kind", "seq_pos"))
    events = blocks.join(passed.groupBy("doc").agg(F.min("user").alias("actor")), "doc").select("doc", "uid", F.lit("insert").alias("event_type"), data.alias("event_data"), "actor")
    counts = mine.groupBy("doc").agg(F.count("*").alias("n_blocks"))
    audit = gated.join(counts, "doc", "left").select("doc", "user", F.when(F.col("reason").isNull(), "imported").otherwise("rejected").alias("action"), F.coalesce("reason", F.concat(F.coalesce("n_blocks", F.lit(0)).cast("string"), F.lit(" blocks"))).alias("detail"))
    return {"blocks": blocks, "events": events, "audit": audit}
