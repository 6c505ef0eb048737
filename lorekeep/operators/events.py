"""State from a log of events: blocks, documents, rights and comments as of any sequence number.

Events are rows (entity, key, seq, n, event, changed, and one column for each field): "create" and "update" carry the
fields named in changed, "delete" ends the thing, which a later "create" may begin anew.  seq orders events, n those
of one sequence number.  A replay is one aggregation by key: the last event tells whether a thing is there, and each
field is what the last event since the thing was created says that names it.

``block_events`` makes the log of a table with validity, so that its replay equals the table as of each number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = ("create", "update", "delete")


def event_rows(rows: DataFrame, entity: str, key: str, seq: str, event: str, fields: list[str], n: str | None = None) -> DataFrame:
    """Events of one kind: all of the fields are changed."""
    if event not in EVENTS:
        raise ValueError(f"unknown event: {event}")
    changed = fields if event != "delete" else []
    return rows.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), (F.lit(0) if n is None else F.col(n)).cast("long").alias("n"), F.lit(event).alias("event"), F.array(*map(F.lit, changed)).cast("array<string>").alias("changed"), *changed)


def union(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def replay(events: DataFrame, entity: str, seq: int | None = None) -> DataFrame:
    """(key, the fields.., created, updated) of what is there as of seq, or at the end of the log; created and
    updated are the numbers of its first event and of its last."""
    fields = [c for c in events.columns if c not in ("entity", "key", "seq", "n", "event", "changed")]
    rows = events.where(F.col("entity") == entity)
    rows = rows if seq is None else rows.where(F.col("seq") <= seq)
    place = F.struct("seq", "n")
    begun = rows.where("event = 'create'").groupBy("key").agg(F.max(place).alias("begun"))
    mine = rows.withColumn("place", place).join(begun, "key").where("place >= begun")
    said = lambda f: F.when(F.array_contains("changed", f), F.struct("place", F.col(f).alias("value")))
    state = mine.groupBy("key").agg(F.max_by("event", "place").alias("last"), F.min("seq").alias("created"), F.max("seq").alias("updated"), *[F.max_by(said(f), F.when(F.array_contains("changed", f), F.col("place"))).alias(f) for f in fields])
    return state.where("last <> 'delete'").select("key", *[F.col(f"{f}.value").alias(f) for f in fields], "created", "updated")


def block_events(blocks: DataFrame) -> DataFrame:
    """The log of blocks (uid, parent, seq_pos, content, valid_from, valid_to)."""
    fields = ["parent", "seq_pos", "content"]
    # at one number what ends comes first and what begins follows, but for what ends where it began
    ended = blocks.where("valid_to IS NOT NULL").withColumn("valid_to", F.greatest("valid_to", "valid_from")).withColumn("_n", F.when(F.col("valid_to") > F.col("valid_from"), 0).otherwise(2))
    begun = event_rows(blocks.withColumn("_n", F.lit(1)), "block", "uid", "valid_from", "create", fields, "_n")
    return union(begun, event_rows(ended, "block", "uid", "valid_to", "delete", fields, "_n"))


def document_state(events: DataFrame, seq: int | None = None, deleted: bool = False) -> DataFrame:
    """Documents as of seq; soft-deleted ones (an update of deleted to true) only if asked for."""
    rows = replay(events, "document", seq)
    return rows if deleted or "deleted" not in rows.columns else rows.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def rights(events: DataFrame, seq: int | None = None) -> DataFrame:
    """(key, doc, principal, rights..) of the entries of documents' own lists that are granted and not revoked."""
    return replay(events, "acl", seq)


def comments(events: DataFrame, doc: str, seq: int | None = None) -> DataFrame:
    """A document's comments, the newest first."""
    return replay(events, "comment", seq).where(F.col("doc") == doc).orderBy(F.col("created").desc(), "key")
