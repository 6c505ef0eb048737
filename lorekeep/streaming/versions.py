"""A store of tables in batches, and conversations kept up to date in it.

A batch writes each of its tables to a folder of its own, ``<folder>/<table>/batch=<id>``, and is published by one
marker, ``<folder>/_published/<id>``, written last.  Readers take the rows of published batches only, so a run that
stops between two tables has changed nothing, and a batch that is run again replaces its own folders or,
once it is published, does nothing.  Ids sort in the order of their batches.

``update_conversations`` adds what a newer export has: of a conversation that is stored, the nodes of its chain
behind the last stored one; its former title and time go to "previous"; each state of its content is recorded
in "ingest" by its hash, so that the same file adds nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import content, conversation, listing

_PUBLISHED = "_published"


class Batches:
    """The tables of a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def new_id(self) -> str:
        return f"b{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def published(self) -> list[str]:
        path, store = self._path(_PUBLISHED)
        return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []

    def is_published(self, batch: str) -> bool:
        path, store = self._path(_PUBLISHED, batch)
        return store.exists(path)

    def read(self, name: str, with_batch: bool = False) -> DataFrame | None:
        """Rows of the published batches, with the batch of each if asked for; None if no batch has the table."""
        path, store = self._path(name)
        if not store.exists(path):
            return None
        there = {f.getPath().getName().removeprefix("batch=") for f in store.listStatus(path)}
        batches = [b for b in self.published() if b in there]
        if not batches:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/batch={b}" for b in batches])
        return rows.withColumn("batch", F.col("batch").cast("string")) if with_batch else rows.drop("batch")

    def tables(self, prefix: str = "") -> dict[str, DataFrame]:
        """The published tables whose names begin with the prefix, by the rest of their names."""
        path, store = self._path()
        names = sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []
        found = {n.removeprefix(prefix): self.read(n) for n in names if n.startswith(prefix) and not n.startswith("_")}
        return {n: rows for n, rows in found.items() if rows is not None}

    def publish(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Writes the tables and then the marker; False if the batch is published already."""
        if self.is_published(batch):
            return False
        for name, rows in tables.items():
            rows.drop("batch").write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        path, store = self._path(_PUBLISHED, batch)
        store.create(path, True).close()
        return True


def content_key(conversations: DataFrame) -> DataFrame:
    """conversations with sha, the SHA-256 of their content as JSON."""
    whole = F.struct("title", "create_time", "update_time", F.array_sort(F.map_entries(F.transform_values("mapping", lambda _, n: F.to_json(n)))).alias("mapping"))
    return conversations.withColumn("sha", F.sha2(F.to_json(whole), 256))


def current(store: Batches) -> DataFrame | None:
    """(conversation_id, title, create_time, update_time, version) of each stored conversation."""
    states = store.read("conversations")
    return None if states is None else listing.latest(states, "conversation_id", "version")


def changed(store: Batches, conversations: DataFrame) -> DataFrame:
    """conversations with sha, one row each, the latest; without those that are stored in the same state."""
    rows = listing.latest(content_key(conversations), "conversation_id", "update_time")
    known = store.read("ingest")
    return rows if known is None else rows.join(known.select("conversation_id", "sha"), ["conversation_id", "sha"], "left_anti")


def update_conversations(store: Batches, batch: str, conversations: DataFrame, source: str, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, _: rows, more: Callable[[DataFrame], dict[str, DataFrame]] = lambda rows: {}) -> bool:
    """Publishes what the conversations (as ``exports.read_export`` gives them) add to the store.

    keep may write the changed conversations and give them back, for they are read for each table.  more: other
    tables of the changed conversations that belong to the batch.
    """
    if store.is_published(batch):
        return False
    rows = keep(changed(store, conversations), "changed")
    nodes = conversation.nodes(rows)
    chain = conversation.chain_order(nodes).where("issue IS NULL").select("conversation_id", "id", F.col("idx").alias("seqnbr"))
    # a conversation that is new has all its nodes stored, one that is known those behind its last
    placed = nodes.join(chain, ["conversation_id", "id"], "left")
    old, stored = current(store), store.read("nodes")
    if stored is not None:
        most = stored.groupBy("conversation_id").agg(F.coalesce(F.max("seqnbr"), F.lit(-1)).alias("most"))
        placed = placed.join(most, "conversation_id", "left").where("most IS NULL OR seqnbr > most").drop("most")
    heads = rows.select("conversation_id", "title", "create_time", "update_time")
    before = heads.limit(0).withColumn("version", F.lit(0)) if old is None else old
    known = before.select("conversation_id", F.col("title").alias("old_title"), F.col("update_time").alias("old_time"), "version")
    states = heads.join(known, "conversation_id", "left")
    tables = content.to_tables(heads, placed.select(*nodes.columns), keep)
    tables["conversations"] = states.select(*heads.columns, (F.coalesce("version", F.lit(0)) + 1).alias("version"))
    tables["nodes"] = tables["nodes"].join(chain, ["conversation_id", "id"], "left")
    tables["previous"] = states.where("version IS NOT NULL").select("conversation_id", "version", F.col("old_title").alias("title"), F.col("old_time").alias("update_time"))
    tables["ingest"] = rows.select("conversation_id", "sha", F.lit(source).alias("source"))
    return store.publish(batch, tables | more(rows))


def follow(stream: DataFrame, folder: str, checkpoint: str, name: str = "stream"):
    """A streaming query that brings conversations up to date; stream: (value) texts of exports, an array each.

    A micro-batch has the id <name>-<number>, so one that is run again after a failure is the same batch.
    """
    from lorekeep.sources.exports import decode_export

    def update(rows: DataFrame, number: int) -> None:
        update_conversations(Batches(rows.sparkSession, folder), f"{name}-{number:012d}", decode_export(rows), name)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
