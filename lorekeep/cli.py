"""Commands over the library's functions: python -m lorekeep.cli COMMAND [options].

docx reads Word files; ingest imports them as the blocks of a document, if user, right and policy allow it; notion
reads saved workspace envelopes; oai reads exported conversations: print shows an export, store brings the store up to date
with it, elm, docx and summary render and label stored discussions, project reads a project page, and conversation
deserialize, convert and docx show stored conversations, fold them into discussions again and render those.

The store is a folder of tables in published batches (``streaming.versions``): a run that stops half-way changes nothing.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import content, conversation, discussion, listing, store
from lorekeep.operators.numbering import scratch_folder
from lorekeep.options import Options, merged, read_file
from lorekeep.sinks import files
from lorekeep.sources import docx, exports, project_page, workspace
from lorekeep.streaming.versions import Batches, update_conversations

VERSION = "0.3"


def _walk(rows: DataFrame, stored: bool = False) -> DataFrame:
    """Stored or exported messages in the order of a walk, as the state machine takes them."""
    order = conversation.walk_order(rows.select("conversation_id", "id", "parent", "children")).where("pos IS NOT NULL")
    said = rows.where("kind IS NOT NULL").select("conversation_id", "id", "role", *content.walk_columns(stored), F.coalesce("end_turn", F.lit(False)).alias("end_turn"))
    return order.join(said, ["conversation_id", "id"]).withColumnRenamed("conversation_id", "conv_id")


def _decoded(conversations: DataFrame) -> DataFrame:
    rows = content.decode(conversation.nodes(conversations).withColumn("content", F.col("message.content")))
    return rows.select(*[c for c in rows.columns if c != "message"], F.lower("message.author.role").alias("role"), F.col("message.end_turn").alias("end_turn"))


def export_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an export, folded."""
    return discussion.fold_messages(_walk(_decoded(exports.read_export(spark, path))))


def _discussions(walk: DataFrame, titles: DataFrame, version: str) -> dict[str, DataFrame]:
    tables = discussion.to_tables(discussion.fold_messages(walk), titles, discussion.issues(walk), version)
    return {f"discussion_{name}": rows for name, rows in tables.items()}


def _keeper(spark: SparkSession, name: str):
    place = scratch_folder(spark, name)

    def keep(rows: DataFrame, part: str) -> DataFrame:
        rows.write.parquet(f"{place}/{part}")
        return spark.read.schema(rows.schema).parquet(f"{place}/{part}")

    return keep


def store_export(spark: SparkSession, o: Options) -> None:
    """Brings the store up to date: conversations that it lacks, by id and title, and new states of those it has;
    their discussions are folded anew."""
    batches, incoming = Batches(spark, o.store), exports.read_export(spark, o.input)
    stored = batches.read("conversations")
    if stored is not None:
        known = incoming.join(stored.select("conversation_id").distinct(), "conversation_id", "left_semi")
        others = incoming.join(stored.select("conversation_id").distinct(), "conversation_id", "left_anti")
        incoming = known.unionByName(conversation.new_conversations(others, stored).select(*known.columns))
    batch = batches.new_id()
    more = lambda rows: _discussions(_walk(_decoded(rows)), rows.select(F.col("conversation_id").alias("conv_id"), "title"), batch)
    update_conversations(batches, batch, incoming, o.input, _keeper(spark, "store"), more)


def _chosen(spark: SparkSession, batches: Batches, o: Options, titles: DataFrame) -> DataFrame:
    """titles (conv_id, title) that ids or a group's label ask for; all if neither is given."""
    titles = titles.withColumnRenamed("conv_id", "uid")
    ids = spark.createDataFrame([(i,) for i in o.ids.split(",")], "uid string") if o.ids else None
    members = batches.read("group_members") if o.label else None
    return listing.targets(titles, ids, members, o.label or None, default_all=not o.label).withColumnRenamed("uid", "conv_id")


def _labels(batches: Batches) -> DataFrame | None:
    """(conv_id, seq, label): the last label of each message."""
    kept = batches.read("summaries", with_batch=True)
    return None if kept is None else kept.groupBy("conv_id", "seq").agg(F.max_by("label", "batch").alias("label"))


def _stored(spark: SparkSession, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages with labels, titles and issues of the stored discussions that are asked for."""
    batches = Batches(spark, o.store)
    tables = discussion.latest_version(batches.tables("discussion_") | {"discussion": batches.read("discussion_discussion")})
    titles = _chosen(spark, batches, o, tables["discussion"].select("conv_id", "title"))
    messages = discussion.from_tables(tables).join(titles.select("conv_id"), "conv_id", "left_semi")
    labels = _labels(batches)
    return (messages if labels is None else discussion.with_labels(messages, labels)), titles, tables["issue"].join(titles.select("conv_id"), "conv_id", "left_semi")


def _write_word(messages: DataFrame, titles: DataFrame, issues: DataFrame, o: Options) -> DataFrame:
    return files.write_files(files.word_files(discussion.document_rows(messages, issues), titles), o.output)


def label_messages(spark: SparkSession, o: Options) -> None:
    """Labels for the questions and answers of the stored discussions that have none yet."""
    messages, _, _ = _stored(spark, o)
    bare = messages.where("kind IN ('user', 'assistant') AND label IS NULL").drop("label")
    none = spark.createDataFrame([], "conv_id string, seq int, label string")
    batches = Batches(spark, o.store)
    batches.publish(batches.new_id(), {"summaries": discussion.labelled(bare, none).select("conv_id", "seq", "label")})


def ingest_document(spark: SparkSession, o: Options) -> DataFrame:
    """Imports a Word file as blocks of a stored document for a user; (doc, user, action, detail) tells the outcome.

    The store's folders documents (doc, domain, tier, status), users (user), access (user, doc) and policies
    are plain tables that others keep.
    """
    if not o.doc or not o.user:
        raise ValueError("ingest needs a document (--doc) and a user (--user)")
    table = lambda name: spark.read.parquet(f"{o.store}/{name}")
    batches = Batches(spark, o.store)
    docs, blocks = table("documents"), docx.read_documents(spark.read.format("binaryFile").load(o.input), o.nesting, o.promote, o.mode)
    asked = spark.createDataFrame([(o.doc, o.user)], "doc string, user string").join(docs.select(F.col("doc").cast("string").alias("doc"), "domain", "tier", "status"), "doc", "left")
    text = lambda rows, *names: rows.select(*[F.col(c).cast("string").alias(c) for c in names])
    gated = store.gate(asked, text(docs, "doc"), text(table("users"), "user"), text(table("access"), "user", "doc"), table("policies"))
    stored = batches.read("blocks")
    if stored is None:
        stored = spark.createDataFrame([], "uid string, parent string, doc string, seq_pos decimal(38,10), kind string, content string, valid_from long, valid_to long")
    seq = stored.agg(F.coalesce(F.max("valid_from"), F.lit(0)) + 1).first()[0]
    out = store.import_blocks(stored, gated, docx.child_rows(blocks).withColumn("doc", F.lit(o.doc)), seq)
    batches.publish(batches.new_id(), out)
    return out["audit"]


def stored_conversations(spark: SparkSession, o: Options) -> DataFrame:
    """Messages of the stored conversations that are asked for, put together from their tables."""
    batches = Batches(spark, o.store)
    tables = batches.tables()
    titles = _chosen(spark, batches, o, listing.latest(tables["conversations"], "conversation_id", "version").select(F.col("conversation_id").alias("conv_id"), "title"))
    rows = content.from_tables(tables).join(titles.select(F.col("conv_id").alias("conversation_id")), "conversation_id", "left_semi")
    return rows.withColumn("parent", F.substring_index("parent_key", "/", -1))


def convert_conversations(spark: SparkSession, o: Options) -> None:
    """Discussions of the stored conversations, folded from their tables."""
    batches, rows = Batches(spark, o.store), stored_conversations(spark, o)
    nodes = batches.read("nodes")
    every = nodes.select("conversation_id", "id", F.substring_index("parent_key", "/", -1).alias("parent"))
    every = every.join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi")
    order = conversation.walk_order(conversation.with_children(every)).where("pos IS NOT NULL")
    said = rows.select("conversation_id", "id", "role", *content.walk_columns(stored=True), F.coalesce("end_turn", F.lit(False)).alias("end_turn"))
    walk = order.join(said, ["conversation_id", "id"]).withColumnRenamed("conversation_id", "conv_id")
    titles = listing.latest(batches.read("conversations"), "conversation_id", "version").select(F.col("conversation_id").alias("conv_id"), "title")
    batch = batches.new_id()
    batches.publish(batch, _discussions(walk, titles.join(walk.select("conv_id").distinct(), "conv_id", "left_semi"), batch))


def run(spark: SparkSession, command: list[str], o: Options) -> DataFrame | None:
    """What a command computes; None if it only writes."""
    match command:
        case ["docx"]:
            blocks = docx.read_documents(spark.read.format("binaryFile").load(o.input), o.nesting, o.promote, o.mode, levels="groups")
            texts = files.tree_texts(blocks, o.form).select(F.concat(F.regexp_extract("doc_id", "([^/]+)$", 1), F.lit(f".{o.form}")).alias("name"), "content")
            return files.write_files(texts, o.output) if o.output else texts
        case ["ingest"]:
            return ingest_document(spark, o)
        case ["notion"]:
            return workspace.pages(workspace.results(spark.read.text(o.input)))
        case ["notion", "blocks"]:
            return workspace.saved_tree(spark.read.text(o.input))
        case ["oai", "print"]:
            return discussion.transcript(export_messages(spark, o.input))
        case ["oai", "store"]:
            return store_export(spark, o)
        case ["oai", "elm"]:
            messages, titles, _ = _stored(spark, o)
            return files.write_files(files.elm_modules(discussion.elm_items(messages), titles, o.types), o.output)
        case ["oai", "docx"] | ["oai", "conversation", "docx"]:
            return _write_word(*_stored(spark, o), o)
        case ["oai", "summary"]:
            return label_messages(spark, o)
        case ["oai", "conversation", "deserialize"]:
            return stored_conversations(spark, o).select("conversation_id", "id", "parent", "role", "kind", F.array_join(content.texts(), content.PART).alias("text"))
        case ["oai", "conversation", "convert"]:
            return convert_conversations(spark, o)
        case ["oai", "project"]:
            pages = spark.read.text(o.input, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("page_id"), F.col("value").alias("html"))
            items = project_page.read_items(pages, date.today().isoformat())
            batches = Batches(spark, o.store)
            known = batches.read("conversations").select(F.col("conversation_id").alias("eid")).distinct()
            kept = batches.read("group_members")
            none = spark.createDataFrame([], "label string, eid string")
            members = none if kept is None else kept.select("label", F.col("uid").alias("eid"))
            added, errors = project_page.add_members(members, o.label, items, known)
            batches.publish(batches.new_id(), {"group_members": added.join(members, ["label", "eid"], "left_anti").withColumnRenamed("eid", "uid")})
            return errors
    raise ValueError(f"unknown command: {' '.join(command)}")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("lorekeep", description=__doc__)
    parser.add_argument("command", nargs="+", help="help, version, docx, ingest, notion, notion blocks, or oai with print, store, elm, docx, summary, project, or oai conversation with deserialize, convert, docx")
    parser.add_argument("--config")
    for name in ("input", "output", "store", "nesting", "mode", "form", "label", "ids", "doc", "user", "types"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--no-promote", dest="promote", action="store_const", const=False)
    given = vars(parser.parse_args(arguments))
    command, config = given.pop("command"), given.pop("config")
    if command == ["help"]:
        parser.print_help()
        return 0
    if command == ["version"]:
        print(f"lorekeep {VERSION}")
        return 0
    o = merged(read_file(Path(config).read_text()) if config else {}, dict(os.environ), given)
    from lorekeep.session import session

    try:
        found = run(session(), command, o)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if found is not None:
        for row in found.toLocalIterator():
            print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
