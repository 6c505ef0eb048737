"""Workspace pages and blocks from saved API responses (JSON lines of result envelopes).

A live reader is a function that turns a cursor into the next envelope; ``fetch_all`` follows it, so
that tests and batch jobs need no network.  ``WorkspaceSource`` is that as a Spark data source; blocks
below blocks are fetched level by level, each level's in parallel.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

#: The types of blocks that are understood.
TYPES = ["paragraph", "image", "bulleted_list_item", "numbered_list_item", "divider", "heading_1", "heading_2", "heading_3", "code", "table", "quote", "child_page"]


def fetch_all(fetch: Callable[[str | None], dict]) -> Iterator[dict]:
    """Results of all pages: an envelope has results, has_more and next_cursor."""
    cursor = None
    while True:
        envelope = fetch(cursor)
        yield from envelope["results"]
        cursor = envelope.get("next_cursor")
        if not envelope.get("has_more") or cursor is None:
            return


def results(envelopes: DataFrame) -> DataFrame:
    """(value VARIANT, result) of each result of envelopes (value: JSON text)."""
    rows = envelopes.select(F.explode(F.from_json("value", "results ARRAY<VARIANT>")["results"]).alias("result"))
    return rows.where("result IS NOT NULL")


def pages(rows: DataFrame) -> DataFrame:
    """(id, title, archived, parent_type, url): the title joins the plain texts of its parts, null if empty."""
    parts = F.expr("try_variant_get(result, '$.properties.title.title', 'array<struct<plain_text: string>>')")
    title = F.array_join(F.transform(parts, lambda p: p["plain_text"]), "")
    get = lambda p, t="string": F.expr(f"try_variant_get(result, '$.{p}', '{t}')")
    return rows.select(get("id").alias("id"), F.when(title != "", title).alias("title"), get("archived", "boolean").alias("archived"), get("parent.type").alias("parent_type"), get("url").alias("url"))


def blocks(rows: DataFrame) -> DataFrame:
    """(id, type, level, text, language, toggleable, width, has_children, error): typed blocks; a type
    that is not understood gives an error and keeps its id."""
    get = lambda p, t: F.expr(f"try_variant_get(result, '$.{p}', '{t}')")
    kind = get("type", "string")
    text, language, toggle, width = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("long")
    for t in TYPES:
        parts = get(f"{t}.rich_text", "array<struct<plain_text: string>>")
        own = F.array_join(F.transform(parts, lambda p: p["plain_text"]), "")
        if t == "child_page":
            own = get("child_page.title", "string")
        text = F.when(kind == t, own).otherwise(text)
        if t.startswith("heading"):
            toggle = F.when(kind == t, F.coalesce(get(f"{t}.is_toggleable", "boolean"), F.lit(False))).otherwise(toggle)
    language = F.when(kind == "code", F.coalesce(get("code.language", "string"), F.lit("plain text"))).otherwise(language)
    width = F.when(kind == "table", F.floor(get("table.table_width", "double"))).otherwise(width)
    level = F.when(kind.startswith("heading_"), F.substring(kind, 9, 1).cast("int"))
    error = F.when(~F.coalesce(kind.isin(TYPES), F.lit(False)), F.concat(F.lit("unsupported block type: "), F.coalesce(kind, F.lit("none"))))
    return rows.select(get("id", "string").alias("id"), kind.alias("type"), level.alias("level"), text.alias("text"), language.alias("language"), toggle.alias("toggleable"), width.alias("width"), F.coalesce(get("has_children", "boolean"), F.lit(False)).alias("has_children"), error.alias("error"))


def link(path: str) -> Column:
    """struct(url, expiry_time, error) of a file link: external, or hosted until a time."""
    get = lambda p: F.try_variant_get(F.col("result"), f"$.{path}.{p}", "string")
    kind, there = get("type"), F.try_variant_get(F.col("result"), f"$.{path}", "variant").isNotNull()
    url = F.when(kind == "external", get("external.url")).when(kind == "file", get("file.url"))
    expiry = F.when(kind == "file", get("file.expiry_time").try_cast("timestamp"))
    error = F.when(there & ~F.coalesce(kind.isin("external", "file"), F.lit(False)), F.concat(F.lit(f"unsupported {path}.type: "), F.coalesce(kind, F.lit("none"))))
    error = F.coalesce(error, F.when(there & (url.isNull() | ((kind == "file") & expiry.isNull())), F.lit(f"{path}: missing url or expiry_time")))
    return F.struct(url.alias("url"), expiry.alias("expiry_time"), error.alias("error"))


def unions(rows: DataFrame) -> DataFrame:
    """(id, parent_type, parent_id, parent_error, icon_emoji, icon, cover, image, caption): the fields of pages
    and blocks that are one of several kinds."""
    get = lambda p, t="string": F.try_variant_get(F.col("result"), f"$.{p}", t)
    kind = get("parent.type")
    parent = F.when(kind == "workspace", get("parent.workspace")).when(kind == "database_id", get("parent.database_id")).when(kind == "page_id", get("parent.page_id"))
    error = F.when(get("parent", "variant").isNotNull() & parent.isNull(), F.concat(F.lit("unsupported parent.type: "), F.coalesce(kind, F.lit("none"))))
    emoji = F.when(get("icon.type") == "emoji", get("icon.emoji"))
    icon = F.when(F.coalesce(get("icon.type") != "emoji", F.lit(False)), link("icon"))
    caption = F.array_join(F.transform(get("image.caption", "array<struct<plain_text: string>>"), lambda p: p["plain_text"]), "")
    return rows.select(
        get("id").alias("id"), kind.alias("parent_type"), parent.alias("parent_id"), error.alias("parent_error"), emoji.alias("icon_emoji"), icon.alias("icon"),
        F.when(get("cover", "variant").isNotNull(), link("cover")).alias("cover"), F.when(get("type") == "image", link("image")).alias("image"), F.when(get("type") == "image", F.coalesce(caption, F.lit(""))).alias("caption"),
    )


def _function(name: str) -> Callable:
    """The function that "module:name" names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _WorkspaceReader(DataSourceReader):
    def __init__(self, fetcher: str):
        self.fetcher = fetcher

    def read(self, partition):
        for result in fetch_all(_function(self.fetcher)):
            yield (json.dumps(result),)


class _WorkspaceStream(SimpleDataSourceStreamReader):
    """Results by the time of their last edit.  An offset is a place in the interface's own order: the time from
    which on results are asked for, the cursor within that answer, and the ids of that very time that have been read.

    Reading from one offset leads to the same next offset while the answers stand, so a batch that is planned but
    not finished when a run ends is read again, page by page, from its start to its end.
    """

    def __init__(self, fetcher: str, argument: str, pages: int):
        self.fetcher, self.argument, self.pages = fetcher, argument, pages

    def initialOffset(self) -> dict:
        return {"since": None, "cursor": None, "edge": [], "newest": None, "newest_ids": []}

    def _page(self, at: dict) -> tuple[list[tuple], dict, bool]:
        """Rows of the next page, the offset behind it, and whether there is more."""
        envelope = _function(self.fetcher)(at["since"], at["cursor"], self.argument)
        rows, newest, ids = [], at["newest"], list(at["newest_ids"])
        for result in envelope["results"]:
            edited = result["last_edited_time"]
            if edited == at["since"] and result["id"] in at["edge"]:
                continue  # read before
            rows.append((json.dumps(result),))
            if newest is None or edited > newest:
                newest, ids = edited, []
            if edited == newest:
                ids.append(result["id"])
        cursor = envelope.get("next_cursor") if envelope.get("has_more") else None
        if cursor is not None:
            return rows, {**at, "cursor": cursor, "newest": newest, "newest_ids": ids}, True
        if newest is None or newest == at["since"]:  # nothing newer: what was read of that time is added
            return rows, {**at, "cursor": None, "edge": sorted({*at["edge"], *ids}), "newest": None, "newest_ids": []}, False
        return rows, {"since": newest, "cursor": None, "edge": sorted(ids), "newest": None, "newest_ids": []}, False

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for _ in range(self.pages):
            found, at, more = self._page(at)
            rows += found
            if not more:
                break
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at, more = start, True
        while at != end and more:
            found, at, more = self._page(at)
            yield from found


class WorkspaceSource(DataSource):
    """spark.read.format("workspace").option("fetcher", "module:function"): a row (value) for each result.

    The function turns a cursor (None at first) into the next envelope; cursors make this one partition.

    spark.readStream takes a function of (since, cursor, argument) that gives the results edited at or after
    since, the oldest edit first; options "argument" (such as the id of a database) and "pages", the most pages of
    a batch.  Only the edges of a batch are kept, and its pages pass through the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _WorkspaceReader(self.options["fetcher"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _WorkspaceStream(self.options["fetcher"], self.options.get("argument", ""), int(self.options.get("pages", "10")))


def children(spark: SparkSession, parents: DataFrame, fetch: Callable[[str, str | None], dict]) -> DataFrame:
    """(parent, ord, id, has_children, value) of the blocks below parents (id): fetch turns a block's id and
    a cursor into the next envelope.  A parent is one call chain, and parents are fetched in parallel."""

    def run(frames):
        for frame in frames:
            out = []
            for parent in frame["id"]:
                for place, block in enumerate(fetch_all(lambda cursor, parent=parent: fetch(parent, cursor))):
                    out.append((parent, place, block["id"], bool(block.get("has_children")), json.dumps(block)))
            yield pd.DataFrame(out, columns=["parent", "ord", "id", "has_children", "value"])

    return parents.select("id").mapInPandas(run, "parent string, ord int, id string, has_children boolean, value string")


def block_tree(spark: SparkSession, roots: DataFrame, fetch: Callable[[str, str | None], dict]) -> DataFrame:
    """(depth, path, parent, ord, id, has_children, value, error) of all blocks below the roots (id), level by level
    until none has children; sorting by root and path gives depth-first order.

    What lies below a block is known only when it is fetched, so there is a written table a level.  A block that
    stands below itself is not followed and has an error.
    """
    from lorekeep.operators.numbering import Rounds

    work, none = Rounds(spark, "workspace"), F.lit(None).cast("string")
    first = roots.select(F.lit(0).alias("depth"), F.col("id").alias("root"), F.array().cast("array<int>").alias("path"), F.array("id").alias("above"), none.alias("parent"), F.lit(0).alias("ord"), "id", F.lit(True).alias("has_children"), none.alias("value"))
    level, seen = work.write(first, open=F.col("has_children"))
    levels, depth = [], 0
    while seen["open"]:
        depth += 1
        found = children(spark, level.where("has_children").select("id").distinct(), fetch)
        above = level.where("has_children").select(F.col("id").alias("parent"), "root", F.col("path").alias("_path"), "above")
        again = F.array_contains("above", F.col("id"))
        rows = found.join(above, "parent").select(F.lit(depth).alias("depth"), "root", F.concat("_path", F.array("ord")).alias("path"), F.concat("above", F.array("id")).alias("above"), "parent", "ord", "id", (F.col("has_children") & ~again).alias("has_children"), "value")
        level, seen = work.write(rows, open=F.col("has_children"))
        levels.append(work.n)
    every = level.limit(0) if not levels else spark.read.schema(level.schema).parquet(*[f"{work.place}/{n}" for n in levels])
    again = F.size("above") > F.size(F.array_distinct("above"))
    out, _ = work.write(every.select("depth", "root", "path", "parent", "ord", "id", "has_children", "value", F.when(again, F.concat(F.lit("block below itself: "), "id")).alias("error")))
    work.drop(*range(1, work.n))
    return out


def saved_tree(envelopes: DataFrame) -> DataFrame:
    """(root, place, depth, n_below, parent, id, type, text, error) of blocks in saved envelopes (value): those below
    each page or block in the order of the envelopes' "page" numbers (0 if there is none) and of their results.

    The order of the whole tree comes from numbering, for trees of any depth.
    """
    from lorekeep.operators.numbering import numbered

    rows = envelopes.select(F.from_json("value", "page INT, results ARRAY<VARIANT>").alias("e")).select(F.coalesce("e.page", F.lit(0)).alias("page"), F.posexplode("e.results").alias("ord", "result"))
    get = lambda p: F.try_variant_get("result", p, "string")
    kept = rows.select(get("$.id").alias("id"), F.coalesce(get("$.parent.block_id"), get("$.parent.page_id")).alias("parent"), "page", "ord", "result").where("id IS NOT NULL")
    pages = kept.select("parent").distinct().join(kept.select(F.col("id").alias("parent")), "parent", "left_anti").where("parent IS NOT NULL")
    nodes = kept.select("id", "parent", "page", "ord").unionByName(pages.select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("page"), F.lit(0).alias("ord")))
    placed = numbered(nodes, ["page", "ord"], "saved")
    tops = placed.join(pages.select(F.col("parent").alias("id")), "id").select(F.col("id").alias("head"), F.col("place").alias("_place"))
    found = placed.join(tops, "head").where(F.col("place") > F.col("_place"))
    typed = blocks(kept.select("result")).select("id", "type", "text", "error")
    out = found.join(kept.select("id", "parent"), "id").join(typed, "id")
    return out.select(F.col("head").alias("root"), (F.col("place") - F.col("_place")).alias("place"), (F.col("depth") - 1).cast("int").alias("depth"), "n_below", "parent", "id", "type", "text", "error")


def page_stats(blocks: DataFrame) -> DataFrame:
    """(root, n_blocks, types): how many blocks each page has and of which types."""
    kind = F.get_json_object("value", "$.type")
    return blocks.groupBy("root").agg(F.count("*").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("types"))
