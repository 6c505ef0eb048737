"""Project pages (HTML) to rows, and their groups of conversations."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as tx

#: Classes of the elements that hold an item's fields.
ITEM, TITLE, SUMMARY, DATE = "group/project-item", "font-medium", "text-token-text-secondary", "whitespace-nowrap"
_VOID = {"br", "img", "input", "meta", "link", "hr", "source", "wbr"}


class _Items(HTMLParser):
    """Fields of each item: the first link's target and the text of the first element of each class."""

    def __init__(self):
        super().__init__()
        self.items: list[dict] = []
        self.stack: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        inside = any(f == "item" for _, f in self.stack)
        field = None
        if tag == "li" and ITEM in classes:
            self.items.append({})
            field = "item"
        elif inside:
            item = self.items[-1]
            if tag == "a" and "href" in attrs:
                item.setdefault("href", attrs["href"])
            for name, kind, wanted in (("title", "div", TITLE), ("summary", "div", SUMMARY), ("date", "span", DATE)):
                if tag == kind and wanted in classes and name not in item:
                    item[name] = ""
                    field = name
        if tag not in _VOID:
            self.stack.append((tag, field))

    def handle_endtag(self, tag):
        while self.stack:
            open_tag, _ = self.stack.pop()
            if open_tag == tag:
                break

    def handle_data(self, data):
        for _, field in self.stack:
            if field not in (None, "item"):
                self.items[-1][field] += data


def project_items(html: str) -> list[dict]:
    parser = _Items()
    parser.feed(html)
    return [i for i in parser.items if {"href", "title", "summary", "date"} <= i.keys()]


def read_items(pages: DataFrame, as_of: str) -> DataFrame:
    """(page_id, place, eid, title, summary, last_use) of pages (page_id, html)."""

    def run(frames):
        for frame in frames:
            out = [(p, n, i["href"], i["title"], i["summary"], i["date"]) for p, h in zip(frame["page_id"], frame["html"], strict=True) for n, i in enumerate(project_items(h or ""), 1)]
            yield pd.DataFrame(out, columns=["page_id", "place", "href", "title", "summary", "date"])

    rows = pages.select("page_id", "html").mapInPandas(run, "page_id long, place int, href string, title string, summary string, date string")
    return rows.select("page_id", "place", tx.url_tail(F.col("href")).alias("eid"), tx.strip(F.col("title")).alias("title"), tx.strip(F.col("summary")).alias("summary"), tx.month_day(tx.strip(F.col("date")), as_of).alias("last_use"))


def add_members(members: DataFrame, group: str, items: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (label, eid) with the items' conversations that they lack, and errors (eid, error) for
    items without a conversation."""
    wanted = items.select("eid").distinct()
    known = wanted.join(conversations.select("eid"), "eid", "left_semi").select(F.lit(group).alias("label"), "eid")
    added = members.unionByName(known.join(members, ["label", "eid"], "left_anti"))
    missing = wanted.join(conversations.select("eid"), "eid", "left_anti")
    return added, missing.select("eid", F.concat(F.lit("conversation not found: "), "eid").alias("error"))


def members_of(members: DataFrame, conversations: DataFrame, group: str) -> DataFrame:
    """The conversations (eid and their other columns) that belong to a group."""
    return conversations.join(members.where(F.col("label") == group).select("eid").distinct(), "eid", "left_semi")
