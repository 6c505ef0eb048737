"""Word documents to ordered blocks: bytes of OOXML to rows, one document at a time.

``read_documents`` maps binary files to rows of blocks.  A file's body is read as a flow of items
(headings, paragraphs, lists, quotes, code, rules, tables), which a fold puts into sections:

* a heading closes open sections: with nesting "reference" down to the level above its parent's, so that
  only jumps of two levels or more nest, with "strict" down to its own level;
* it counts ordinals by level (1, 1.2, ..); a block's stable id hashes the ordinals of its section and the
  start of its text, a heading's those before it was counted;
* items of lists and quotes are folded on their own.  A numbered paragraph in one that is taken for a
  heading escapes with "reference" and closes the section around it; with "strict" it stays inside;
* a list goes under the paragraph or heading right before it, and lists in a row share that host.

``read_paragraphs`` gives the file's own paragraphs with styles, numbering, comments and tracked changes;
``enrich`` puts that on the blocks.  Modes: "fold", "xml" (paragraphs only, flat), "auto" (xml where the
fold fails).  A file that cannot be read gives one row with its error.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\)?\s+([\s\S]*)$", re.ASCII)
SCHEMA = "doc_id string, uid int, parent_uid int, ord int, depth int, path string, ordinals string, kind string, level int, text string, stable_id string, style string, num_id int, list_level int, num_format string, comment string, source_uid int, error string"
PARAGRAPHS = "doc_id string, uid int, kind string, text string, style_id string, style string, outline int, num_id int, list_level int, num_format string, level_text string, comment string, inserted string, deleted string, error string"
SOURCE = "<docx-bytes>"
#: Styles of Word that stand for other kinds than paragraphs.
QUOTES, CODES, TITLES = {"quote", "intense quote", "block text"}, {"source code", "html preformatted"}, {"title": "title", "author": "author", "date": "date"}


def stable_id(key: str, hint: str, source: str = SOURCE) -> str:
    return hashlib.sha256(f"{source}|{key}|{hint[:80]}".encode()).hexdigest()[:12]


@dataclass
class Item:
    """A piece of a body: its kind, text, a heading's level, and for lists and quotes the items of each part."""

    kind: str
    text: str = ""
    level: int | None = None
    parts: list[list[Item]] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)


class Node:
    def __init__(self, kind: str, text: str = "", level: int | None = None, key: str = "", ordinals: str = "", **attrs):
        self.kind, self.text, self.level, self.attrs, self.kids, self.key, self.ordinals = kind, text, level, attrs, [], key, ordinals


class Sections:
    """The fold over a document's items: open sections, innermost last."""

    def __init__(self, nesting: str = "reference", promote: bool = True, levels: str = "one"):
        self.strict, self.promote, self.by_groups = nesting == "strict", promote, levels == "groups"
        self.root = Node("document", level=0, key=stable_id("root", ""))
        self.open = [self.root]
        self.path: list[int] = []

    @property
    def ordinals(self) -> str:
        return ".".join(map(str, self.path))

    def add_all(self, items: list[Item]) -> None:
        for item in items:
            self.add(item)

    def add(self, item: Item) -> None:
        promoted = _NUMBERED.match(item.text) if self.promote and item.kind == "paragraph" else None
        if item.kind == "heading":
            self._heading(item.level or 1, item.text, item.attrs)
        elif promoted:
            self._heading(promoted[1].count(".") + 1 if self.by_groups else 1, promoted[2].strip(), item.attrs)
        elif item.kind in ("list", "quote"):
            nodes = []
            for part in item.parts:
                kids = self._apart(part)
                nodes += kids if item.kind == "quote" else [self._node("list_item", "li", attrs=part[0].attrs if part else {}, kids=kids)]
            hint = "quote" if item.kind == "quote" else "olist" if item.attrs.get("ordered") else "list"
            self.open[-1].kids.append(self._node(item.kind, hint, kids=nodes))
        else:
            hint = {"code": item.text[:48], "rule": "hr", "table": "table"}.get(item.kind, item.text[:64])
            self.open[-1].kids.append(self._node(item.kind, hint, item.text, item.attrs, _table(item)))

    def _node(self, kind: str, hint: str, text: str = "", attrs: dict | None = None, kids: list[Node] | None = None) -> Node:
        node = Node(kind, text, key=stable_id(self.ordinals, hint), ordinals=self.ordinals, **{k: v for k, v in (attrs or {}).items() if k != "ordered"})
        node.kids = kids or []
        return node

    def _heading(self, level: int, text: str, attrs: dict) -> None:
        bound = level if self.strict else max(0, level - 1)
        while len(self.open) > 1 and (self.open[-1].level or 0) >= bound and not (self.strict and self.open[-1].kind == "apart"):
            closed = self.open.pop()
            self.open[-1].kids.append(closed)
        node = Node("heading", text, level, stable_id(self.ordinals, text), **attrs)
        upper = self.path[: max(0, level - 1)]
        self.path = [*upper, self.path[level - 1] + 1 if level <= len(self.path) else 1]
        node.ordinals = self.ordinals
        self.open.append(node)

    def _apart(self, items: list[Item]) -> list[Node]:
        """The nodes of items folded by themselves: what the innermost section then holds."""
        self.open.append(Node("apart", key=stable_id(self.ordinals, "tmp")))
        inner = Sections.add_all if not self.strict else Sections._add_within
        inner(self, items)
        return self.open.pop().kids

    def _add_within(self, items: list[Item]) -> None:
        floor = len(self.open)
        self.add_all(items)
        while len(self.open) > floor:
            closed = self.open.pop()
            self.open[-1].kids.append(closed)

    def finish(self) -> Node:
        while len(self.open) > 1:
            closed = self.open.pop()
            self.open[-1].kids.append(closed)
        _host_lists(self.root)
        return self.root


def _table(item: Item) -> list[Node]:
    """Rows, cells and their paragraphs of a table."""
    rows, number = [], item.attrs.get("source_uid")
    for cells in item.attrs.get("cells", []):
        row = Node("table_row")
        for paragraphs in cells:
            cell = Node("table_cell")
            for p in paragraphs:  # numbered behind the table, as in the file's paragraphs
                number = None if number is None else number + 1
                cell.kids.append(Node("paragraph", p, source_uid=number))
            row.kids.append(cell)
        rows.append(row)
    return rows


def _host_lists(node: Node) -> None:
    kept: list[Node] = []
    for kid in node.kids:
        _host_lists(kid)
        if kid.kind == "list" and kept and kept[-1].kind in ("paragraph", "heading"):
            kept[-1].kids.append(kid)
        else:
            kept.append(kid)
    node.kids = kept


def fold(items: list[Item], nesting: str = "reference", promote: bool = True, levels: str = "one") -> Node:
    sections = Sections(nesting, promote, levels)
    sections.add_all(items)
    return sections.finish()


# The file ---------------------------------------------------------------------------------------


def _run_text(run: ElementTree.Element, deleted: bool = False) -> str:
    """Text of a run; breaks and tabs are blanks."""
    text = f"{_W}delText" if deleted else f"{_W}t"
    return "".join((e.text or "") if e.tag in (text, f"{_W}t") else " " if e.tag in (f"{_W}br", f"{_W}tab", f"{_W}cr") else "-" if e.tag == f"{_W}noBreakHyphen" else "" for e in run)


def _runs(p: ElementTree.Element, tracked: bool) -> Iterator[ElementTree.Element]:
    """Runs of a paragraph and its links; inserted ones too if tracked is set; never deleted ones."""
    for child in p:
        if child.tag == f"{_W}r":
            yield child
        elif child.tag in (f"{_W}hyperlink", f"{_W}smartTag") or (tracked and child.tag == f"{_W}ins"):
            yield from _runs(child, tracked)


def _text(p: ElementTree.Element, tracked: bool = False) -> str:
    return "".join(map(_run_text, _runs(p, tracked)))


def _value(e: ElementTree.Element | None, name: str = "val") -> str | None:
    return None if e is None else e.get(f"{_W}{name}")


def _number(text: str | None) -> int | None:
    """The digits that a text begins with."""
    found = re.match(r"\d+", text or "", re.ASCII)
    return int(found[0]) if found else None


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


class Package:
    """The parts of a file that blocks are made from."""

    def __init__(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            document = _part(archive, "word/document.xml")
            styles, numbers, comments, self.core = (_part(archive, n) for n in ("word/styles.xml", "word/numbering.xml", "word/comments.xml", "docProps/core.xml"))
        if document is None or document.find(f"{_W}body") is None:
            raise ValueError("word/document.xml is missing or has no body")
        self.body = document.find(f"{_W}body")
        self.names = {s.get(f"{_W}styleId"): _value(s.find(f"{_W}name")) for s in (styles if styles is not None else [])}
        self.comments = {c.get(f"{_W}id"): "".join(t.text or "" for t in c.iter(f"{_W}t")) for c in (comments if comments is not None else [])}
        self.numbering: dict[tuple, tuple] = {}
        if numbers is not None:
            levels = {a.get(f"{_W}abstractNumId"): {lvl.get(f"{_W}ilvl"): (_value(lvl.find(f"{_W}numFmt")), _value(lvl.find(f"{_W}lvlText"))) for lvl in a.findall(f"{_W}lvl")} for a in numbers.findall(f"{_W}abstractNum")}
            for n in numbers.findall(f"{_W}num"):
                for level, found in levels.get(_value(n.find(f"{_W}abstractNumId")), {}).items():
                    self.numbering[_number(n.get(f"{_W}numId")), _number(level)] = found

    def elements(self, within: ElementTree.Element | None = None) -> Iterator[ElementTree.Element]:
        """Paragraphs and tables of the body, those in content controls too."""
        for e in self.body if within is None else within:
            if e.tag == f"{_W}sdt":
                for content in e.findall(f"{_W}sdtContent"):
                    yield from self.elements(content)
            elif e.tag in (f"{_W}p", f"{_W}tbl"):
                yield e

    def info(self, p: ElementTree.Element) -> dict:
        """Style, outline, numbering, comments and tracked text of a paragraph."""
        props = p.find(f"{_W}pPr")
        find = lambda name: None if props is None else props.find(f"{_W}{name}")
        style, num = _value(find("pStyle")), find("numPr")
        num_id, level = (None, None) if num is None else (_number(_value(num.find(f"{_W}numId"))), _number(_value(num.find(f"{_W}ilvl"))))
        kind, shown = self.numbering.get((num_id, level), (None, None))
        said = " ".join(self.comments[i] for r in p.iter(f"{_W}commentReference") if (i := r.get(f"{_W}id")) in self.comments)
        tracked = lambda tag: "".join(_run_text(r, tag == "del") for e in p.iter(f"{_W}{tag}") for r in e.iter(f"{_W}r")) or None
        return {
            "style_id": style, "style": self.names.get(style) or style, "outline": _number(_value(find("outlineLvl"))), "num_id": num_id, "list_level": level,
            "num_format": kind, "level_text": shown, "comment": said or None, "inserted": tracked("ins"), "deleted": tracked("del"),
        }

    def cells(self, table: ElementTree.Element) -> list[list[list[str]]]:
        return [[[_text(p).strip() for p in c.findall(f"{_W}p")] for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]


_CARRIED = ("style", "num_id", "list_level", "num_format", "comment")


def _level_of(info: dict) -> int | None:
    """A heading's level, by its outline or its style."""
    named = re.fullmatch(r"(?i)heading ?(\d)", info["style"] or "")
    return int(named[1]) if named else None if info["outline"] is None or info["outline"] > 8 else info["outline"] + 1


def _add_listed(out: list[Item], open_lists: list[tuple], info: dict, item: Item) -> None:
    """Puts a numbered paragraph into its list: one of the same level and number goes on, a deeper one begins a
    list within the last item, and one that is less deep closes the lists below its level."""
    level, number = info["list_level"], info["num_id"]
    while open_lists and (open_lists[-1][0] > level or (open_lists[-1][0] == level and open_lists[-1][1] != number)):
        open_lists.pop()
    if not open_lists or open_lists[-1][0] < level:
        begun = Item("list", attrs={"ordered": info["num_format"] not in (None, "bullet")})
        (open_lists[-1][2].parts[-1] if open_lists else out).append(begun)
        open_lists.append((level, number, begun))
    open_lists[-1][2].parts.append([item])


def flow(package: Package) -> list[Item]:
    """The body's items: numbered paragraphs in a row form lists, nested by level; quoted ones a quote.

    Each item has the number of its paragraph among the file's (``paragraphs``) as source_uid.
    """
    out: list[Item] = []
    body_begun, number, open_lists = False, -1, []
    for e in package.elements():
        number += 1
        if e.tag == f"{_W}tbl":
            cells = package.cells(e)
            out.append(Item("table", "[table]", attrs={"cells": cells, "source_uid": number}))
            number += sum(len(cell) for row in cells for cell in row)
            open_lists = []
            continue
        info = package.info(e)
        text, style, level = _text(e, tracked=True).strip(), (info["style"] or "").lower(), _level_of(info)
        attrs = {k: info[k] for k in _CARRIED} | {"source_uid": number}
        if style in TITLES and not body_begun:
            continue  # of the document, see document_meta
        body_begun = True
        listed = info["num_id"] is not None and info["list_level"] is not None
        if level is None and listed:
            _add_listed(out, open_lists, info, Item("paragraph", text, attrs=attrs))
            continue
        if level is not None:
            out.append(Item("heading", text, level, attrs=attrs))
        elif style in QUOTES and text:
            if not out or out[-1].kind != "quote":
                out.append(Item("quote"))
            out[-1].parts.append([Item("paragraph", text, attrs=attrs)])
        elif any(r.get("hr") == "t" or r.get("{urn:schemas-microsoft-com:office:office}hr") == "t" for r in e.iter()):
            out.append(Item("rule", attrs={"source_uid": number}))
        elif text:
            out.append(Item("code" if style in CODES else "paragraph", text, attrs=attrs))
        else:
            continue  # an empty paragraph parts no list
        open_lists = []
    return out


def paragraphs(package: Package) -> list[dict]:
    """Direct paragraphs and tables as the file has them, numbered from 0."""
    out: list[dict] = []
    for e in package.elements():
        if e.tag == f"{_W}p":
            info = package.info(e)
            out.append({"uid": len(out), "kind": "list_item" if info["num_id"] is not None and info["list_level"] is not None else "paragraph", "text": _text(e), **info})
        else:
            out.append({"uid": len(out), "kind": "table", "text": "[table]"})
            inner = [p for r in e.findall(f"{_W}tr") for c in r.findall(f"{_W}tc") for p in c.findall(f"{_W}p")]
            out += [{"uid": len(out) + i, "kind": "cell", "text": _text(p).strip(), **package.info(p)} for i, p in enumerate(inner)]
    return out


def parse(data: bytes, nesting: str = "reference", promote: bool = True, levels: str = "one") -> Node:
    """The tree of a document's body."""
    return fold(flow(Package(data)), nesting, promote, levels)


def _flat(data: bytes) -> Node:
    root = Node("document")
    root.kids = [Node(p["kind"], p["text"], key=stable_id("", p["text"]), source_uid=p["uid"], **{k: p.get(k) for k in _CARRIED}) for p in paragraphs(Package(data))]
    return root


def rows(doc_id: str, root: Node) -> Iterator[dict]:
    """Blocks of a tree in order, uid 1.. from the first."""
    number, stack = 0, [(k, None, i, 1, "") for i, k in reversed(list(enumerate(root.kids, 1)))]
    while stack:
        node, parent, place, depth, above = stack.pop()
        number += 1
        path = f"{above}{place:06d}"
        yield {"doc_id": doc_id, "uid": number, "parent_uid": parent, "ord": place, "depth": depth, "path": path, "ordinals": node.ordinals, "kind": node.kind, "level": node.level, "text": node.text, "stable_id": node.key, **{k: v for k, v in node.attrs.items() if k != "cells"}}
        stack += [(k, number, i, depth + 1, f"{path}.") for i, k in reversed(list(enumerate(node.kids, 1)))]


_BROKEN = (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError)


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _by_file(files: DataFrame, read, schema: str) -> DataFrame:
    """Rows (dicts) that read makes of each file's path and bytes."""
    names = [c.split() for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            out: list[dict] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                out += read(path, bytes(content))
            found = pd.DataFrame(out, columns=[c for c, _ in names])
            for c, kind in names:
                found[c] = found[c].astype("Int32") if kind == "int" else found[c].astype(object)
            yield found.where(found.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def read_documents(files: DataFrame, nesting: str = "reference", promote: bool = True, mode: str = "fold", levels: str = "one") -> DataFrame:
    """Blocks of files (path, content), as spark.read.format("binaryFile") gives them.

    levels: the level of a numbered paragraph that becomes a heading: "one", or the number of its "groups".
    """
    if mode not in ("fold", "xml", "auto"):
        raise ValueError(f"unknown mode: {mode}")

    def read(path, data):
        try:
            return list(rows(path, _flat(data) if mode == "xml" else parse(data, nesting, promote, levels)))
        except _BROKEN as first:
            if mode != "auto":
                return [{"doc_id": path, "error": _told(first)}]
            try:
                return list(rows(path, _flat(data)))
            except _BROKEN as second:
                return [{"doc_id": path, "error": f"fold: {_told(first)}; xml: {_told(second)}"}]

    return _by_file(files, read, SCHEMA)


def read_paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, uid, kind, text, style_id, style, outline, num_id, list_level, num_format, level_text, comment,
    inserted, deleted, error) of each paragraph in the order of the file."""

    def read(path, data):
        try:
            return [{"doc_id": path, **p} for p in paragraphs(Package(data))]
        except _BROKEN as e:
            return [{"doc_id": path, "error": _told(e)}]

    return _by_file(files, read, PARAGRAPHS)


_DC = "{http://purl.org/dc/elements/1.1/}"


def document_meta(files: DataFrame) -> DataFrame:
    """(doc_id, title, author, date): from the first paragraphs in styles of these names, several joined by
    ", ", else from the file's properties; null where there is none."""

    def read(path, data):
        try:
            package = Package(data)
        except _BROKEN:
            return [{"doc_id": path}]
        found: dict[str, list[str]] = {}
        for e in package.elements():
            name = TITLES.get((package.info(e)["style"] or "").lower()) if e.tag == f"{_W}p" else None
            if name is None:
                break
            found.setdefault(name, []).append(_text(e, tracked=True).strip())
        core = {} if package.core is None else {e.tag: (e.text or "").strip() for e in package.core}
        own = {"title": core.get(f"{_DC}title"), "author": core.get(f"{_DC}creator"), "date": core.get("{http://purl.org/dc/terms/}created")}
        return [{"doc_id": path, **{k: ", ".join(found.get(k, [])) or v or None for k, v in own.items()}}]

    return _by_file(files, read, "doc_id string, title string, author string, date string")


def enrich(blocks: DataFrame, info: DataFrame, level: str = "min", by: str = "source", order: str = "before") -> DataFrame:
    """blocks with the styles and numbering of the file's paragraphs (``read_paragraphs``).

    level: "none", "min" (style and number ids), "full" (number format and text too).  by: "source", the number of
    the paragraph that a block was made from, or "place" among paragraphs and headings, for blocks that do not
    know it; title, code and table paragraphs shift places.  order, by place: a block takes its paragraph "before" the
    blocks under it, or "after" them, which shifts headings.
    """
    if level not in ("none", "min", "full"):
        raise ValueError(f"unknown level: {level}")
    if by not in ("source", "place"):
        raise ValueError(f"unknown join: {by}")
    names = {"none": [], "min": ["style_id", "style", "num_id", "list_level"], "full": ["style_id", "style", "num_id", "list_level", "num_format", "level_text"]}[level]
    found = [F.col(c).alias(f"_{c}") for c in names]
    good = info.where("error IS NULL")
    if by == "source":
        own = good.select("doc_id", F.col("uid").alias("source_uid"), *found)
        joined = blocks.join(own, ["doc_id", "source_uid"], "left")
    else:
        taking = blocks.where(F.col("kind").isin("paragraph", "heading"))
        key = F.col("path") if order == "before" else F.concat("path", F.lit("~"))  # "~" sorts behind the paths below
        place = taking.select("doc_id", "uid", F.row_number().over(Window.partitionBy("doc_id").orderBy(key)).alias("n"))
        own = good.where("kind IN ('paragraph', 'list_item') AND text <> ''")
        own = own.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("uid")).alias("n"), *found)
        joined = blocks.join(place.join(own, ["doc_id", "n"]).drop("n"), ["doc_id", "uid"], "left")
    others = [c for c in blocks.columns if c not in names]
    return joined.select(*others, *[(F.coalesce(c, f"_{c}") if c in blocks.columns else F.col(f"_{c}")).alias(c) for c in names])


def decorate(meta: DataFrame, label: str = "docx", title: str | None = None) -> DataFrame:
    """meta with the label of its format and, if given, another title."""
    return meta.withColumn("format", F.lit(label)).withColumn("title", F.lit(title) if title is not None else F.col("title"))


def images(blocks: DataFrame) -> DataFrame:
    """(doc_id, uid, text) of the blocks that show an image: what attachments are linked to."""
    return blocks.where("kind = 'image'").select("doc_id", "uid", "text")


def child_rows(blocks: DataFrame) -> DataFrame:
    """(key, parent, doc_id, seq_pos, kind, content, attrs) for the block store: keys are (doc_id, uid), for
    stable ids repeat; positions are 1000 apart; attrs are JSON."""
    key = lambda c: F.concat_ws("#", "doc_id", F.col(c).cast("string"))
    attrs = F.to_json(F.struct("style", "num_id", "list_level", "num_format", "comment", "level", "stable_id"))
    good = blocks.where("error IS NULL")
    return good.select(key("uid").alias("key"), F.when(F.col("parent_uid").isNotNull(), key("parent_uid")).alias("parent"), "doc_id", (F.col("ord") * 1000).cast("decimal(38,10)").alias("seq_pos"), "kind", "text", attrs.alias("attrs")).withColumnRenamed("text", "content")


def pretty(blocks: DataFrame) -> DataFrame:
    """(doc_id, uid, line): a bullet for each block, indented by depth."""
    from lorekeep.functions.text import preview

    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("• "), F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(": "), F.coalesce(preview(F.col("text")), F.lit("")))
    return blocks.where("error IS NULL").select("doc_id", "uid", line.alias("line"))


def merge_attributes(own: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """own with its nulls filled from other, and its empty arrays and maps extended by other's."""
    names = [c for c in own.columns if c not in key]
    joined = own.join(other.select(*key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    out = []
    for c in names:
        kind = own.schema[c].dataType.typeName()
        if kind == "array":
            out.append(F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
        elif kind == "map":
            mine, theirs = F.coalesce(c, F.create_map().cast(own.schema[c].dataType)), F.coalesce(f"_{c}", F.create_map().cast(own.schema[c].dataType))
            out.append(F.map_from_entries(F.concat(F.map_entries(mine), F.filter(F.map_entries(theirs), _lacks(mine)))).alias(c))
        else:
            out.append(F.coalesce(c, f"_{c}").alias(c))
    return joined.select(*key, *out)


def _lacks(mine):
    return lambda e: ~F.array_contains(F.map_keys(mine), e["key"])
