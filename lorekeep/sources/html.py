"""Web pages to ordered blocks, by the fold that Word documents go through.

A page's markup is read once, as browsers do with what is left open: a paragraph ends where the next block begins, an item
where the next item or the list ends, a cell where the next cell does; an end without a beginning is passed over, and
an item outside of a list begins one.  Headings, paragraphs, nested lists, quotes, preformatted text, rules, images and
tables become items of ``docx.fold``.  Scripts, styles and what stands in the head are left out; MathML stays as markup
within its paragraph.

Cases: a null page has no blocks; text in no block is a paragraph; white space is collapsed but in preformatted text;
a list within a cell becomes the cell's paragraphs.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.sources.docx import SCHEMA, Item, fold, rows

_HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: Elements that begin and end a paragraph, and those whose content is not shown.
_BLOCKS = frozenset("p div section article header footer nav main aside figure figcaption address dl dt dd form fieldset body html details summary center".split())
_HIDDEN = frozenset("script style title template noscript".split())
_SPACE = re.compile(r"\s+")
#: Rows and characters of texts after which a task hands blocks on.
_ROWS, _CHARS = 1000, 1 << 20


class _Reader(HTMLParser):
    """frames: the open containers, innermost last, as (tag, item or list of items)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[Item] = []
        self.frames: list[tuple[str, object]] = [("page", self.items)]
        self.words: list[str] = []
        self.block: tuple[str, int | None] = ("paragraph", None)
        self.hidden, self.math = "", 0

    def _into(self) -> list[Item]:
        tag, held = self.frames[-1]
        if tag == "list":  # what stands in a list but in no item is an item
            held.parts.append([])
            return held.parts[-1]
        return held if isinstance(held, list) else self.frames[-2][1]

    def _flush(self) -> None:
        kind, level = self.block
        text = "".join(self.words)
        text = text.strip("\n") if kind == "code" else _SPACE.sub(" ", text).strip()
        if text:
            self._into().append(Item(kind, text, level))
        self.words, self.block = [], ("paragraph", None)

    def _close(self, *tags: str, within: str | None = None) -> bool:
        """Closes the innermost open container of one of the tags with what is open in it; not beyond within."""
        for at in range(len(self.frames) - 1, 0, -1):
            if self.frames[at][0] in tags:
                del self.frames[at:]
                return True
            if self.frames[at][0] == within:
                return False
        return False

    def _open(self, tag: str, held: object) -> None:
        self.frames.append((tag, held))

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if self.math or tag == "math":
            self.math += tag == "math"
            self.words.append(self.get_starttag_text() or "")
        elif tag in _HIDDEN:
            self.hidden = tag
        elif tag == "br":
            self.words.append("\n")
        elif tag in _BLOCKS:
            self._flush()
        elif tag in _HEADINGS or tag == "pre":
            self._flush()
            self.block = ("code", None) if tag == "pre" else ("heading", _HEADINGS[tag])
        elif tag in ("ul", "ol", "blockquote", "table", "hr", "img"):
            self._begin(tag, dict(attrs))
        elif tag == "li":
            self._flush()
            if not self._close("li", within="list") and self.frames[-1][0] != "list":
                self._begin("ul", {})
            self.frames[-1][1].parts.append([])
            self._open("li", self.frames[-1][1].parts[-1])
        elif tag in ("tr", "td", "th"):
            self._cell(tag)

    def _begin(self, tag: str, attrs: dict) -> None:
        self._flush()
        kind = {"ul": "list", "ol": "list", "blockquote": "quote", "table": "table", "hr": "rule", "img": "image"}[tag]
        item = Item(kind, {"table": "[table]", "image": attrs.get("src") or ""}.get(kind, ""))
        self._into().append(item)
        if kind == "list":
            item.attrs["ordered"] = tag == "ol"
            self._open("list", item)
        elif kind == "quote":
            item.parts.append([])
            self._open("quote", item.parts[0])
        elif kind == "table":
            item.attrs["cells"] = []
            self._open("table", item)

    def _cell(self, tag: str) -> None:
        self._flush()
        self._close("cell", within="table")
        if self.frames[-1][0] != "table":
            return
        cells = self.frames[-1][1].attrs["cells"]
        if tag == "tr" or not cells:
            cells.append([])
        if tag != "tr":
            cells[-1].append([])
            self._open("cell", cells[-1][-1])

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = "" if tag == self.hidden else self.hidden
        elif self.math:
            self.math -= tag == "math"
            self.words.append(f"</{tag}>")
        elif tag in _BLOCKS or tag in _HEADINGS or tag == "pre":
            self._flush()
        elif kind := {"ul": "list", "ol": "list", "li": "li", "blockquote": "quote", "table": "table", "td": "cell", "th": "cell"}.get(tag):
            self._flush()
            self._close(kind, within={"li": "list", "cell": "table", "table": None}.get(kind, "cell"))

    def handle_startendtag(self, tag, attrs):
        if not self.hidden and (self.math or tag == "math"):
            self.words.append(self.get_starttag_text() or "")
        else:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def _texts(items: list[Item]) -> list[str]:
    """Texts of items and of what is in them."""
    return [t for i in items for t in ([i.text] if i.text else []) + _texts([x for part in i.parts for x in part])]


def _settle(items: list[Item]) -> None:
    """Cells hold items while they are read, and texts afterwards."""
    for item in items:
        for part in item.parts:
            _settle(part)
        if item.kind == "table":
            item.attrs["cells"] = [[_texts(cell) for cell in row] for row in item.attrs["cells"]]


def page_items(html: str) -> list[Item]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._flush()
    _settle(reader.items)
    return reader.items


def read_pages(pages: DataFrame, key: str = "page_id", nesting: str = "strict", promote: bool = False, complex_as_code: bool = False) -> DataFrame:
    """Blocks of pages (key, html), as ``docx.read_documents`` gives them, with the key as doc_id.

    complex_as_code: a page that is complex (``text.is_complex_html``) is one block of code, as renderings of
    raw markup take it, unless it holds MathML.
    """
    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c, kinds[kind]) for c, kind in (x.split() for x in SCHEMA.split(", "))])
    code = F.lit(complex_as_code) & tx.is_complex_html(F.col("html")) & ~tx.has_mathml(F.col("html"))

    def run(batches):
        # one page at a time: a batch holds thousands of pages, whose blocks take many times their bytes
        out, chars = [], 0
        for batch in batches:
            for doc, html, whole in zip(*batch.columns, strict=True):
                if not html.is_valid:
                    continue
                text = html.as_py()
                for row in rows(doc.as_py(), fold([Item("code", text)] if whole.as_py() else page_items(text), nesting, promote)):
                    out.append(row)
                    chars += len(row["text"] or "")
                    if len(out) >= _ROWS or chars >= _CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return pages.select(F.col(key).cast("string").alias("doc_id"), "html", code.alias("whole")).mapInArrow(run, SCHEMA)
