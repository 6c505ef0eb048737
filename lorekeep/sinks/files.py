"""Files from rows: one file a row, put into place when all tasks have written.

``FileSink`` is a Spark data source for writing.  A task writes its files and a list of them below a temporary
folder of the run; the driver's commit moves them into place, list by list, and an aborted run leaves
nothing.  Makers of contents: JSON and YAML of block trees, Elm modules, Word documents.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_PENDING, _WRITTEN = "_temporary", "_written"


def _store(folder: str):
    """(file system, path) of a folder; folders without a scheme are local ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class TaskFiles(WriterCommitMessage):
    """What the driver gets of a task: where its list of files stands."""

    folder: str | None
    n_files: int


class FileWriter(DataSourceWriter):
    """Writes below <folder>/_temporary/<run> and moves into <folder> at the commit."""

    def __init__(self, folder: str, run: str, overwrite: bool):
        self.folder, self.run, self.overwrite = folder, run, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, place = _store(self.folder)
        own, listed = f"{place}/{_PENDING}/{self.run}/{uuid.uuid4().hex}", []
        for name, content in rows:
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"no file name: {name!r}")
            if not listed:
                store.create_dir(own, recursive=True)
            data = content.encode() if isinstance(content, str) else bytes(content)
            with store.open_output_stream(f"{own}/{len(listed)}") as out:
                out.write(data)
            listed.append(json.dumps({"name": name, "bytes": len(data)}))
        if not listed:
            return TaskFiles(None, 0)
        with store.open_output_stream(f"{own}/list") as out:
            out.write("\n".join(listed).encode())
        return TaskFiles(own, len(listed))

    def commit(self, messages: list) -> None:
        """Moves the files; those of attempts that failed stay in the temporary folder, which is deleted."""
        store, place = _store(self.folder)
        store.create_dir(f"{place}/{_WRITTEN}/{self.run}", recursive=True)
        for task in messages:
            if task is None or task.folder is None:
                continue
            with store.open_input_stream(f"{task.folder}/list") as lines:  # one task's at a time
                listed = lines.read()
            for i, line in enumerate(listed.decode().split("\n")):
                store.move(f"{task.folder}/{i}", f"{place}/{json.loads(line)['name']}")
            store.move(f"{task.folder}/list", f"{place}/{_WRITTEN}/{self.run}/{task.folder.rsplit('/', 1)[1]}")
        self._drop(store, place)

    def abort(self, messages: list) -> None:
        self._drop(*_store(self.folder))

    def _drop(self, store, place: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{place}/{_PENDING}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{place}/{_PENDING}/{self.run}")
            if not store.get_file_info(fs.FileSelector(f"{place}/{_PENDING}")):
                store.delete_dir(f"{place}/{_PENDING}")


class FileSink(DataSource):
    """df.write.format("files").mode("append").save(folder): a file for each row (name, content as binary).

    Files of the same name are replaced.  Names must be unique within a run, which ``write_files`` checks.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex, overwrite)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content as string or binary) to files of the folder, all or none of them; (name, bytes)
    of what was written.  Two rows of one name are an error before anything is written."""
    spark = rows.sparkSession
    twice = rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1 OR name IS NULL").select("name").first()
    if twice is not None:
        raise ValueError(f"several files have the name {twice.name!r}")
    spark.dataSource.register(FileSink)
    run = uuid.uuid4().hex
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("files").option("run", run).mode("append").save(folder)
    return spark.read.schema("name string, bytes long").json(f"{folder}/{_WRITTEN}/{run}")


# Trees as text ----------------------------------------------------------------------------------


def _nested(blocks: pd.DataFrame) -> list[dict]:
    """Blocks of one document as nested objects without nulls."""
    made, roots = {}, []
    for r in blocks.sort_values("uid").to_dict("records"):
        node = {k: (int(v) if isinstance(v, float) else v) for k, v in r.items() if k not in ("doc_id", "parent_uid", "path", "error") and not pd.isna(v) and v != ""}
        made[r["uid"]] = node
        (made[int(r["parent_uid"])].setdefault("blocks", []) if not pd.isna(r["parent_uid"]) else roots).append(node)
    return roots


def yaml_lines(value, indent: int = 0) -> Iterator[str]:
    """Objects, lists and scalars as YAML; texts are quoted as JSON has them, which YAML reads too."""
    pad = "  " * indent
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                yield f"{pad}{k}:"
                yield from yaml_lines(v, indent + 1)
            else:
                yield f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}"
    elif isinstance(value, list):
        for v in value:
            if isinstance(v, (dict, list)) and v:
                lines = list(yaml_lines(v, indent + 1))
                yield f"{pad}- {lines[0].lstrip()}"
                yield from lines[1:]
            else:
                yield f"{pad}- {json.dumps(v, ensure_ascii=False)}"


def tree_texts(blocks: DataFrame, form: str = "json") -> DataFrame:
    """(doc_id, content): each document's blocks as a tree in JSON (indented) or YAML."""
    if form not in ("json", "yaml"):
        raise ValueError(f"unknown form: {form}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = {"doc_id": str(pdf["doc_id"].iloc[0]), "blocks": _nested(pdf)}
        text = json.dumps(tree, ensure_ascii=False, indent=2, default=str) if form == "json" else "\n".join(yaml_lines(tree))
        return pd.DataFrame({"doc_id": [tree["doc_id"]], "content": [text + "\n"]})

    return blocks.where("error IS NULL").groupBy("doc_id").applyInPandas(run, "doc_id string, content string")


# Elm --------------------------------------------------------------------------------------------


def module_name(eid: Column) -> Column:
    """An Elm module's name from a conversation's id: its letters and digits behind "Discourse_", the first one
    upper-case, and D in place of a first one that is no letter."""
    plain = F.regexp_replace(F.coalesce(eid, F.lit("")), r"[^\p{L}\p{N}]", "")
    lead = F.when(plain.rlike(r"^\p{L}"), F.upper(F.substring(plain, 1, 1))).otherwise(F.lit("D"))
    return F.when(plain == "", F.lit("Discourse_Discourse")).otherwise(F.concat(F.lit("Discourse_"), lead, F.substr(plain, F.lit(2))))


def elm_modules(items: DataFrame, titles: DataFrame, types: str) -> DataFrame:
    """(name, content): an Elm module for each discussion.  items: conv_id, seq, item; titles: conv_id, title.
    types: the module that declares the types of messages, such as "Discourse.Types"."""
    from lorekeep.functions.text import elm_string

    listed = items.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]), "\n  , ").alias("body"))
    eid = F.col("conv_id").cast("string")
    rows = titles.join(listed, "conv_id", "left").withColumn("module", module_name(eid))
    content = F.concat(F.lit("content = ("), elm_string(F.coalesce("title", F.lit(""))), F.lit(", "), elm_string(eid), F.lit(", messages)"))
    text = F.concat_ws("\n", F.concat(F.lit("module "), "module", F.lit(" exposing (content)")), F.lit(""), F.lit(f"import {types} as T"), F.lit(""), content, F.lit(""), F.concat(F.lit("messages = [\n  "), F.coalesce("body", F.lit("")), F.lit("\n  ]")), F.lit(""))
    return rows.select(F.concat("module", F.lit(".elm")).alias("name"), text.alias("content"))


# Word -------------------------------------------------------------------------------------------

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{0}" Target="{1}"/></Relationships>'
_TOC = '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText xml:space="preserve"> TOC \\o "1-2" \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
#: Characters that XML cannot hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _style_id(name: str) -> str:
    return name.replace(" ", "")


def word_bytes(blocks: list[tuple[str, str]]) -> bytes:
    """A Word file of paragraphs (style, text), with a table of contents of two levels first."""
    body = [_TOC]
    for style, text in blocks:
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in _UNFIT.sub("", text or "").split("\n"))
        border = '<w:pBdr><w:bottom w:val="single" w:sz="6"/></w:pBdr>' if style == "Rule" else ""
        body.append(f'<w:p><w:pPr><w:pStyle w:val="{escape(_style_id(style))}"/>{border}</w:pPr><w:r>{runs}</w:r></w:p>')
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{escape(_style_id(s))}"><w:name w:val="{escape(s)}"/></w:style>' for s in sorted({s for s, _ in blocks}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (
            ("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format("officeDocument", "word/document.xml")), ("word/_rels/document.xml.rels", _RELS.format("styles", "styles.xml")),
            ("word/document.xml", f"<w:document {_NS}><w:body>{''.join(body)}</w:body></w:document>"), ("word/styles.xml", f"<w:styles {_NS}>{styles}</w:styles>"),
        ):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def word_files(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, content): a Word file for each discussion.  rows: conv_id, seq, place, style, text as
    ``discussion.document_rows`` gives them; titles: conv_id, title, which stands first as Heading 1."""
    from lorekeep.functions.text import document_file_name, safe_file_name

    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place", "style", "text"))).alias("blocks"))
    name = safe_file_name(document_file_name(F.coalesce("title", F.lit("")), F.col("conv_id")))
    joined = titles.join(listed, "conv_id", "left").select(name.alias("name"), "title", "blocks")

    def run(frames):
        for frame in frames:
            made = [word_bytes([("Heading 1", t or ""), *((b["style"], b["text"]) for b in (bs if bs is not None else []))]) for t, bs in zip(frame["title"], frame["blocks"], strict=True)]
            yield pd.DataFrame({"name": frame["name"], "content": made})

    return joined.mapInPandas(run, "name string, content binary")
