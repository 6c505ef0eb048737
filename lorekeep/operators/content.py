"""Contents of exported messages: decoding by kind, their tables, and back.

A message's content is a VARIANT with a ``content_type``; each kind has its own fields, some of them
required.  ``decode`` gives one struct column for each kind (null for the others) and an error where a
required field is missing.  Parts of multimodal contents are decoded the same way, each to a row.

``to_tables`` takes conversations apart into tables with keys made from the export's own ids; ``from_tables``
joins them again.  A content whose payload is missing comes back as kind "unknown".

``walk_columns`` is what the state machine of discussions takes of a decoded message: its steps (code, each
thought by itself, a text between) and its text as an answer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import escape_quotes

#: The fields of each kind of content, with their types; "!" marks required ones.
KINDS = {
    "code": "language string!, response_format_name string, text string!",
    "execution_output": "text string!",
    "multimodal_text": "parts array<variant>!",
    "model_editable_context": "model_set_context string!, repository variant, repo_summary variant, structured_context variant",
    "reasoning_recap": "content string!",
    "system_error": "name string!, text string!",
    "tether_browsing_display": "result string!, summary string, assets variant, tether_id string",
    "tether_quote": "url string!, domain string!, text string!, title string!, tether_id string",
    "text": "parts array<string>!",
    "thoughts": "thoughts array<struct<summary:string;content:string;chunks:array<string>;finished:boolean>>!, source_analysis_msg_id string!",
}
_AUDIO = "expiry_datetime string, asset_pointer string!, size_bytes long!, format string!, tool_audio_direction string, metadata variant?"
#: The fields of each kind of part; "?" marks keys that must be there but may be null.
PARTS = {
    "audio_transcription": "text string!, direction string!, decoding_id string",
    "audio_asset_pointer": _AUDIO,
    "image_asset_pointer": "asset_pointer string!, size_bytes long!, width long!, height long!, fovea variant?, metadata variant",
    "real_time_user_audio_video_asset_pointer": "expiry_datetime string, frames_asset_pointers array<variant>!, video_container_asset_pointer variant, audio_asset_pointer variant!, audio_start_timestamp double",
}
#: What hangs below an image's metadata, and an audio's.
IMAGE_METADATA = "container_pixel_height long?, container_pixel_width long?, sanitized boolean!, gizmo variant, emu_omit_glimpse_image variant, emu_patches_override variant, lpe_keep_patch_ijhw variant, lpe_delta_encoding_channel variant, asset_pointer_link variant, watermarked_asset_pointer variant, is_no_auth_placeholder variant"
DALLE = "gen_id string, prompt string!, seed long, parent_gen_id string, edit_op string, serialization_title string!"
GENERATION = "gen_id string, gen_size string!, seed long, parent_gen_id string, height long!, width long!, transparent_background boolean!, serialization_title string!, orientation string"
AUDIO_METADATA = "start_timestamp variant, end_timestamp variant, pretokenized_vq variant, interruptions variant, original_audio_source variant, transcription variant, word_transcription variant, start double!, end double!"


def _fields(spec: str) -> list[tuple[str, str, str]]:
    """(name, type, mark) of each field."""
    out = []
    for part in spec.split(", "):
        name, kind = part.split(" ", 1)
        mark = kind[-1] if kind[-1] in "!?" else ""
        out.append((name, kind.rstrip("!?").replace(";", ","), mark))
    return out


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _decoded(value: Column, spec: str) -> tuple[Column, Column]:
    """A struct of the fields, and the names of required ones that are missing."""
    fields = _fields(spec)
    found = {name: _get(value, f"$.{name}", kind) for name, kind, _ in fields}
    # texts of JSON are kept for what has no fixed form
    shown = F.struct(*[(F.to_json(found[n]) if k == "variant" else found[n]).alias(n) for n, k, _ in fields])
    absent = [F.when((_get(value, f"$.{n}", "variant") if mark == "?" else found[n]).isNull(), F.lit(n)) for n, _, mark in fields if mark]
    return shown, F.array_compact(F.array(*absent)) if absent else F.array().cast("array<string>")


def _missing(kind: Column, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(kind, F.lit(": missing "), F.array_join(names, ", ")))


def decode(messages: DataFrame, content: str = "content") -> DataFrame:
    """messages with kind, a struct for each of KINDS, other (the map of an unknown kind) and error."""
    value = F.col(content)
    kind = _get(value, "$.content_type", "string")
    out, error = [], F.when(kind.isNull(), F.lit("content_type is missing"))
    for name, spec in KINDS.items():
        fields, names = _decoded(value, spec)
        good = (kind == name) & (F.size(names) == 0)
        out.append(F.when(good, fields).alias(name))
        error = error.when(kind == name, _missing(kind, names))
    other = F.when(kind.isNotNull() & ~kind.isin(*KINDS), open_object(value))
    return messages.select(*[c for c in messages.columns if c not in {"kind", "other", "error", *KINDS}], kind.alias("kind"), *out, other.alias("other"), error.alias("error"))


def open_object(value: Column) -> Column:
    """A JSON object as a map of its keys to texts of JSON."""
    return F.transform_values(_get(value, "$", "map<string,variant>"), lambda _, v: F.to_json(v))


def single_pair(entries: Column) -> Column:
    """(label, value) of a map with one key, null for others."""
    pair = F.map_entries(entries)
    return F.when(F.size(pair) == 1, F.struct(pair[0]["key"].alias("label"), pair[0]["value"].alias("value")))


def parts(decoded: DataFrame, key: list[str]) -> DataFrame:
    """(key.., seq, part_kind, text, a struct for each of PARTS, image_metadata, dalle, generation, audio,
    audio_metadata, error) of the parts of multimodal contents.

    audio is the pointer of an audio part (audio_kind 1) or of the one within a real-time part (2).  A part
    that is neither a text nor of a known kind has an error.
    """
    rows = decoded.where("multimodal_text IS NOT NULL").select(*key, F.posexplode("multimodal_text.parts").alias("seq", "part"))
    value = F.col("part")
    is_text = F.schema_of_variant(value) == "STRING"
    kind = F.when(is_text, F.lit("text")).otherwise(_get(value, "$.content_type", "string"))
    out, error = [], F.when(kind.isNull(), F.lit("part without a content_type"))
    for name, spec in PARTS.items():
        fields, names = _decoded(value, spec)
        out.append(F.when((kind == name) & (F.size(names) == 0), fields).alias(name))
        error = error.when(kind == name, _missing(kind, names))
    error = error.when(~kind.isin("text", *PARTS), F.concat(F.lit("unknown part type: "), kind))
    own = lambda name, path, spec: F.when(_get(value, path, "variant").isNotNull() & (F.size(_decoded(_get(value, path, "variant"), spec)[1]) == 0), _decoded(_get(value, path, "variant"), spec)[0]).alias(name)
    image = lambda name, path, spec: F.when(kind == "image_asset_pointer", own(name, path, spec)).alias(name)
    within = kind == "real_time_user_audio_video_asset_pointer"
    audio = F.when(kind == "audio_asset_pointer", value).when(within, _get(value, "$.audio_asset_pointer", "variant"))
    rows = rows.select(
        *key, "seq", kind.alias("part_kind"), F.when(is_text, _get(value, "$", "string")).alias("text"), *out,
        image("image_metadata", "$.metadata", IMAGE_METADATA), image("dalle", "$.metadata.dalle", DALLE), image("generation", "$.metadata.generation", GENERATION),
        audio.alias("_audio"), F.when(kind == "audio_asset_pointer", 1).when(within, 2).alias("audio_kind"), error.alias("error"),
    )
    pointer, names = _decoded(F.col("_audio"), _AUDIO)
    meta = _get(F.col("_audio"), "$.metadata", "variant")
    shown, lacks = _decoded(meta, AUDIO_METADATA)
    bad = F.when(F.col("_audio").isNotNull() & (F.size(names) > 0), F.concat(F.lit("audio: missing "), F.array_join(names, ", ")))
    rows = rows.withColumn("audio", F.when(F.col("_audio").isNotNull() & (F.size(names) == 0), pointer)).withColumn("audio_metadata", F.when(meta.isNotNull() & (F.size(lacks) == 0), shown))
    return rows.withColumn("error", F.coalesce("error", bad)).drop("_audio")


#: Fields that an exported message must have.
REQUIRED = {"id": "message.id", "author.role": "message.author.role", "content": "message.content", "status": "message.status", "weight": "message.weight", "recipient": "message.recipient"}


def rejected_messages(nodes: DataFrame) -> DataFrame:
    """(conversation_id, id, reason) of nodes whose message lacks a required field or cannot be decoded."""
    rows = decode(nodes.where("message IS NOT NULL").withColumn("content", F.col("message.content")))
    missing = F.array_compact(F.array(*[F.when(F.col(path).isNull(), F.lit(name)) for name, path in REQUIRED.items()]))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise(F.col("error"))
    told = rows.select("conversation_id", "id", reason.alias("reason")).where("reason IS NOT NULL")
    bad = parts(rows, ["conversation_id", "id"]).where("error IS NOT NULL").groupBy("conversation_id", "id").agg(F.min_by("error", "seq").alias("reason"))
    return told.unionByName(bad)


# Tables -----------------------------------------------------------------------------------------


def to_tables(conversations: DataFrame, nodes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, _: rows) -> dict[str, DataFrame]:
    """Conversations (conversation_id, title, create_time, update_time) and their nodes as tables.

    node_key and content_key are "conversation/node"; a content belongs to the message of its node.  keep may
    write rows that many tables are made from, under a name, and gives back what was written.
    """
    key = F.concat_ws("/", "conversation_id", "id")
    rows = nodes.withColumn("node_key", key)
    said = keep(decode(rows.where("message IS NOT NULL").select("node_key", "message", F.col("message.content").alias("content"))), "decoded")
    contents = said.select(F.col("node_key").alias("content_key"), "node_key", F.lit(0).alias("seq"), opaque(F.col("kind")).alias("content_type"))
    tables = {
        "conversations": conversations.select("conversation_id", "title", "create_time", "update_time"),
        "nodes": rows.select("node_key", "conversation_id", "id", F.when(F.col("parent").isNotNull(), F.concat_ws("/", "conversation_id", "parent")).alias("parent_key"), "children"),
        "messages": said.select("node_key", *[F.col(f"message.{c}").alias(c) for c in ("create_time", "update_time", "status", "end_turn", "weight", "recipient", "channel")], F.col("message.id").alias("message_id")),
        "authors": said.where("message.author IS NOT NULL").select("node_key", F.lower("message.author.role").alias("role"), F.col("message.author.name").alias("name")),
        "contents": contents,
        "unknown": said.where("other IS NOT NULL").select(F.col("node_key").alias("content_key"), "other"),
    }
    for kind in KINDS:
        if kind not in ("multimodal_text", "thoughts"):
            tables[kind] = said.where(F.col(kind).isNotNull()).select(F.col("node_key").alias("content_key"), f"{kind}.*")
    tables["thoughts"] = said.where("thoughts IS NOT NULL").select(F.col("node_key").alias("content_key"), F.col("thoughts.source_analysis_msg_id").alias("source_analysis_msg_id"))
    tables["thought"] = said.where("thoughts IS NOT NULL").select(F.col("node_key").alias("content_key"), F.posexplode("thoughts.thoughts").alias("seq", "t")).select("content_key", "seq", "t.*")
    tables["multimodal"] = said.where("multimodal_text IS NOT NULL").select(F.col("node_key").alias("content_key"))
    pieces = parts(said.withColumnRenamed("node_key", "content_key"), ["content_key"])
    part_key = ["content_key", "seq"]
    tables["multimodal_part"] = pieces.select(*part_key, "part_kind", "text", "error")
    tables["audio_pointer"] = pieces.where("audio IS NOT NULL").select(*part_key, "audio_kind", "audio.*")
    for name, column in (("transcription", "audio_transcription"), ("image_pointer", "image_asset_pointer"), ("real_time", PART_REAL_TIME), ("image_metadata", "image_metadata"), ("dalle", "dalle"), ("generation", "generation"), ("audio_metadata", "audio_metadata")):
        found = pieces.where(F.col(column).isNotNull())
        # frames are kept as texts of JSON
        tables[name] = found.select(*part_key, *[(F.transform(f"{column}.{n}", lambda v: F.to_json(v)) if n == "frames_asset_pointers" else F.col(f"{column}.{n}")).alias(n) for n in pieces.schema[column].dataType.names])
    return tables


PART_REAL_TIME = "real_time_user_audio_video_asset_pointer"


def multimodal(tables: dict[str, DataFrame]) -> DataFrame:
    """(content_key, parts): the parts of each multimodal content in order, each with what it points to."""
    key = ["content_key", "seq"]
    side = lambda name, alias=None: tables[name].select(*key, F.struct(*[c for c in tables[name].columns if c not in key]).alias(alias or name))
    audio = tables["audio_pointer"]
    pointer = lambda n, alias: audio.where(F.col("audio_kind") == n).select(*key, F.struct(*[c for c in audio.columns if c not in (*key, "audio_kind")]).alias(alias))
    joins = [side("transcription"), side("image_pointer"), side("image_metadata"), side("dalle"), side("generation"), side("real_time"), side("audio_metadata"), pointer(1, "audio"), pointer(2, "real_time_audio")]
    rows = reduce(lambda left, right: left.join(right, key, "left"), joins, tables["multimodal_part"])
    fields = [c for c in rows.columns if c != "content_key"]
    return rows.groupBy("content_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))


def payloads(tables: dict[str, DataFrame]) -> DataFrame:
    """(content_key, content_type, a struct for each of KINDS and the map other): what contents hold, one row each."""

    def of(kind: str) -> DataFrame:
        if kind == "multimodal_text":
            each = multimodal(tables)
            none = F.array().cast(each.schema["parts"].dataType)
            return tables["multimodal"].join(each, "content_key", "left").select("content_key", F.lit(kind).alias("content_type"), F.struct(F.coalesce("parts", none).alias("parts")).alias(kind))
        if kind == "thoughts":
            each = tables["thought"].groupBy("content_key").agg(F.array_sort(F.collect_list(F.struct("seq", "summary", "content", "chunks", "finished"))).alias("thoughts"))
            none = F.array().cast(each.schema["thoughts"].dataType)
            return tables["thoughts"].join(each, "content_key", "left").select("content_key", F.lit(kind).alias("content_type"), F.struct(F.coalesce("thoughts", none).alias("thoughts"), "source_analysis_msg_id").alias(kind))
        return tables[kind].select("content_key", F.lit(kind).alias("content_type"), F.struct(*[c for c in tables[kind].columns if c != "content_key"]).alias(kind))

    other = tables["unknown"].join(tables["contents"].select("content_key", "content_type"), "content_key").select("content_key", "content_type", "other")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*map(of, KINDS), other])


def from_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(conversation_id, id, parent_key, children, role, name, end_turn, create_time, update_time, content_type,
    kind, a struct for each kind, other) of the stored messages; a message without an author is left out."""
    rows = tables["nodes"].join(tables["messages"], "node_key").join(tables["authors"], "node_key")
    rows = rows.join(tables["contents"].select("content_key", "node_key", "content_type"), "node_key").join(payloads(tables), ["content_key", "content_type"], "left")
    has = reduce(lambda a, k: F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(a), KINDS, F.lit("unknown"))
    return rows.select("conversation_id", "id", "parent_key", "children", "role", "name", "end_turn", "create_time", "update_time", "content_type", has.alias("kind"), *KINDS, "other")


def texts() -> Column:
    """The texts of a decoded message: parts of texts, code, results, the source message's id of thoughts."""
    c = F.col
    one = F.when(c("kind") == "code", c("code.text")).when(c("kind") == "execution_output", c("execution_output.text")).when(c("kind") == "reasoning_recap", c("reasoning_recap.content"))
    one = one.when(c("kind") == "system_error", c("system_error.text")).when(c("kind") == "tether_browsing_display", c("tether_browsing_display.result")).when(c("kind") == "tether_quote", c("tether_quote.text"))
    one = one.when(c("kind") == "model_editable_context", c("model_editable_context.model_set_context")).when(c("kind") == "thoughts", c("thoughts.source_analysis_msg_id"))
    return F.when(c("kind") == "text", c("text.parts")).otherwise(F.array_compact(F.array(one)))


def opaque(kind: Column) -> Column:
    """The content type under which a store keeps a kind: what it has no tables for is opaque."""
    return F.when(kind.isin(*KINDS), kind).otherwise(F.concat(F.lit("unknown:"), F.coalesce(kind, F.lit(""))))


# What discussions take --------------------------------------------------------------------------

#: Between the parts of a text.
PART = " |<part>| "
#: Fixed form of a step of an assistant's turn; kind is code, reflection, intermediate or tool_call.
STEP = "kind string, text string, language string, format string, summary string, chunks array<string>, finished boolean"


def step(kind: str, text: Column, **fields: Column) -> Column:
    """A step with the given fields, others null."""
    own = {"kind": F.lit(kind), "text": text, **fields}
    return F.struct(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ") for f in STEP.split(", "))])


def steps() -> Column:
    """The steps that a decoded message adds to a turn: one of its code or text, and one for each thought."""
    thought = lambda t: step("reflection", t["content"], summary=t["summary"], chunks=F.coalesce(t["chunks"], F.array().cast("array<string>")), finished=t["finished"])
    found = F.when(F.col("kind") == "code", F.array(step("code", F.col("code.text"), language=F.col("code.language"), format=F.col("code.response_format_name"))))
    found = found.when(F.col("kind") == "text", F.array(step("intermediate", F.array_join("text.parts", PART)))).when(F.col("kind") == "thoughts", F.transform("thoughts.thoughts", thought))
    return F.coalesce(found, F.array().cast(f"array<struct<{STEP}>>"))


#: What an answer of each kind begins with.
LABELS = {"text": "", "code": "CodeContent: ", "execution_output": "ExecutionOutputContent: ", "model_editable_context": "ModelEditableContent: ", "multimodal_text": "MultimodalTextContent: ", "reasoning_recap": "ReasoningRecapContent: ", "system_error": "SystemErrorContent: ", "tether_browsing_display": "TetherBrowsingDisplayContent: ", "tether_quote": "TetherQuoteContent: ", "thoughts": "ThoughtsContent: "}


def response(tag: Column) -> Column:
    """A decoded message's text as an answer, tag being its content type.  Parts of multimodal contents and unknown ones are shown as JSON,
    an absent summary or asset as Nothing."""
    c = F.col
    shown = {
        "system_error": F.concat_ws(" ", "system_error.name", "system_error.text"),
        "tether_browsing_display": F.concat_ws(" ", "tether_browsing_display.result", *[F.coalesce(c(f"tether_browsing_display.{n}"), F.lit("Nothing")) for n in ("summary", "assets")], F.coalesce(c("tether_browsing_display.tether_id"), F.lit("No tetherID"))),
        "tether_quote": F.concat_ws(" ", *[f"tether_quote.{n}" for n in ("url", "domain", "text", "title")], F.coalesce(c("tether_quote.tether_id"), F.lit("No tetherID"))),
        "multimodal_text": F.to_json("multimodal_text.parts"),
    }
    text = F.when(F.lit(False), F.lit(""))
    for kind, label in LABELS.items():
        text = text.when(c("kind") == kind, F.concat(F.lit(label), shown.get(kind, F.array_join(texts(), PART))))
    raw = F.transform(F.array_sort(F.map_entries("other")), lambda e: F.concat(F.lit('"'), escape_quotes(e["key"]), F.lit('":'), e["value"]))
    return text.otherwise(F.concat(F.lit("OtherContent: "), F.regexp_replace(tag, "^unknown:", ""), F.lit(" {"), F.coalesce(F.array_join(raw, ","), F.lit("")), F.lit("}")))


def walk_columns(stored: bool = False) -> list[Column]:
    """content_type, parts, steps and response of decoded or stored messages, for ``discussion.fold_messages``."""
    tag = F.col("content_type") if stored else opaque(F.col("kind"))
    return [tag.alias("content_type"), texts().alias("parts"), steps().alias("steps"), response(tag).alias("response")]


# Code of assistants -----------------------------------------------------------------------------


def embedded_document(text: Column) -> Column:
    """The content of a JSON document {name, type, content} within a text; null if it is none."""
    return embedded_type(text)[1]


def embedded_type(text: Column) -> tuple[Column, Column]:
    """Type and content of a JSON document {name, type, content} within a text; null if it is none."""
    found = F.from_json(text, "name string, type string, content string")
    whole = found["name"].isNotNull() & found["type"].isNotNull() & found["content"].isNotNull()
    return F.when(whole, found["type"]), F.when(whole, found["content"])


def search_queries(text: Column) -> Column:
    """The questions of {search_query: [{q}]} within a text; null if it is none."""
    found = F.from_json(text, "search_query array<struct<q: string>>")["search_query"]
    asked = F.transform(found, lambda q: q["q"])
    return F.when(~F.exists(asked, lambda q: q.isNull()), asked)


def code_blocks(language: Column, text: Column) -> Column:
    """How a piece of code is shown: struct(header, style, texts)."""
    low, document, asked = F.lower(language), embedded_document(text), search_queries(text)
    block = lambda header, style, texts: F.struct(header.alias("header"), style.alias("style"), texts.alias("texts"))
    bad = block(F.lit("Code"), F.lit("Paragraph"), F.array(F.concat(language, F.lit(" err: no document"))))
    shown = F.when(low == "json", F.when(document.isNotNull(), block(F.lit("Document"), F.lit("Text Block"), F.array(document))).otherwise(bad))
    shown = shown.when(low == "html", block(F.lit("HTML"), F.lit("HTML Block"), F.array(text))).when(low == "python", block(F.lit("Python"), F.lit("Python Block"), F.array(text)))
    shown = shown.when(asked.isNotNull(), block(F.lit("Search"), F.lit("CodeQuerySearch Block"), asked))
    return shown.otherwise(block(F.concat(F.lit("Code ("), language, F.lit(")")), F.lit("GF Code Block"), F.array(text)))
