"""From walks of messages to discussions: the state machine as windows, and as a fold to check it.

Rows of a walk: conv_id, pos (place in the walk), role, content_type, parts, end_turn, and of decoded messages
steps and response (``content.walk_columns``).  User, system and tool rows are messages of their own.  An
assistant row that ends its turn closes a message, whose steps are those of the code, text and thoughts rows since
the last end, one for each thought; without an end they are dropped.  The message stands where its end row
stands, with the timing of the first row of its turn, even if that has no thoughts.

A message may have a label (a stored summary); renderings take it as the title.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.content import LABELS, PART, STEP, code_blocks, embedded_type, step

#: Kinds of content that open a turn and count as its steps, and what their steps are.
STEPS = {"code": "code", "text": "intermediate", "thoughts": "reflection"}


def response_text(kind: Column, parts: Column) -> Column:
    label = F.when(F.lit(False), F.lit(""))
    for k, v in LABELS.items():
        label = label.when(kind == k, F.lit(v))
    return F.concat(label.otherwise(F.concat(F.lit("OtherContent: "), kind, F.lit(" "))), F.array_join(parts, PART))


def with_steps(walk: DataFrame) -> DataFrame:
    """walk with steps and response: its own, or made from its parts, one step a row."""
    kind, text = F.col("content_type"), F.array_join("parts", PART)
    made = F.coalesce(*[F.when(kind == k, F.array(step(v, text))) for k, v in STEPS.items()], F.array().cast(f"array<struct<{STEP}>>"))
    walk = walk if "steps" in walk.columns else walk.withColumn("steps", made)
    return walk if "response" in walk.columns else walk.withColumn("response", response_text(kind, F.col("parts")))


def segmented(walk: DataFrame) -> DataFrame:
    """walk with segment: how many assistant turns have ended before a row."""
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when((F.col("role") == "assistant") & F.col("end_turn"), 1).otherwise(0)
    return walk.withColumn("segment", F.coalesce(F.sum(ends).over(before), F.lit(0)))


def fold_messages(walk: DataFrame) -> DataFrame:
    """(conv_id, seq, pos, kind, text, n_steps, steps, first_pos) of each message, seq from 1; a step has the
    place of its row and the fields of ``content.STEP``.

    One shuffle by conversation; a turn is put together once, in proportion to its length.
    """
    rows = segmented(with_steps(walk))
    is_end = (F.col("role") == "assistant") & F.col("end_turn")
    is_step = (F.col("role") == "assistant") & ~F.col("end_turn") & F.col("content_type").isin(*STEPS)
    alone = ((F.col("role") == "user") & (F.col("content_type") == "text")) | F.col("role").isin("system", "tool")
    text = (
        F.when(F.col("role") == "assistant", F.col("response"))
        .when(F.col("role") == "user", F.array_join("parts", PART))
        .otherwise(F.concat(F.lit("contents="), F.col("content_type")))
    )
    message = F.struct("pos", F.col("role").alias("kind"), text.alias("text"))
    # a turn's steps are collected once, and only the message that ends it takes them
    turns = rows.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.when(is_step, F.struct("pos", "steps")))).alias("said"),
        F.collect_list(F.when(alone, message)).alias("alone"),
        F.collect_list(F.when(is_end, message)).alias("ends"),
    )
    fields = [f.split(" ")[0] for f in STEP.split(", ")]
    placed = F.flatten(F.transform("said", lambda r: F.transform(r["steps"], lambda s: F.struct(r["pos"].alias("pos"), *[s[n].alias(n) for n in fields]))))
    turns = turns.withColumn("steps", placed).withColumn("begin", F.array_min(F.transform("said", lambda r: r["pos"])))
    told = lambda m, steps, begin: F.struct(m["pos"].alias("pos"), m["kind"].alias("kind"), m["text"].alias("text"), steps.alias("steps"), F.coalesce(begin, m["pos"]).alias("first_pos"))
    found = F.concat(F.transform("alone", lambda m: told(m, F.slice("steps", 1, 0), m["pos"])), F.transform("ends", lambda m: told(m, F.col("steps"), F.col("begin"))))
    found = turns.select("conv_id", F.explode(found).alias("m")).select("conv_id", "m.*")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))
    return found.select("conv_id", seq.alias("seq"), "pos", "kind", "text", F.size("steps").alias("n_steps"), "steps", "first_pos")


def issues(walk: DataFrame) -> DataFrame:
    """(conv_id, pos, issue): user rows without text, and unknown roles."""
    other = F.when((F.col("role") == "user") & (F.col("content_type") != "text"), F.concat(F.lit("unexpected user content: "), F.col("content_type")))
    unknown = other.when(~F.col("role").isin("user", "assistant", "system", "tool"), F.concat(F.lit("unknown role: "), F.col("role")))
    return walk.select("conv_id", "pos", unknown.alias("issue")).where("issue IS NOT NULL")


FOLD_SCHEMA = "conv_id long, seq int, pos long, kind string, text string, n_steps int, first_pos long"


def fold_by_rows(walk: DataFrame) -> DataFrame:
    """The same messages by a fold over each conversation, for branches of any shape and as a check."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, n, first = [], 0, None
        for r in pdf.sort_values("pos").itertuples():
            if r.role == "assistant" and r.end_turn:
                out.append((r.conv_id, len(out) + 1, r.pos, r.role, r.response, n, r.pos if first is None else first))
                n, first = 0, None
            elif r.role == "assistant":
                if r.content_type in STEPS:
                    n, first = n + len(r.steps), r.pos if first is None else first
            elif r.role in ("system", "tool") or (r.role == "user" and r.content_type == "text"):
                out.append((r.conv_id, len(out) + 1, r.pos, r.role, PART.join(r.parts) if r.role == "user" else f"contents={r.content_type}", 0, r.pos))
        return pd.DataFrame(out, columns=["conv_id", "seq", "pos", "kind", "text", "n_steps", "first_pos"])

    return with_steps(walk).groupBy("conv_id").applyInPandas(fold, FOLD_SCHEMA)


def _step_lines(s: Column) -> Column:
    reflection = F.concat(F.lit("---- Reflection ---\n"), s["summary"], F.lit("\n"), s["text"])
    code = F.concat(F.lit("---- Code ("), s["language"], F.lit(") ---\n"), s["text"])
    return F.when(s["kind"] == "reflection", reflection).when((s["kind"] == "code") & s["language"].isNotNull(), code).otherwise(F.concat(F.lit("---- Intermediate ---\n"), s["text"]))


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, transcript) of the messages in order."""
    title = F.initcap("kind")
    steps = F.array_join(F.transform("steps", _step_lines), "\n")
    shown = F.when(F.size("steps") > 0, F.concat(F.lit("---- SubActions ---\n"), steps)).otherwise("")
    answer = F.concat(F.lit("---- Assistant ---\n"), shown, F.lit("\n>>> RESP >>>\n"), F.col("text"))
    line = F.when(F.col("kind") == "assistant", answer).otherwise(F.concat(F.lit("---- "), title, F.lit(" ---\n"), F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("transcript"))


def _label(messages: DataFrame) -> Column:
    return F.col("label") if "label" in messages.columns else F.lit(None).cast("string")


def _elm_step(s: Column) -> Column:
    """A step as a value of the module: by its kind, and code by its language and form."""
    from lorekeep.functions.text import elm_string, elm_triple

    error = lambda *parts: F.concat(F.lit("T.Error "), elm_triple(F.concat(*parts)))
    kind, document = embedded_type(s["text"])
    json = F.when(kind == "document", F.concat(F.lit("T.Document "), elm_triple(document))).when(kind.isNotNull(), error(F.lit("CodeSA: json unknown type: "), kind, F.lit("\n"), document)).otherwise(error(F.lit("CodeSA: json err: no document")))
    other = error(F.lit("CodeSA: "), F.coalesce(s["language"], F.lit("")), F.lit("\n"), F.coalesce(s["format"], F.lit("No response format name")), F.lit("\n"), s["text"])
    return (
        F.when(s["kind"] == "reflection", F.concat(F.lit("T.Reflect "), elm_string(F.coalesce(s["summary"], F.lit(""))), F.lit(" "), elm_triple(s["text"])))
        .when(s["kind"] == "code", F.when(F.lower(s["language"]) == "json", json).otherwise(other))
        .when(s["kind"] == "tool_call", F.concat(F.lit("T.ToolCall "), elm_triple(F.concat(s["summary"], F.lit("\n"), s["text"]))))
        .otherwise(F.concat(F.lit("T.Intermediate "), elm_triple(s["text"])))
    )


def elm_items(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, item): an Elm record for each question and answer, its title the label or else its id;
    ids count all messages."""
    from lorekeep.functions.text import elm_string, elm_triple

    name = F.concat(F.lit("msg_"), F.col("seq"))
    head = lambda kind: F.concat(F.lit("{ id = "), elm_string(name), F.lit(f", kind = T.{kind}, title = "), elm_string(F.coalesce(_label(messages), name)), F.lit(", body = [ "))
    question = F.concat(head("Question"), F.lit("T.Basic "), elm_triple(F.col("text")), F.lit(" ] }"))
    body = F.array_join(F.concat(F.transform("steps", _elm_step), F.array(F.lit("T.LineSep"), F.concat(F.lit("T.Basic "), elm_triple(F.coalesce("text", F.lit("No response")))))), "\n  , ")
    answer = F.concat(head("Answer"), body, F.lit("\n    ] }"))
    return messages.where("kind IN ('user', 'assistant')").select("conv_id", "seq", F.when(F.col("kind") == "user", question).otherwise(answer).alias("item"))


# Stored discussions -----------------------------------------------------------------------------

#: Kinds of messages with a table of their own for their text.
PLAIN = ("user", "system", "tool", "unknown")


def to_tables(messages: DataFrame, titles: DataFrame, issues: DataFrame | None = None, version: str = "") -> dict[str, DataFrame]:
    """Discussions as tables: titles (conv_id, title); messages as ``fold_messages`` gives them, with labels where
    there are any; issues (conv_id, pos, issue).

    Messages, steps and chunks are numbered from 1; keys are "conversation/message" and "conversation/message/step".
    version: states of one discussion may stand side by side, apart by it (``latest_version``); it goes into the keys.
    """
    key = F.concat_ws("/", F.concat(F.col("conv_id").cast("string"), F.lit(f"@{version}" if version else "")), F.col("seq").cast("string"))
    kind = F.when(F.col("kind").isin("assistant", *PLAIN), F.col("kind")).otherwise(F.lit("unknown"))
    rows = messages.select("conv_id", "seq", "pos", "text", "steps", "first_pos", _label(messages).alias("label"), key.alias("message_key"), kind.alias("kind"))
    tables = {"discussion": titles.select("conv_id", "title", F.lit(version).alias("version")), "message": rows.select("message_key", "conv_id", "seq", "kind", "pos", "first_pos", F.lit(version).alias("version"))}
    for name in PLAIN:
        tables[f"{name}_message"] = rows.where(F.col("kind") == name).select("message_key", "text", *(["label"] if name == "user" else []))
    answers = rows.where("kind = 'assistant'")
    tables["assistant_message"] = answers.select("message_key", F.col("message_key").alias("response_key"), "label")
    tables["response"] = answers.select(F.col("message_key").alias("response_key"), "text")
    steps = answers.select("message_key", F.posexplode("steps").alias("i", "s")).select("message_key", (F.col("i") + 1).alias("seq"), "s.*").withColumn("step_key", F.concat_ws("/", "message_key", F.col("seq").cast("string")))
    tables["step"] = steps.select("step_key", "message_key", "seq", "kind", "pos")
    tables["intermediate"] = steps.where("kind = 'intermediate'").select("step_key", "text")
    tables["code"] = steps.where("kind = 'code'").select("step_key", "language", F.col("format").alias("format_name"), "text")
    tables["reflection"] = steps.where("kind = 'reflection'").select("step_key", "summary", F.col("text").alias("content"), "finished")
    tables["reflection_chunk"] = steps.where("kind = 'reflection'").select("step_key", F.posexplode("chunks").alias("i", "text")).select("step_key", (F.col("i") + 1).alias("seq"), "text")
    tables["tool_call"] = steps.where("kind = 'tool_call'").select("step_key", F.col("summary").alias("tool_name"), F.col("text").alias("tool_input"))
    none = messages.sparkSession.createDataFrame([], "conv_id string, pos long, issue string")
    tables["issue"] = (none if issues is None else issues).select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos", "issue")).alias("seq"), F.col("issue").alias("text"), F.lit(version).alias("version"))
    return tables


def latest_version(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the last version of each discussion only; what belongs to a message follows it."""
    last = tables["discussion"].groupBy("conv_id").agg(F.max("version").alias("version"))
    of = lambda name: tables[name].join(last, ["conv_id", "version"], "left_semi")
    return tables | {name: of(name) for name in ("discussion", "message", "issue")}


def stored_steps(tables: dict[str, DataFrame]) -> DataFrame:
    """(message_key, steps): the stored steps of each answer in order; one whose payload is lost has no text.

    Payloads of the four kinds become rows of one form, so that steps meet them in one join.
    """
    chunks = tables["reflection_chunk"].groupBy("step_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]).alias("chunks"))
    none = F.array().cast("array<string>")
    each = {
        "intermediate": tables["intermediate"].select("step_key", "text"),
        "code": tables["code"].select("step_key", "text", "language", F.col("format_name").alias("format")),
        "reflection": tables["reflection"].join(chunks, "step_key", "left").select("step_key", F.col("content").alias("text"), "summary", F.coalesce("chunks", none).alias("chunks"), "finished"),
        "tool_call": tables["tool_call"].select("step_key", F.col("tool_input").alias("text"), F.col("tool_name").alias("summary")),
    }
    payload = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("kind", F.lit(k)) for k, rows in each.items()])
    rows = tables["step"].join(payload, ["step_key", "kind"], "left")
    fields = [f.split(" ")[0] for f in STEP.split(", ")]
    lists = rows.groupBy("message_key").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", *fields))).alias("steps"))
    return lists.withColumn("steps", F.transform("steps", lambda s: F.struct(s["pos"].alias("pos"), *[s[n].alias(n) for n in fields])))


def from_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(conv_id, seq, pos, kind, text, n_steps, steps, first_pos, label, error) of stored discussions; a message or
    step whose payload is missing has an error."""
    answers = tables["assistant_message"].join(tables["response"], "response_key", "left").select("message_key", "text", "label", F.lit("assistant").alias("kind"))
    texts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [answers, *[tables[f"{k}_message"].withColumn("kind", F.lit(k)) for k in PLAIN]])
    lists = stored_steps(tables)
    rows = tables["message"].join(texts, ["message_key", "kind"], "left").join(lists, "message_key", "left")
    rows = rows.withColumn("steps", F.coalesce("steps", F.array().cast(lists.schema["steps"].dataType)))
    lost = F.exists("steps", lambda s: s["text"].isNull())
    error = F.when(F.col("text").isNull(), F.concat(F.lit("no payload of message "), "message_key")).when(lost, F.concat(F.lit("no payload of a step of "), "message_key"))
    return rows.select("conv_id", "seq", "pos", "kind", "text", F.size("steps").alias("n_steps"), "steps", "first_pos", "label", error.alias("error"))


def with_labels(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """messages with the stored labels (conv_id, seq, label), which come before labels of their own."""
    rows = messages.join(stored.select("conv_id", "seq", F.col("label").alias("_label")), ["conv_id", "seq"], "left")
    return rows.withColumn("label", F.coalesce("_label", _label(messages))).drop("_label")


def labelled(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """messages with label: the stored one (conv_id, seq, label), else one made from the text."""
    from lorekeep.functions.text import fallback_one_line

    return with_labels(messages, stored).withColumn("label", F.coalesce("label", fallback_one_line(F.col("text"))))


def generate_labels(messages: DataFrame, label: Callable[[str], str]) -> DataFrame:
    """(conv_id, seq, label, error) by a function from text to label, such as a call of a service: an
    exception becomes the row's error.  The function runs in the tasks, text by text."""

    def run(frames):
        for frame in frames:
            labels, errors = [], []
            for text in frame["text"]:
                try:
                    labels.append(label(text))
                    errors.append(None)
                except Exception as e:  # whatever a service's client raises
                    labels.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"conv_id": frame["conv_id"], "seq": frame["seq"], "label": labels, "error": errors})

    kind = messages.schema["conv_id"].dataType.simpleString()
    return messages.select("conv_id", "seq", "text").mapInPandas(run, f"conv_id {kind}, seq int, label string, error string")


#: Paragraphs before a discussion's messages, and where its issues stand: behind all messages.
_HEAD = [("Heading 1", "Conversation"), ("Body", "(presentation export)")]
_LAST = 2**31 - 1


def _document_step(s: Column) -> Column:
    """A step's paragraphs: an array of (style, text)."""
    block = lambda style, t: F.struct(style.alias("style"), t.alias("text"))
    fixed = lambda style, t: block(F.lit(style), t)
    heading = lambda t: fixed("Heading 3", t)
    code = code_blocks(F.coalesce(s["language"], F.lit("")), s["text"])
    return (
        F.when(s["kind"] == "reflection", F.array(fixed("GF Reflection Summary", F.coalesce(s["summary"], F.lit(""))), fixed("GF Reflection Body", s["text"])))
        .when(s["kind"] == "code", F.concat(F.array(heading(code["header"])), F.transform(code["texts"], lambda t: block(code["style"], t))))
        .when(s["kind"] == "tool_call", F.array(heading(F.lit("Tool call")), fixed("Body", F.concat(F.lit("Tool: "), s["summary"])), fixed("GF Tool Input", s["text"])))
        .otherwise(F.array(heading(F.lit("Intermediate")), fixed("GF Intermediate Body", s["text"])))
    )


def document_rows(messages: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(conv_id, seq, place, style, text): the paragraphs of a discussion's document; system and tool stay out.

    A header has the message's label or else one made from the text.  With issues (conv_id, seq, text) the document
    is whole: what stands before the messages comes first, as message 0, and a list of the issues last.
    """
    from lorekeep.functions.text import fallback_one_line

    style = lambda s, t: F.struct(F.lit(s).alias("style"), t.alias("text"))
    label = F.coalesce(_label(messages), fallback_one_line(F.col("text")))
    user = F.array(style("GF M Header", F.concat(F.lit("Manager> "), label)), style("GF Q Body", F.col("text")))
    answer = F.concat(F.array(style("GF A Header", F.concat(F.lit("Analyst> "), label))), F.flatten(F.transform("steps", _document_step)), F.array(style("GF EndOfReflection", F.lit("end-of-reflection")), style("Rule", F.lit("")), style("GF A Body", F.col("text"))))
    rows = messages.where("kind IN ('user', 'assistant')").withColumn("blocks", F.when(F.col("kind") == "user", user).otherwise(answer))
    rows = rows.select("conv_id", "seq", F.posexplode("blocks").alias("place", "b")).select("conv_id", "seq", "place", "b.style", "b.text")
    if issues is None:
        return rows
    head = messages.select("conv_id").distinct().select("conv_id", F.lit(0).alias("seq"), F.posexplode(F.array(*[style(s, F.lit(t)) for s, t in _HEAD])).alias("place", "b"))
    told = issues.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("said"))
    told = told.select("conv_id", F.lit(_LAST).alias("seq"), F.posexplode(F.concat(F.array(style("Heading 1", F.lit("Issues"))), F.transform("said", lambda i: style("List Bullet", i["text"])))).alias("place", "b"))
    return rows.unionByName(head.unionByName(told).select("conv_id", "seq", "place", "b.style", "b.text"))
