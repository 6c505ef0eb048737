"""Decoded contents, stored conversations and discussions, and branching walks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import content, conversation, discussion
from lorekeep.operators.numbering import scratch_folder
from lorekeep.plans.adapters import table
from lorekeep.plans.conversations import ESCAPED as _ESC
from lorekeep.plans.conversations import TRIPLE as _TRIPLE

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Kinds of content, by (turn + conv_id) % 9.
_KINDS = ["text", "text", "code", "thoughts", "execution_output", "brand_new", "multimodal_text", "tether_quote", "system_error"]
_LANGUAGES = ["Python", "json", "sql", "html"]
_CASE = lambda value, names: f"CASE {value} {' '.join(f'WHEN {i} THEN {n!r}' for i, n in enumerate(names))} END"
#: Turns as messages of all kinds: assistants speak three turns of four, tools some, and every fourth turn ends one.
_ROLE = "CASE WHEN turn % 4 = 0 THEN lower(role) WHEN turn % 8 = 6 THEN 'tool' ELSE 'assistant' END"
_TYPE = "CASE WHEN conv_id % 8 = 5 THEN 'other' ELSE 'document' END"
_MIXED = f"""SELECT conv_id, turn, {_ROLE} AS role, text, {_CASE("(turn + conv_id) % 9", _KINDS)} AS kind, {_CASE("conv_id % 4", _LANGUAGES)} AS language, {_TYPE} AS type FROM conversations"""
_CODE_TEXT = """CASE language WHEN 'json' THEN '{"name":"n","type":"' || type || '","content":' || CAST(to_json(text) AS VARCHAR) || '}' ELSE text END"""
_IMAGE = """'{{"asset_pointer":"i://' || {0} || '","content_type":"image_asset_pointer","fovea":null,"height":4,"size_bytes":' || {0} || ',"width":3}}'"""
_SHOWN = f"CASE kind WHEN 'text' THEN text || ' |<part>| ' || role WHEN 'code' THEN {_CODE_TEXT} WHEN 'thoughts' THEN 'src-' || turn WHEN 'brand_new' THEN '' WHEN 'multimodal_text' THEN '' ELSE text END"


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """Messages with contents as an export has them: several kinds and languages, none to three thoughts a message."""
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", f"{_ROLE} AS role", f"{_CASE('(turn + conv_id) % 9', _KINDS)} AS kind", f"{_CASE('conv_id % 4', _LANGUAGES)} AS language", f"{_TYPE} AS type")
    c, none, lit = F.col, F.lit(None), F.lit
    text = F.to_json(F.struct(c("text").alias("t"))).substr(lit(6), F.length(F.to_json(F.struct(c("text").alias("t")))) - 6)  # as JSON has it
    document = F.concat(lit('{"name":"n","type":"'), "type", lit('","content":'), text, lit("}"))
    thought = lambda i: F.struct(
        F.concat(lit("s"), i, lit(" of "), "turn").alias("summary"), F.concat("text", lit(" #"), i).alias("content"), F.when(i % 2 == 1, F.array("role")).alias("chunks"), F.when(i == 1, lit(True)).alias("finished")
    )
    thoughts = F.when(c("turn") % 4 > 0, F.transform(F.sequence(lit(1), F.greatest(c("turn").cast("int") % 4, lit(1))), thought)).otherwise(F.array().cast("array<struct<summary:string,content:string,chunks:array<string>,finished:boolean>>"))
    tag = c("kind").alias("content_type")
    content_json = (
        F.when(c("kind") == "text", F.to_json(F.struct(tag, F.array("text", "role").alias("parts"))))
        .when(c("kind") == "code", F.to_json(F.struct(tag, "language", F.when(c("turn") % 2 == 0, lit("f")).alias("response_format_name"), F.when(c("language") == "json", document).otherwise(c("text")).alias("text"))))
        .when(c("kind") == "thoughts", F.to_json(F.struct(tag, thoughts.alias("thoughts"), F.concat(lit("src-"), "turn").alias("source_analysis_msg_id"))))
        .when(c("kind") == "multimodal_text", F.concat(lit('{"content_type":"multimodal_text","parts":['), text, lit(","), F.expr(_IMAGE.format("turn")), lit("]}")))
        .when(c("kind") == "tether_quote", F.to_json(F.struct(tag, lit("u").alias("url"), lit("d").alias("domain"), "text", lit("ti").alias("title"))))
        .when(c("kind") == "system_error", F.to_json(F.struct(tag, lit("n").alias("name"), "text")))
        .when(c("kind") == "brand_new", F.to_json(F.struct(tag, F.struct(c("turn").alias("y")).alias("x"))))
        .otherwise(F.to_json(F.struct(tag, "text")))
    )
    said = F.struct(
        F.concat(lit("m"), "turn").alias("id"), F.struct(c("role").alias("role"), none.cast("string").alias("name")).alias("author"), none.cast("double").alias("create_time"), none.cast("double").alias("update_time"), lit("ok").alias("status"),
        (c("turn") % 4 == 3).alias("end_turn"), lit(1.0).alias("weight"), lit("all").alias("recipient"), none.cast("string").alias("channel"), F.parse_json(content_json).alias("content"),
    )
    parent = F.when(c("turn") > 0, F.concat(lit("t"), c("turn") - 1))
    return rows.select(c("conv_id").cast("string").alias("conversation_id"), F.concat(lit("t"), "turn").alias("id"), parent.alias("parent"), F.array().cast("array<string>").alias("children"), said.alias("message"))


def _heads(nodes: DataFrame) -> DataFrame:
    return nodes.selectExpr("conversation_id", "'t' AS title", "0.0D AS create_time", "0.0D AS update_time").distinct()


def _keeper(spark: SparkSession):
    """A function that writes rows under a name and reads them again."""
    place = scratch_folder(spark, "stored")

    def keep(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{place}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{place}/{name}")

    return keep


def _stored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of the exported conversations, written and read again."""
    keep = _keeper(spark)
    nodes = keep(_exported(spark, d), "exported")
    return {name: keep(rows, name) for name, rows in content.to_tables(_heads(nodes), nodes, keep).items()}


@query(f"WITH m AS ({_MIXED}) SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 't' || turn AS id, kind, {_SHOWN} AS shown, CASE WHEN kind = 'code' THEN language END AS language, CAST(CASE WHEN kind = 'thoughts' THEN turn % 4 ELSE -1 END AS INTEGER) AS n_thoughts, kind = 'brand_new' AS is_other FROM m")
def content_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = content.decode(_exported(spark, d).withColumn("content", F.col("message.content"))).where("error IS NULL")
    return rows.select("conversation_id", "id", "kind", F.array_join(content.texts(), content.PART).alias("shown"), F.col("code.language").alias("language"), F.coalesce(F.size("thoughts.thoughts"), F.lit(-1)).alias("n_thoughts"), F.col("other").isNotNull().alias("is_other"))


@query(f"WITH m AS ({_MIXED}) SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 't' || turn AS id, role, CASE WHEN kind = 'brand_new' THEN 'unknown' ELSE kind END AS kind, {_SHOWN} AS shown, CAST(CASE WHEN kind = 'multimodal_text' THEN 2 ELSE 0 END AS INTEGER) AS n_parts, CASE WHEN kind = 'brand_new' THEN '{{\"y\":' || turn || '}}' END AS raw FROM m")
def stored_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = content.from_tables(_stored(spark, d))
    n_parts = F.when(F.col("multimodal_text").isNotNull(), F.size("multimodal_text.parts")).otherwise(0)
    return rows.select("conversation_id", "id", "role", "kind", F.array_join(content.texts(), content.PART).alias("shown"), n_parts.alias("n_parts"), F.col("other")["x"].alias("raw"))


@query(f"WITH m AS ({_MIXED}) SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 't' || turn AS id, CASE WHEN kind = 'brand_new' THEN 'unknown:brand_new' ELSE kind END AS content_type, CAST(CASE WHEN kind = 'thoughts' THEN turn % 4 ELSE 0 END AS INTEGER) AS n FROM m")
def stored_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents joined with their nodes, and how many thoughts each has."""
    nodes = _exported(spark, d)
    tables = content.to_tables(_heads(nodes), nodes)
    n = tables["thought"].groupBy("content_key").agg(F.count("*").cast("int").alias("n"))
    rows = tables["contents"].join(tables["nodes"], "node_key").join(n, "content_key", "left")
    return rows.select("conversation_id", "id", "content_type", F.coalesce("n", F.lit(0)).alias("n"))


def _walk(spark: SparkSession, d: str) -> DataFrame:
    """Mixed contents as the state machine takes them."""
    rows = content.decode(_exported(spark, d).withColumn("content", F.col("message.content")))
    pos = F.substring("id", 2, 10).cast("long")
    return rows.select(F.col("conversation_id").cast("long").alias("conv_id"), pos.alias("pos"), F.lower("message.author.role").alias("role"), *content.walk_columns(), F.col("message.end_turn").alias("end_turn"))


def _labelled(messages: DataFrame) -> DataFrame:
    """Every third message has a label."""
    return messages.withColumn("label", F.when((F.col("conv_id") + F.col("seq")) % 3 == 0, F.concat(F.lit("label "), "seq")))


_RESPONSE = f"""CASE kind WHEN 'text' THEN '' WHEN 'code' THEN 'CodeContent: ' WHEN 'execution_output' THEN 'ExecutionOutputContent: ' WHEN 'thoughts' THEN 'ThoughtsContent: ' WHEN 'system_error' THEN 'SystemErrorContent: n ' WHEN 'tether_quote' THEN 'TetherQuoteContent: u d '
    WHEN 'multimodal_text' THEN 'MultimodalTextContent: [' || CAST(to_json(text) AS VARCHAR) || ',' || {_IMAGE.format("turn")} || ']' ELSE 'OtherContent: brand_new {{"content_type":"brand_new","x":{{"y":' || turn || '}}}}' END || shown || CASE WHEN kind = 'tether_quote' THEN ' ti No tetherID' ELSE '' END"""
#: Messages (conv_id, seq, pos, kind, text, n_steps, first_pos) and their steps (conv_id, seq, pos, i, kind, text, language, format, summary, chunks, finished).
_FOLD = f"""m AS ({_MIXED}),
  seg AS (SELECT *, turn AS pos, {_SHOWN} AS shown, role = 'assistant' AND turn % 4 = 3 AS end_turn,
    coalesce(sum(CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM m),
  said AS (SELECT * FROM seg WHERE role = 'assistant' AND NOT end_turn AND kind IN ('code', 'text', 'thoughts')),
  part AS (SELECT conv_id, segment, pos, 1 AS i, CASE kind WHEN 'code' THEN 'code' ELSE 'intermediate' END AS kind, shown AS text, text AS raw, type, CASE WHEN kind = 'code' THEN language END AS language, CASE WHEN kind = 'code' AND pos % 2 = 0 THEN 'f' END AS format, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR[]) AS chunks, CAST(NULL AS BOOLEAN) AS finished FROM said WHERE kind <> 'thoughts'
    UNION ALL SELECT conv_id, segment, pos, i, 'reflection', text || ' #' || i, text, type, NULL, NULL, 's' || i || ' of ' || turn, CASE WHEN i % 2 = 1 THEN [role] ELSE [] END, CASE WHEN i = 1 THEN true END FROM (SELECT *, unnest(range(1, turn % 4 + 1)) AS i FROM said WHERE kind = 'thoughts')),
  begin AS (SELECT conv_id, segment, min(pos) AS first_pos FROM said GROUP BY ALL),
  count AS (SELECT conv_id, segment, count(*) AS n FROM part GROUP BY ALL),
  message AS (SELECT s.conv_id, s.segment, CAST(row_number() OVER (PARTITION BY s.conv_id ORDER BY pos) AS INTEGER) AS seq, CAST(pos AS BIGINT) AS pos, role AS kind,
    CASE WHEN role = 'assistant' THEN {_RESPONSE} WHEN role = 'user' THEN shown WHEN kind = 'brand_new' THEN 'contents=unknown:brand_new' ELSE 'contents=' || kind END AS text,
    CAST(CASE WHEN end_turn THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_steps, CAST(CASE WHEN end_turn THEN coalesce(first_pos, pos) ELSE pos END AS BIGINT) AS first_pos
    FROM seg s LEFT JOIN count t ON t.conv_id = s.conv_id AND t.segment = s.segment LEFT JOIN begin b ON b.conv_id = s.conv_id AND b.segment = s.segment WHERE end_turn OR (role = 'user' AND kind = 'text') OR role IN ('system', 'tool')),
  step AS (SELECT p.*, m.seq FROM part p JOIN message m ON m.conv_id = p.conv_id AND m.segment = p.segment AND m.kind = 'assistant'),
  told AS (SELECT *, CASE WHEN (conv_id + seq) % 3 = 0 THEN 'label ' || seq END AS label FROM message)"""
_STEPS = """SELECT conv_id, seq, string_agg(concat_ws('/', pos, kind, coalesce(language, '-'), coalesce(format, '-'), coalesce(summary, '-'), text, array_to_string(coalesce(chunks, []), ','), coalesce(CAST(finished AS VARCHAR), '-')), chr(10) ORDER BY pos, i) AS steps FROM step GROUP BY ALL"""
_MESSAGE = ["conv_id", "seq", "pos", "kind", "text", "n_steps", "steps", "first_pos"]
_SHOWN_MESSAGES = f"SELECT {', '.join('coalesce(s.steps, chr(45)) AS steps' if c == 'steps' else f'm.{c}' for c in _MESSAGE)} %s FROM told m LEFT JOIN ({_STEPS}) s ON s.conv_id = m.conv_id AND s.seq = m.seq"


def _shown(messages: DataFrame) -> DataFrame:
    say = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    each = F.transform("steps", lambda s: F.concat_ws("/", s["pos"].cast("string"), s["kind"], say(s["language"]), say(s["format"]), say(s["summary"]), s["text"], F.array_join(F.coalesce(s["chunks"], F.array().cast("array<string>")), ","), say(s["finished"])))
    return messages.withColumn("steps", F.when(F.size("steps") > 0, F.array_join(each, "\n")).otherwise("-"))


@query(f"WITH {_FOLD} {_SHOWN_MESSAGES % ''}")
def fsm_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _shown(discussion.fold_messages(_walk(spark, d))).select(*_MESSAGE)


@query("SELECT conv_id, CAST(turn AS BIGINT) AS pos, 'unexpected user content: ' || CASE WHEN kind = 'brand_new' THEN 'unknown:brand_new' ELSE kind END AS issue FROM (" + _MIXED + ") WHERE role = 'user' AND kind <> 'text'")
def fsm_mixed_issues(spark: SparkSession, d: str) -> DataFrame:
    return discussion.issues(_walk(spark, d))


def _stored_discussions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    messages = _keeper(spark)(_labelled(discussion.fold_messages(_walk(spark, d))), "messages")  # many tables are made from them
    return discussion.to_tables(messages, messages.select("conv_id", F.lit("t").alias("title")).distinct())


@query(f"WITH {_FOLD} {_SHOWN_MESSAGES % ', m.label, CAST(NULL AS VARCHAR) AS error'}")
def stored_discussions(spark: SparkSession, d: str) -> DataFrame:
    return _shown(discussion.from_tables(_stored_discussions(spark, d))).select(*_MESSAGE, F.when(F.col("kind").isin("user", "assistant"), F.col("label")).otherwise(F.when((F.col("conv_id") + F.col("seq")) % 3 == 0, F.concat(F.lit("label "), "seq"))).alias("label"), "error")


@query(f"WITH {_FOLD} SELECT conv_id, kind, count(*) AS n, count(*) FILTER (kind = 'assistant') AS n_lost FROM message GROUP BY ALL")
def stored_discussions_broken(spark: SparkSession, d: str) -> DataFrame:
    """The same with all answers lost: each assistant's message is an error and not a null."""
    tables = _stored_discussions(spark, d)
    rows = discussion.from_tables({**tables, "response": tables["response"].where(F.lit(False))})
    return rows.groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("error").startswith("no payload of message")).alias("n_lost"))


_T = lambda text: _TRIPLE.format(_ESC.format(text))
_ELM_STEP = f"""CASE kind WHEN 'reflection' THEN 'T.Reflect "' || summary || '" ' || {_T("text")} WHEN 'intermediate' THEN 'T.Intermediate ' || {_T("text")}
  ELSE CASE WHEN language <> 'json' THEN 'T.Error ' || {_T("('CodeSA: ' || language || chr(10) || coalesce(format, 'No response format name') || chr(10) || text)")}
    WHEN type = 'document' THEN 'T.Document ' || {_T("raw")} ELSE 'T.Error ' || {_T("('CodeSA: json unknown type: other' || chr(10) || raw)")} END END"""


@query(f"""WITH {_FOLD}, st AS (SELECT conv_id, seq, string_agg({_ELM_STEP}, chr(10) || '  , ' ORDER BY pos, i) AS s FROM step GROUP BY ALL),
  h AS (SELECT *, '{{ id = "msg_' || seq || '", kind = T.' AS head, ', title = "' || coalesce(label, 'msg_' || seq) || '", body = [ ' AS rest FROM told WHERE kind IN ('user', 'assistant'))
  SELECT h.conv_id, h.seq, CASE kind WHEN 'user' THEN head || 'Question' || rest || 'T.Basic ' || {_T("text")} || ' ] }}'
    ELSE head || 'Answer' || rest || coalesce(s || chr(10) || '  , ', '') || 'T.LineSep' || chr(10) || '  , T.Basic ' || {_T("text")} || chr(10) || '    ] }}' END AS item
  FROM h LEFT JOIN st ON st.conv_id = h.conv_id AND st.seq = h.seq""")
def elm_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers with steps of all kinds, titled by stored labels."""
    return discussion.elm_items(discussion.from_tables(_stored_discussions(spark, d)))


_ONE_LINE = r"""array_to_string(string_split(CASE WHEN length({0}) <= 120 THEN {0} ELSE substr({0}, 1, 119) || '…' END, ' ')[1:14], ' ')""".format(r"trim(regexp_replace(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 600), '\s+', ' ', 'g'))")
_DOCX_STEP = """CASE kind WHEN 'reflection' THEN [{'style': 'GF Reflection Summary', 'text': summary}, {'style': 'GF Reflection Body', 'text': text}]
  WHEN 'intermediate' THEN [{'style': 'Heading 3', 'text': 'Intermediate'}, {'style': 'GF Intermediate Body', 'text': text}]
  ELSE CASE language WHEN 'json' THEN [{'style': 'Heading 3', 'text': 'Document'}, {'style': 'Text Block', 'text': raw}] WHEN 'html' THEN [{'style': 'Heading 3', 'text': 'HTML'}, {'style': 'HTML Block', 'text': text}]
    WHEN 'Python' THEN [{'style': 'Heading 3', 'text': 'Python'}, {'style': 'Python Block', 'text': text}] ELSE [{'style': 'Heading 3', 'text': 'Code (sql)'}, {'style': 'GF Code Block', 'text': text}] END END"""


@query(f"""WITH {_FOLD}, issue AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, 'unexpected user content: ' || CASE WHEN kind = 'brand_new' THEN 'unknown:brand_new' ELSE kind END AS text FROM m WHERE role = 'user' AND kind <> 'text'),
  st AS (SELECT conv_id, seq, flatten(list({_DOCX_STEP} ORDER BY pos, i)) AS s FROM step GROUP BY ALL),
  block AS (SELECT told.conv_id, told.seq, CASE kind WHEN 'user' THEN [{{'style': 'GF M Header', 'text': 'Manager> ' || coalesce(label, {_ONE_LINE})}}, {{'style': 'GF Q Body', 'text': text}}]
      ELSE [{{'style': 'GF A Header', 'text': 'Analyst> ' || coalesce(label, {_ONE_LINE})}}] || coalesce(s, []) || [{{'style': 'GF EndOfReflection', 'text': 'end-of-reflection'}}, {{'style': 'Rule', 'text': ''}}, {{'style': 'GF A Body', 'text': text}}] END AS b
    FROM told LEFT JOIN st ON st.conv_id = told.conv_id AND st.seq = told.seq WHERE kind IN ('user', 'assistant')
    UNION ALL SELECT DISTINCT conv_id, 0, [{{'style': 'Heading 1', 'text': 'Conversation'}}, {{'style': 'Body', 'text': '(presentation export)'}}] FROM told
    UNION ALL SELECT conv_id, 2147483647, [{{'style': 'Heading 1', 'text': 'Issues'}}] || list({{'style': 'List Bullet', 'text': text}} ORDER BY seq) FROM issue GROUP BY conv_id)
  SELECT conv_id, CAST(seq AS INTEGER) AS seq, CAST(place AS INTEGER) AS place, b.style AS style, b.text AS text FROM (SELECT conv_id, seq, unnest(b) AS b, unnest(range(len(b))) AS place FROM block)""")
def docx_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of whole documents: headers by label, steps by kind and language, issues."""
    keep = _keeper(spark)
    walk = keep(_walk(spark, d), "walk")
    messages = keep(_labelled(discussion.fold_messages(walk)), "messages")
    tables = discussion.to_tables(messages, messages.select("conv_id", F.lit("t").alias("title")).distinct(), discussion.issues(walk))
    return discussion.document_rows(discussion.from_tables(tables), tables["issue"])


_TREE = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  w AS (SELECT conv_id, k, CAST(1 AS INTEGER) AS depth, [0] AS path FROM t WHERE k = 1
    UNION ALL SELECT t.conv_id, t.k, CAST(w.depth + 1 AS INTEGER), list_append(w.path, CASE WHEN t.k % 2 = 1 THEN 0 ELSE 1 END) FROM w JOIN t ON t.conv_id = w.conv_id AND t.k // 2 = w.k)"""


def _branches(spark: SparkSession, d: str) -> DataFrame:
    """Turns as a tree in which k // 2 is above k; the first node also names a child that is not there."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), k.alias("k"))
    name = lambda x: F.concat(F.lit("k"), x.cast("string"))
    size = F.count("*").over(Window.partitionBy("conversation_id"))
    below = F.filter(F.array(F.col("k") * 2, F.col("k") * 2 + 1), lambda x: x <= F.col("size"))
    children = F.concat(F.transform(below, lambda x: name(x)), F.when(F.col("k") == 1, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("size", size).select("conversation_id", name(F.col("k")).alias("id"), F.when(F.col("k") > 1, name(F.floor(F.col("k") / 2))).alias("parent"), children.alias("children"))


@query(f"WITH RECURSIVE {_TREE} SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'k' || k AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) AS BIGINT) AS pos, depth, CAST(NULL AS VARCHAR) AS issue FROM w UNION ALL SELECT CAST(conv_id AS VARCHAR), 'gone', NULL, 2, 'missing node: gone' FROM (SELECT DISTINCT conv_id FROM conversations)")
def walk_branches(spark: SparkSession, d: str) -> DataFrame:
    return conversation.walk_order(_branches(spark, d))


@query("WITH RECURSIVE t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), w AS (SELECT conv_id, n, 1 AS k, 0 AS idx FROM t UNION ALL SELECT conv_id, n, nx, idx + 1 FROM (SELECT conv_id, n, idx, CASE WHEN 2 * k + 1 <= n AND 'k' || (2 * k + 1) < 'k' || (2 * k) THEN 2 * k + 1 ELSE 2 * k END AS nx FROM w) WHERE nx <= n) SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'k' || k AS id, CAST(idx AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS issue FROM w")
def chain_branches(spark: SparkSession, d: str) -> DataFrame:
    return conversation.chain_order(_branches(spark, d))


_CODE = "CASE turn % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'json' WHEN 2 THEN 'sql' ELSE 'search' END"


@query(f"""SELECT conv_id, turn, CASE {_CODE} WHEN 'Python' THEN 'Python' WHEN 'json' THEN 'Document' WHEN 'sql' THEN 'Code (sql)' ELSE 'Search' END AS header, CASE WHEN turn % 4 = 3 THEN text || '|' || role ELSE text END AS shown FROM conversations""")
def code_dispatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("language", F.expr(_CODE))
    document = F.to_json(F.struct(F.lit("n").alias("name"), F.lit("document").alias("type"), F.col("text").alias("content")))
    search = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("q")), F.struct(F.col("role").alias("q"))).alias("search_query")))
    text = F.when(F.col("language") == "json", document).when(F.col("language") == "search", search).otherwise(F.col("text"))
    block = content.code_blocks(F.col("language"), text)
    return rows.select("conv_id", "turn", block["header"].alias("header"), F.array_join(block["texts"], "|").alias("shown"))
