"""Conversations folded into discussions, their renderings and tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import conversation, discussion
from lorekeep.plans.adapters import messages, messages_sql, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _fold_sql(alternative: bool) -> str:
    return f"""{messages_sql(alternative)},
  seg AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' AND end_turn THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM msg),
  step AS (SELECT conv_id, segment, pos, text FROM seg WHERE role = 'assistant' AND NOT end_turn),
  steps AS (SELECT conv_id, segment, count(*) AS n, min(pos) AS first_pos FROM step GROUP BY ALL),
  message AS (SELECT s.conv_id, CAST(row_number() OVER (PARTITION BY s.conv_id ORDER BY pos) AS INTEGER) AS seq, pos, role AS kind, s.segment,
    CASE WHEN role IN ('system', 'tool') THEN 'contents=text' ELSE text END AS text,
    CAST(CASE WHEN end_turn THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_steps, CASE WHEN end_turn THEN coalesce(first_pos, pos) ELSE pos END AS first_pos
    FROM seg s LEFT JOIN steps t ON t.conv_id = s.conv_id AND t.segment = s.segment WHERE end_turn OR role IN ('user', 'system', 'tool'))"""


_MESSAGE = ["conv_id", "seq", "pos", "kind", "text", "n_steps", "first_pos"]


@query(f"WITH {_fold_sql(False)} SELECT {', '.join(_MESSAGE)} FROM message")
def fsm_messages(spark: SparkSession, d: str) -> DataFrame:
    return discussion.fold_messages(messages(spark, d)).select(*_MESSAGE)


@query(f"WITH {_fold_sql(True)} SELECT {', '.join(_MESSAGE)} FROM message")
def fsm_messages_alt(spark: SparkSession, d: str) -> DataFrame:
    return discussion.fold_messages(messages(spark, d, alternative=True)).select(*_MESSAGE)


@query(f"WITH {_fold_sql(True)} SELECT {', '.join(_MESSAGE)} FROM message")
def fsm_fold_by_rows(spark: SparkSession, d: str) -> DataFrame:
    return discussion.fold_by_rows(messages(spark, d, alternative=True))


@query(f"WITH {_fold_sql(True)} SELECT m.conv_id, m.seq, CAST(row_number() OVER (PARTITION BY m.conv_id, m.seq ORDER BY s.pos) AS INTEGER) AS step, s.pos, s.text FROM message m JOIN step s ON s.conv_id = m.conv_id AND s.segment = m.segment WHERE m.kind = 'assistant'")
def fsm_sub_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = discussion.fold_messages(messages(spark, d, alternative=True)).select("conv_id", "seq", F.posexplode("steps").alias("i", "s"))
    return rows.select("conv_id", "seq", (F.col("i") + 1).alias("step"), F.col("s.pos").alias("pos"), F.col("s.text").alias("text"))


@query("SELECT conv_id, turn AS pos, 'unknown role: ' || role AS issue FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'critic' ELSE role END AS role FROM conversations) WHERE role NOT IN ('user', 'assistant', 'system', 'tool')")
def fsm_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumn("role", F.when(F.col("pos") % 3 == 2, "critic").otherwise(F.col("role")))
    return discussion.issues(rows)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.lpad(t.cast("string"), 6, "0"))
    return rows.select(F.col("conv_id").cast("string").alias("conversation_id"), name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), "role", "text", "turn")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id, turn AS idx FROM conversations")
def chain_order(spark: SparkSession, d: str) -> DataFrame:
    return conversation.chain_order(_nodes(spark, d)).select("conversation_id", "id", "idx")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id, turn + 1 AS pos, CAST(turn + 1 AS INTEGER) AS depth FROM conversations")
def walk_order(spark: SparkSession, d: str) -> DataFrame:
    return conversation.walk_order(conversation.with_children(_nodes(spark, d))).select("conversation_id", "id", "pos", "depth")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id, conv_id || ':' || lpad(CAST(turn - 1 AS VARCHAR), 6, '0') AS parent FROM conversations WHERE turn > 0 AND (turn - 1) % 4 = 2")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d)
    return conversation.orphans(rows.where("turn % 4 <> 2").unionByName(rows.where("turn % 4 = 2").select(F.concat(F.lit("lost"), "conversation_id").alias("conversation_id"), "id", F.lit(None).cast("string").alias("parent"), "role", "text", "turn")))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def content_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


@query(f"""WITH {_fold_sql(True)}, shown AS (SELECT m.conv_id, m.seq, m.kind, m.text, (SELECT string_agg('---- Intermediate ---' || chr(10) || s.text, chr(10) ORDER BY s.pos) FROM step s WHERE s.conv_id = m.conv_id AND s.segment = m.segment AND m.kind = 'assistant') AS st FROM message m)
  SELECT conv_id, string_agg(CASE kind WHEN 'assistant' THEN '---- Assistant ---' || chr(10) || coalesce('---- SubActions ---' || chr(10) || st, '') || chr(10) || '>>> RESP >>>' || chr(10) || text
    ELSE '---- ' || upper(kind[1]) || kind[2:] || ' ---' || chr(10) || text END, chr(10) || chr(10) ORDER BY seq) AS transcript FROM shown GROUP BY conv_id""")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return discussion.transcript(discussion.fold_messages(messages(spark, d, alternative=True)))


TRIPLE = r"""CASE WHEN {0} = '' THEN repeat(chr(34), 2) WHEN right({0}, 1) = chr(34) THEN repeat(chr(34), 3) || {0} || ' ' || repeat(chr(34), 3) ELSE repeat(chr(34), 3) || {0} || repeat(chr(34), 3) END"""
ESCAPED = r"replace(replace({}, '\', '\\'), repeat(chr(34), 3), repeat('\' || chr(34), 3))"


@query(f"""WITH {_fold_sql(True)}, st AS (SELECT conv_id, segment, string_agg('T.Intermediate ' || {TRIPLE.format("e")}, chr(10) || '  , ' ORDER BY pos) AS s FROM (SELECT *, {ESCAPED.format("text")} AS e FROM step) GROUP BY ALL),
  m AS (SELECT *, {ESCAPED.format("text")} AS e, '{{ id = "msg_' || seq || '", kind = T.' AS head, ', title = "msg_' || seq || '", body = [ ' AS rest FROM message WHERE kind IN ('user', 'assistant'))
  SELECT m.conv_id, seq, CASE kind WHEN 'user' THEN head || 'Question' || rest || 'T.Basic ' || {TRIPLE.format("e")} || ' ] }}'
    ELSE head || 'Answer' || rest || coalesce(s || chr(10) || '  , ', '') || 'T.LineSep' || chr(10) || '  , ' || 'T.Basic ' || {TRIPLE.format("e")} || chr(10) || '    ] }}' END AS item
  FROM m LEFT JOIN st ON st.conv_id = m.conv_id AND st.segment = m.segment AND kind = 'assistant'""")
def elm_items(spark: SparkSession, d: str) -> DataFrame:
    return discussion.elm_items(discussion.fold_messages(messages(spark, d, alternative=True)))


_HEADER = r"""array_to_string(string_split(CASE WHEN length({0}) <= 120 THEN {0} ELSE substr({0}, 1, 119) || '…' END, ' ')[1:14], ' ')""".format(r"trim(regexp_replace(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 600), '\s+', ' ', 'g'))")


@query(f"""WITH {_fold_sql(True)}, st AS (SELECT conv_id, segment, flatten(list([{{'style': 'Heading 3', 'text': 'Intermediate'}}, {{'style': 'GF Intermediate Body', 'text': text}}] ORDER BY pos)) AS s FROM step GROUP BY ALL),
  block AS (SELECT m.conv_id, seq, CASE kind WHEN 'user' THEN [{{'style': 'GF M Header', 'text': 'Manager> ' || {_HEADER}}}, {{'style': 'GF Q Body', 'text': text}}]
    ELSE [{{'style': 'GF A Header', 'text': 'Analyst> ' || {_HEADER}}}] || coalesce(s, []) || [{{'style': 'GF EndOfReflection', 'text': 'end-of-reflection'}}, {{'style': 'Rule', 'text': ''}}, {{'style': 'GF A Body', 'text': text}}] END AS b
    FROM message m LEFT JOIN st ON st.conv_id = m.conv_id AND st.segment = m.segment WHERE kind IN ('user', 'assistant'))
  SELECT conv_id, seq, CAST(place AS INTEGER) AS place, b.style AS style, b.text AS text FROM (SELECT conv_id, seq, unnest(b) AS b, unnest(range(len(b))) AS place FROM block)""")
def docx_rows(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of each question and answer."""
    return discussion.document_rows(discussion.fold_messages(messages(spark, d, alternative=True)))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return rows.select("conv_id", tx.fallback_one_line(F.col("text")).alias("title"))


_TITLE_SQL = r"""title AS (SELECT conv_id, array_to_string(string_split(CASE WHEN length(w) <= 120 THEN w ELSE substr(w, 1, 119) || '…' END, ' ')[1:14], ' ') AS title
  FROM (SELECT conv_id, trim(regexp_replace(substr(regexp_replace(min_by(text, turn), '^\s+|\s+$', '', 'g'), 1, 600), '\s+', ' ', 'g')) AS w FROM conversations WHERE role = 'user' GROUP BY conv_id))"""


@query(f"WITH {_TITLE_SQL} SELECT conv_id, title FROM title WHERE title NOT IN (SELECT title FROM title WHERE conv_id % 2 = 0)")
def new_conversations(spark: SparkSession, d: str) -> DataFrame:
    titles = _titles(spark, d)
    return conversation.new_conversations(titles, titles.where("conv_id % 2 = 0"))


@query(f"WITH {_TITLE_SQL} SELECT title, max(conv_id) AS uid FROM title GROUP BY title")
def titles_to_uid(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).groupBy("title").agg(F.max("conv_id").alias("uid"))


@query(r"""SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND NOT (turn % 2 = 0 AND conv_id % 3 = 0)""")
def pending_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    candidates = rows.where(F.col("role").isin("user", "assistant") & (tx.strip(F.col("text")) != "")).withColumn("key", F.struct("conv_id", "turn"))
    done = rows.where("turn % 2 = 0 AND conv_id % 3 = 0").select(F.struct("conv_id", "turn").alias("key"))
    return conversation.pending(candidates, done, "key").select("conv_id", "turn")


@query("SELECT conv_id * 1000 + turn AS message, CASE WHEN turn % 3 = 0 THEN 'new' ELSE 'old' END AS summary FROM conversations WHERE turn % 2 = 0 OR turn % 3 = 0")
def summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), "turn")
    old = rows.where("turn % 2 = 0").select("message", F.lit("old").alias("summary"))
    return conversation.upsert(old, rows.where("turn % 3 = 0").select("message", F.lit("new").alias("summary")), "message")


@query(f"WITH {_TITLE_SQL} SELECT CAST('group ' || conv_id % 5 AS VARCHAR) AS label, conv_id, title FROM title WHERE conv_id % 5 IN (1, 3)")
def group_discussions(spark: SparkSession, d: str) -> DataFrame:
    titles = _titles(spark, d)
    groups = spark.range(5).select(F.col("id").alias("grp"), F.concat(F.lit("group "), "id").alias("label"))
    members = titles.select("conv_id", (F.col("conv_id") % 5).alias("grp"))
    return groups.where(F.col("label").isin("group 1", "group 3")).join(members, "grp").join(titles, "conv_id").select("label", "conv_id", "title")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn AS idx FROM conversations WHERE turn > conv_id % 4 - 1")
def incr_tail(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    stored = rows.where("turn < conv_id % 4").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("seqnbr"))
    return conversation.incremental_tail(conversation.chain_order(_nodes(spark, d)), stored).select("conversation_id", "idx")


@query(f"WITH {_fold_sql(False)} SELECT conv_id, sum(CASE kind WHEN 'user' THEN 1 ELSE 0 END)::BIGINT AS questions, sum(CASE kind WHEN 'assistant' THEN 1 ELSE 0 END)::BIGINT AS answers, max(seq)::INTEGER AS last_seq FROM message GROUP BY 1")
def discussion_load(spark: SparkSession, d: str) -> DataFrame:
    """Messages joined to a payload of their kind, as loading a stored discussion does."""
    m = discussion.fold_messages(messages(spark, d))
    user = m.where("kind = 'user'").select("conv_id", "seq", F.lit(1).alias("q"))
    answer = m.where("kind = 'assistant'").select("conv_id", "seq", F.lit(1).alias("a"))
    rows = m.select("conv_id", "seq").join(user, ["conv_id", "seq"], "left").join(answer, ["conv_id", "seq"], "left")
    return rows.groupBy("conv_id").agg(F.count("q").alias("questions"), F.count("a").alias("answers"), F.max("seq").alias("last_seq"))
