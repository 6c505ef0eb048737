"""Scalar functions over documents and pages, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.plans.adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: In SQL: white space stripped and collapsed, characters and words cut.
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_CUT = "CASE WHEN length({0}) <= 120 THEN {0} ELSE substr({0}, 1, 119) || '…' END"
_WORDS = "array_to_string(string_split({}, ' ')[1:14], ' ')"


def _line(inner: str) -> str:
    return f"SELECT doc_id, {_WORDS.format('c')} AS label FROM (SELECT doc_id, {_CUT.format('w')} AS c FROM (SELECT doc_id, {_WS.format(inner)} AS w FROM documents))"


@query(_line(_STRIP))
def one_line_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_one_line(F.col("text")).alias("label"))


@query(_line(f"substr({_STRIP}, 1, 600)"))
def fallback_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.fallback_one_line(F.col("text")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 120) || '…' END AS preview FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, substr(sha256(source || '|' || lang || '|' || substr(text, 1, 80)), 1, 12) AS stable_id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("stable_id"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


_PREFIX = "CASE n % 5 WHEN 0 THEN '1) ' WHEN 1 THEN '1.2 ' WHEN 2 THEN '1.2) ' WHEN 3 THEN '1. ' ELSE '2024 ' END"


@query(rf"""SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN regexp_matches(line, '^\d+(?:\.\d+)*\)?\s+') THEN regexp_extract(line, '^\d+(?:\.\d+)*\)?\s+([\s\S]*)$', 1) END AS heading
  FROM (SELECT doc_id, n, {_PREFIX} || l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) WHERE l <> '')""")
def promote_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "l")).where("l <> ''")
    return lines.select("doc_id", "n", tx.promoted_heading(F.concat(F.expr(_PREFIX), "l")).alias("heading"))


@query("""SELECT page_id, CASE WHEN lower(f) LIKE '%.png' THEN 'image/png' WHEN lower(f) LIKE '%.jpg' OR lower(f) LIKE '%.jpeg' THEN 'image/jpeg' WHEN lower(f) LIKE '%.gif' THEN 'image/gif' ELSE 'application/octet-stream' END AS kind
  FROM (SELECT page_id, 'x' || ['.PNG', '.jpg', '.jpeg', '.gif', '.txt', ''][page_id % 6 + 1] AS f FROM pages)""")
def content_type_guess(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (".PNG", ".jpg", ".jpeg", ".gif", ".txt", "")])
    name = F.concat(F.lit("x"), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", tx.content_type(name).alias("kind"))


_ELM = r"""replace(replace(replace(replace({}, '\', '\\'), '"', '\"'), chr(13), ''), '…', '...')"""


_Q3 = "repeat(chr(34), 3)"


@query(rf"""SELECT page_id, chr(34) || {_ELM.format("html")} || chr(34) AS elm,
  CASE WHEN b = '' THEN repeat(chr(34), 2) WHEN right(b, 1) = chr(34) THEN {_Q3} || b || ' ' || {_Q3} ELSE {_Q3} || b || {_Q3} END AS triple
  FROM (SELECT page_id, html, replace(replace(html, '\', '\\'), {_Q3}, repeat('\' || chr(34), 3)) AS b FROM pages)""")
def elm_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.elm_string(F.col("html")).alias("elm"), tx.elm_triple(F.col("html")).alias("triple"))


@query(rf"""SELECT page_id, CASE WHEN b = '' THEN repeat(chr(34), 2) WHEN right(b, 1) = chr(34) THEN {_Q3} || b || ' ' || {_Q3} ELSE {_Q3} || b || {_Q3} END AS triple
  FROM (SELECT page_id, replace(replace(html, '\', '\\'), {_Q3}, repeat('\' || chr(34), 3)) AS b FROM pages)""")
def elm_triple_whole(spark: SparkSession, d: str) -> DataFrame:
    """The triple column of elm_escape, over whole pages."""
    return table(spark, d, "pages").select("page_id", tx.elm_triple(F.col("html")).alias("triple"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(t, '%y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN '(upd) ' || strftime(t, '%y-%m-%d %H:%M:%S') ELSE '(no timestamp)' END AS label FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)""")
def time_label(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    created, updated = F.when(F.col("event_id") % 3 == 0, seconds), F.when(F.col("event_id") % 3 == 1, seconds)
    return table(spark, d, "events").select("event_id", tx.time_label(created, updated).alias("label"))


@query("SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def url_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.url_tail(F.col("url")).alias("tail"))


_HAS = " OR ".join(f"contains(lower(h), '{m}')" for m in tx.LAYOUT_MARKS)


@query(rf"""SELECT page_id, (length(regexp_replace(h, '^\s+|\s+$', '', 'g')) > 180 OR {_HAS}) AS is_complex, (contains(lower(h), '<math') OR contains(lower(h), '</math')) AS has_math, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '…' END AS short
  FROM (SELECT page_id, h, regexp_replace(h, '^\s+|\s+$', '', 'g') AS t FROM (SELECT page_id, html AS h FROM pages))""")
def html_complex(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", F.col("html").alias("h"))
    return h.select("page_id", tx.is_complex_html(F.col("h")).alias("is_complex"), tx.has_mathml(F.col("h")).alias("has_math"), tx.truncate_inline(F.col("h")).alias("short"))


@query(rf"""SELECT page_id, (length(t) > 180 OR {_HAS}) AS is_complex, (contains(lower(h), '<math') OR contains(lower(h), '</math')) AS has_math, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '…' END AS short
  FROM (SELECT page_id, html AS h, regexp_replace(html, '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def html_complex_whole(spark: SparkSession, d: str) -> DataFrame:
    """html_complex over whole pages."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", tx.is_complex_html(h).alias("is_complex"), tx.has_mathml(h).alias("has_math"), tx.truncate_inline(h).alias("short"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 AND day(ts) <= 12 THEN make_date(2024, day(ts), month(ts)) ELSE make_date(2024, month(ts), least(day(ts), day(last_day(make_date(2024, month(ts), 1))))) END AS day FROM events")
def month_day(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in one of four forms, read back in the year before 2025; a day up to 12 before a month
    reads as a month before a day, as the order of the forms has it."""
    ts = F.col("ts").cast("timestamp")
    form = F.col("event_id") % 4
    shown = F.when(form == 0, F.date_format(ts, "MMM d")).when(form == 1, F.date_format(ts, "MMMM d")).when(form == 2, F.date_format(ts, "MM dd")).otherwise(F.date_format(ts, "dd MM"))
    return table(spark, d, "events").select("event_id", tx.month_day(shown, "2025-06-01").alias("day"))


@query(r"SELECT doc_id, replace(lang || ' ' || source, ' ', '_') || '_' || doc_id || '.docx' AS name, TRY_CAST(nullif(regexp_extract(substr(source, 4), '^\d+'), '') AS INTEGER) AS number FROM documents")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat_ws(" ", "lang", "source")
    return table(spark, d, "documents").select("doc_id", tx.document_file_name(title, F.col("doc_id")).alias("name"), tx.leading_integer(F.expr("substr(source, 4)")).alias("number"))
