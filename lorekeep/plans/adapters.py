"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document: uid, title, domain, tier, status, owner, deleted, content."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("uid"),
        F.substring(tx.collapse(F.col("text")), 1, 40).alias("title"),
        F.col("source").alias("domain"),
        F.col("lang").alias("tier"),
        F.coalesce(F.col("quality").cast("string"), F.lit("unrated")).alias("status"),
        (F.col("doc_id") % 7).alias("owner"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"),
        F.col("text").alias("content"),
    )


#: The same in DuckDB.
DOCUMENTS_SQL = r"""document AS (SELECT d.doc_id AS uid, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 40) AS title, source AS domain, lang AS tier,
  coalesce(CAST(quality AS VARCHAR), 'unrated') AS status, d.doc_id % 7 AS owner, coalesce(toxic = 1, false) AS deleted, text AS content
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def messages(spark: SparkSession, sf_dir: str, alternative: bool = False) -> DataFrame:
    """Rows of a conversation's walk: conv_id, pos, role, content_type, parts, end_turn.

    An assistant row ends its turn if the next row is not the assistant's; alternative: if turn % 4 = 3.
    """
    rows = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    ends = (F.col("turn") % 4 == 3) if alternative else ~F.lead("role").over(order).eqNullSafe("assistant")
    return rows.select("conv_id", F.col("turn").alias("pos"), F.lower("role").alias("role"), F.lit("text").alias("content_type"), F.array("text").alias("parts"), ((F.col("role") == "assistant") & ends).alias("end_turn"))


def messages_sql(alternative: bool = False) -> str:
    ends = "turn % 4 = 3" if alternative else "(lead(role) OVER (PARTITION BY conv_id ORDER BY turn)) IS DISTINCT FROM 'assistant'"
    return f"msg AS (SELECT conv_id, turn AS pos, lower(role) AS role, text, role = 'assistant' AND {ends} AS end_turn FROM conversations)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks: regions, their nations, their customers; seq_pos = key * 1000."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    pos = lambda k: (F.col(k) * 1000).cast("decimal(38,10)").alias("seq_pos")
    none = F.lit(None).cast("string")
    last = F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 9).cast("long")
    return (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("uid"), none.alias("parent"), pos("r_regionkey"), F.col("r_name").alias("content"), F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
        .union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), pos("n_nationkey"), "n_name", (F.col("n_nationkey") % 3).cast("long"), F.lit(None).cast("long")))
        .union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), pos("c_custkey"), "c_name", (F.col("c_custkey") % 4).cast("long"), last))
    )


TREE_SQL = """block AS (
  SELECT 'r' || r_regionkey AS uid, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey * 1000 AS DECIMAL(38,10)) AS seq_pos, r_name AS content, CAST(0 AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey * 1000 AS DECIMAL(38,10)), n_name, CAST(n_nationkey % 3 AS BIGINT), NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(c_custkey * 1000 AS DECIMAL(38,10)), c_name, CAST(c_custkey % 4 AS BIGINT), CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 9 AS BIGINT) END FROM customer)"""
