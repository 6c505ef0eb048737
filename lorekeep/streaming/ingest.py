"""Incremental ingest of export files: each conversation once for each state of its content.

The key of an ingest is (conversation, SHA-256 of its content), so a batch that is run again after a
failure, or a file that is delivered twice, adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_key(rows: DataFrame, content: str) -> DataFrame:
    return rows.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256))


def append_new(rows: DataFrame, target: str, id_col: str = "conversation_id") -> None:
    """Appends the rows whose (id, sha) the target table lacks."""
    spark = rows.sparkSession
    key = [id_col, "sha"]
    fresh = rows.dropDuplicates(key)
    if spark.catalog.tableExists(target):
        fresh = fresh.join(spark.table(target).select(*key), key, "left_anti")
    fresh.write.mode("append").saveAsTable(target)


def start(stream: DataFrame, target: str, content: str, checkpoint: str, id_col: str = "conversation_id"):
    """A streaming query that appends new states; stream: id_col, content."""
    return (
        with_key(stream, content)
        .writeStream.foreachBatch(lambda batch, _: append_new(batch, target, id_col))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
