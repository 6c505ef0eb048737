"""Listings of documents, latest versions and pages of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as tx


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each value given; a None asks for nothing and adds no predicate."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def up_to(rows: DataFrame, column: str, bound) -> DataFrame:
    return rows if bound is None else rows.where(F.col(column) <= bound)


def text_matches(title: Column, content: Column, query: str) -> Column:
    """The title holds the query in any case, or the content holds all its terms."""
    return title.ilike(f"%{query}%") | tx.matches_all_terms(content, tx.search_terms(query))


def list_documents(docs: DataFrame, domain=None, tier=None, status=None, query: str | None = None, due=None, updated=None) -> DataFrame:
    """Documents that are not deleted, by optional filters; due and updated are the last date and time allowed.  An
    empty query asks for nothing."""
    rows = matching(docs.where(~F.col("deleted")), domain=domain, tier=tier, status=status)
    rows = up_to(up_to(rows, "due_date", due), "updated_at", updated)
    return rows if not query else rows.where(text_matches(F.col("title"), F.col("content"), query))


def find_one(rows: DataFrame, **key) -> DataFrame:
    """The row with these values, or none: a null in the key finds nothing."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.limit(1)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key, in one aggregation without a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page in a total order; a negative offset is none, a negative limit or None takes all."""
    rows = rows.orderBy(*order).offset(max(offset, 0))
    return rows if limit is None or limit < 0 else rows.limit(limit)


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key, the one with the largest position."""
    return latest(rows, key, position)


def next_number(rows: DataFrame, column: str, before_first: int = 0) -> DataFrame:
    """One row: the largest number so far, or before_first, and one."""
    return rows.agg((F.coalesce(F.max(column), F.lit(before_first)) + 1).alias("next"))


def flow_counts(docs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(a, b, n): documents by the codes of two dimensions (key, code).  Documents are counted by their keys
    first, so that the joins see a row for each pair of keys; one without a dimension's row is not counted."""
    counted = docs.groupBy(left_key, right_key).agg(F.count("*").alias("n"))
    a = left.select(F.col("key").alias(left_key), F.col("code").alias("a"))
    b = right.select(F.col("key").alias(right_key), F.col("code").alias("b"))
    return counted.join(a, left_key).join(b, right_key).groupBy("a", "b").agg(F.sum("n").alias("n"))


def as_map(rows: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """(group, map): for each group a map from key to the value that comes last in the given order."""
    last = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("_v").alias("value"))))).alias("map"))


def outcome(rows: DataFrame, group: str, infra: str, logic: str) -> DataFrame:
    """rows that tell a group's outcome, with outcome: its infrastructure errors if there is one, else its
    logical errors, else the results."""
    rank = F.when(F.col(infra).isNotNull(), 0).when(F.col(logic).isNotNull(), 1).otherwise(2)
    ranked = rows.withColumn("_rank", rank)
    worst = ranked.groupBy(group).agg(F.min("_rank").alias("_rank"))
    names = F.element_at(F.array(F.lit("infrastructure"), F.lit("logic"), F.lit("result")), F.col("_rank") + 1)
    return ranked.join(worst, [group, "_rank"]).withColumn("outcome", names).drop("_rank")


def lifecycle(docs: DataFrame, stages: DataFrame) -> DataFrame:
    """docs (status) with the index of their status in the lifecycle (status, stage); null without one."""
    return docs.join(stages.select("status", "stage"), "status", "left")


def targets(docs: DataFrame, ids: DataFrame | None = None, members: DataFrame | None = None, label: str | None = None, default_all: bool = False) -> DataFrame:
    """docs (uid) chosen by ids (uid) or by the label of a group of members (uid, label).  Neither is an
    error, unless default_all says that all are meant."""
    if ids is not None:
        return docs.join(ids.select("uid"), "uid", "left_semi")
    if members is not None and label is not None:
        return docs.join(members.where(F.col("label") == label).select("uid"), "uid", "left_semi")
    if default_all:
        return docs
    raise ValueError("give ids, or a group's label")
