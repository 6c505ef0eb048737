"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans import conversations, relational, scalars, stored, trees

_PLANS = (relational, scalars, conversations, trees, stored)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PLANS for k, v in p.ORACLES.items()}
