"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans, and ANSI errors where the operators do not ask for try_ forms.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(name: str = "lorekeep", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
