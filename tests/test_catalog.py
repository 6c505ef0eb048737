"""Every query of the catalogue against its SQL twin in DuckDB."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lorekeep import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def same(spark, duck, run, sql, sf=SF):
    df = run(spark, sf)
    columns = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs
    assert ours or run.__name__ in ("fts_match",)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_twin(spark, duck, name):
    same(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


def test_detail_of_every_document(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert catalog.QUERIES["doc_detail_all"](spark, SF).select("doc").distinct().count() == orders.select("o_orderkey").distinct().count()


def test_whole_pages(spark, tmp_path):
    q, far = chr(34), "x" * 400
    html = ["", "a", "b" + q, far + "<math>", far + "\\" + q * 3]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    triple = {r.page_id: r.triple for r in catalog.QUERIES["elm_triple_whole"](spark, str(tmp_path)).collect()}
    assert triple[0] == q * 2 and triple[1] == q * 3 + "a" + q * 3 and triple[2] == q * 3 + "b" + q + " " + q * 3
    assert triple[4] == q * 3 + far + "\\\\" + ("\\" + q) * 3 + " " + q * 3
    rows = {r.page_id: r for r in catalog.QUERIES["html_complex_whole"](spark, str(tmp_path)).collect()}
    assert rows[3].is_complex and rows[3].has_math and not rows[1].is_complex and not rows[1].has_math


@pytest.mark.parametrize("turn", [1, -1])
def test_detail_of_equal_versions(spark, tmp_path, turn):
    """Lines that agree in number and part: the state does not follow the order in which they are read."""
    spark.createDataFrame([(1, "a"), (2, "b")], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 7, 5, "F"), (1, 7, 5, "O"), (1, 6, 9, "P")][::turn]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_linestatus string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {tuple(r) for r in catalog.QUERIES["doc_detail"](spark, str(tmp_path)).collect()} == {(1, "a", 7, "O"), (2, "b", None, None)}
