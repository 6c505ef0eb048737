"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import corpus_pipeline
import pytest

from lorekeep.llm import queries
from tests.test_catalog import SF, duck, same  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name):  # noqa: F811
    same(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "piece_codec":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(out.count())
        docs = out if name == "piece_codec" else spark.createDataFrame(out.toPandas(), out.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, copies, clashing columns; and an empty table."""
    from tests.llm.cases import empty, frame

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some benchmark item that stands nowhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows, least in ((frame(spark), 5), (empty(spark), 0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "piece_codec":
                assert out.columns == rows.columns
                docs = out
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) >= least and (not ids or (1 in ids and not {2, 4, 5, 6, 7, 8, 12} & set(ids)))
    labels, bench = spark.read.parquet(str(tmp_path / "labels.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    bench.limit(0).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    frame(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    from lorekeep.llm.common import scratch_dir

    before = set(__import__("os").listdir(scratch_dir(spark)))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() >= 5
    left = set(__import__("os").listdir(scratch_dir(spark))) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-")
