"""A corpus made ready for training, in stages that each read what the stage before wrote.

Quality rules drop poor and toxic documents, the n-gram join leaves one document of each group of
near copies, suffix sorting takes out passages that an earlier document holds, decontamination drops
documents with benchmark items, and the piece codec encodes what is left.  All but the last return the
columns of documents, others that the table has included.

Cases: null and empty texts have no words and fall to the quality rules; rows with a null id are judged by
their text, come last where the smaller id decides, and are never the copy that stays if another is there;
repeated rows and ties leave one row; without labels or benchmark only the rules and the joins decide; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontamination, jaccard_join, piece_codec, quality_rules, suffix_dedup
from lorekeep.llm.common import Scratch, drop_folders, folders_made, read_table
from lorekeep.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.distinct_documents(docs, n=5, num=8, den=10)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_documents(docs, length=50)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copies_stage),
    ("suffix_dedup", repeats_stage),
    ("decontamination", benchmark_stage),
    ("piece_codec", encoding_stage),
]

#: The classifier and the segmentation are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        made = folders_made()
        docs = work.write(stage(spark, docs, sf_dir), name)
        drop_folders(spark, made)
        if before:
            work.drop(before)
        before = name
    return docs
