"""Importance resampling: texts drawn in proportion to how much likelier a target makes them.

Two models of hashed word n-grams (1 and 2) give each slot a probability: one counted over target
texts, one over all.  A text's weight is the product of the ratios over its n-grams.  Adding Gumbel
noise to the logarithm and taking the k largest draws k texts without replacement by weight.

The target's model learns from ``TARGET_ROWS`` target texts at most, those with the least hash of their
id, so that their ids can be broadcast and no text is shuffled; the raw model counts all texts.

The k-th largest is found by counting: keys fall into ``BINS`` bins, the bin with the k-th is
counted anew in finer bins, until the rest fits in ``FEW`` rows or has one key; then bits of the id
split it in the same way.  Only counts reach the driver.

Cases: null and empty texts have weight 1; ties in the key go by id, nulls first; repeated rows are drawn alike,
for the noise depends on the id; without target texts all weights are 1; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import Words, chunks, expand, squeeze, sums_by_text, tidy, tidy_group

#: Slots of the hashed n-grams.
SLOTS = 1 << 17
#: Slots of one row of counts between tasks.
PART = 1 << 13
BINS, FEW = 4096, 1000
#: The most target texts that the target's model learns from.
TARGET_ROWS = 32_000


def ngram_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word and word pair, text by text, and the number of each text's first."""
    words = Words(texts, lower=True)
    pairs, at = words.windows(2)
    doc = np.concatenate([words.doc_of_word(), np.searchsorted(words.first, at, side="right") - 1])
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    slots = (np.concatenate([words.hashes, pairs]) >> shift).astype(np.int64)
    return slots[np.argsort(doc, kind="stable")], words.first + np.searchsorted(at, words.first)


def _texts(column):
    return chunks((t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column)


def slot_counts(docs: DataFrame, target: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Counts over a bounded sample of target texts and over all texts.  docs: doc_id, text; target: doc_id of some.

    Each task adds up its texts and hands on SLOTS / PART rows; what the driver gets has one size.
    """

    def run(batches):
        total = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            flag = np.array(batch.column(1).to_pylist(), bool)
            done = 0
            for texts in _texts(batch.column(0)):
                slots, first = ngram_slots(texts)
                total[1] += np.bincount(slots, minlength=SLOTS)
                chosen = np.repeat(flag[done : done + len(texts)], np.diff(first))
                total[0] += np.bincount(slots[chosen], minlength=SLOTS)
                done += len(texts)
        parts = range(SLOTS // PART)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([squeeze(total[:, p * PART : (p + 1) * PART].tobytes()) for p in parts], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * PART, np.int64)
        for x in table["counts"].to_pylist():
            total += np.frombuffer(expand(x), np.int64)
        return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([squeeze(total.tobytes())], pa.binary())})

    sample = target.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id", F.lit("target")), "doc_id").limit(target_rows)
    flagged = docs.join(F.broadcast(sample.withColumn("chosen", F.lit(True))), "doc_id", "left").select("text", F.coalesce("chosen", F.lit(False)).alias("chosen"))  # target_rows ids at most
    rows = flagged.mapInArrow(tidy(run), "part int, counts binary")
    # sums of some tasks first, so that no task gets a part from every other
    some = rows.withColumn("some", F.floor(F.spark_partition_id() / 64)).groupBy("part", "some").applyInArrow(tidy_group(add), "part int, counts binary")
    total = np.zeros((2, SLOTS), np.int64)
    for r in some.groupBy("part").applyInArrow(tidy_group(add), "part int, counts binary").collect():
        total[:, r.part * PART : (r.part + 1) * PART] = np.frombuffer(expand(r.counts), np.int64).reshape(2, -1)
    return total[0], total[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Logarithm of the ratio of the two models' smoothed probabilities of each slot."""
    if not target.sum():
        return np.zeros(SLOTS)
    return np.log((target + 1) / (target.sum() + SLOTS)) - np.log((raw + 1) / (raw.sum() + SLOTS))


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 1) -> DataFrame:
    """(doc_id, log_weight, key): key is the logarithm with Gumbel noise of the id."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # of one fixed size

    def run(batches):
        for batch in batches:
            weights = [sums_by_text(shared.value[s], first) for s, first in map(ngram_slots, _texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*weights, np.zeros(0)]))], names=["doc_id", "log_weight"])

    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.mapInArrow(tidy(run), "doc_id long, log_weight double").withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def _split(rest: DataFrame, bins, k: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows in bins above the one with the k-th row, the rows of that bin and their number, and how
    many of them are due."""
    sizes = {r.bin: r["count"] for r in rest.groupBy(bins.alias("bin")).count().collect()}  # BINS + 1 rows at most
    for at in sorted(sizes, reverse=True):
        if k <= sizes[at]:
            break
        k -= sizes[at]
    return rest.where(bins > at), rest.where(bins == at), sizes[at], k


def top_k(weighed: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest key (ties: a null doc_id first, then the smaller one)."""
    size = weighed.count()
    if k <= 0 or k >= size:
        return weighed.limit(0) if k <= 0 else weighed
    taken, rest = [], weighed
    low, high = rest.agg(F.min("key"), F.max("key")).first()
    while size > FEW and low < high:
        width = (high - low) / BINS
        more, rest, size, k = _split(rest, F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).cast("int"), k)
        taken.append(more)
        low, high = rest.agg(F.min("key"), F.max("key")).first()
    for shift in (52, 40, 28, 16, 4, 0):  # of one key: twelve bits of the id at a time, the sign with the first
        if size > FEW:
            bits = F.shiftright("doc_id", shift) if shift == 52 else F.shiftright("doc_id", shift).bitwiseAND(BINS - 1 if shift else 15)
            more, rest, size, k = _split(rest, F.coalesce(-bits, F.lit(BINS)).cast("int"), k)
            taken.append(more)
    if size > FEW:  # rows of one key and one id have one weight too: they are alike
        row = rest.first()
        same = weighed.sparkSession.range(k)
        last = same.select(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in weighed.schema])
    else:
        last = rest.orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).limit(k)  # FEW rows
    for part in taken:
        last = last.union(part)
    return last


def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, key) of the sample: the given share of the rows of docs, rounded up."""
    from lorekeep.llm.common import Scratch

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    work = Scratch(docs.sparkSession, "importance")
    weighed = work.write(weigh(source, log_ratios(*slot_counts(source, target)), seed), "weighed")
    return top_k(weighed, -int(-share * weighed.count() // 1))
