"""Audit of how filters interact: what each removes in every order, with duplicates found in radix tries of texts.

Filters (words: runs without white space, case-sensitive):

* A: fewer than 50 words.
* B: 100 * distinct words < 65 * words.
* C: 100 * letters A-Z > 5 * code points.
* D: one of the characters # $ % & * |.
* E: the text is that of a row with a smaller doc_id, whether that one is removed or not.

1. A task collects documents into blocks and counts A to D for all texts of a block at once.  E begins
   there: texts go into a compressed trie in the order of their ids, a terminal holds the least id, and only
   the first document of each text goes on, with its text.
2. Texts are dealt by ranges of their prefixes.  A prefix starts at ``FIRST_PREFIX`` bytes; those under
   which more than ``TRIE_BYTES`` of text lie are lengthened by the factor ``LONGER``, and again, until they share
   it out or a text ends.  The tables of heavy prefixes have total / TRIE_BYTES rows at most; Spark broadcasts them
   if they are small and shuffles otherwise.
3. In a range, sorted by prefix and id, the texts of one prefix go into one trie: memory follows a prefix
   and not a range, and a text that comes again adds nothing.  Texts that meet a terminal with a smaller id
   are duplicates; only their numbers are sent back.
4. Documents become five-bit masks and masks become counts by part.  All orders and steps follow from
   the at most 32 counts of a part.

Cases: a null text is an empty one, a null part the empty string; a null id is larger than any other, and equal
ids are no smaller ones, so repeated rows of one id are no duplicates of each other; a document with several
labels is good or toxic if one of them says so; null labels say nothing; an empty table gives no rows.  A text of
any length is inserted whole.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BLOCK_BYTES, BLOCK_DOCS, Scratch, Words, chunks, sums_by_text, tidy

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of the prefixes by which texts are dealt at first, and how many times longer those of heavy ones become.
FIRST_PREFIX = 8
LONGER = 4
#: Bytes of texts under one prefix, and so in one trie.
TRIE_BYTES = 8 << 20
#: Bytes of texts for one range.
RANGE_BYTES = 16 << 20

_UPPER, _SYMBOL, _LEAD = np.zeros(256, np.uint8), np.zeros(256, np.uint8), np.ones(256, np.uint8)
_UPPER[ord("A") : ord("Z") + 1] = 1
_SYMBOL[list(SYMBOLS)] = 1
_LEAD[0x80:0xC0] = 0  # bytes that go on with a character


class RadixTrie:
    """A compressed trie of byte strings whose terminals hold the first value inserted."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = [b"", {}, None]  # label, children by first byte, value

    def insert(self, text: bytes, value):
        """The value of the text's terminal, which is the given one if the text is new."""
        node, at = self.root, 0
        while True:
            if at == len(text):
                if node[2] is None:
                    node[2] = value
                return node[2]
            below = node[1].get(text[at])
            if below is None:
                node[1][text[at]] = [text[at:], {}, value]
                return value
            label = below[0]
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = _common(label, text, at)
            middle = [label[:same], {label[same]: below}, None]
            below[0] = label[same:]
            node[1][text[at]] = middle
            node, at = middle, at + same


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of the label and of the text from there on, which is shorter than the label."""
    low, high = 1, min(len(label), len(text) - at)  # the first byte is the same
    while low < high:
        mid = (low + high + 1) // 2
        if label[:mid] == text[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def masks(texts: list[bytes]) -> np.ndarray:
    """The bits of A to D of each text."""
    words = Words(texts, lower=False)
    n = np.diff(words.first)
    doc = words.doc_of_word()
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=len(texts))
    per = lambda table: sums_by_text(table[words.buf].astype(np.int64), words.offsets)
    chars = per(_LEAD) - 1  # without the line feed that ends a text
    fails = [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * per(_UPPER) > UPPER_PERCENT * chars, per(_SYMBOL) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _block(base: int, ids: list, parts: list, texts: list[bytes]) -> pa.RecordBatch:
    """Rows of a block's documents; only the first of each text carries it."""
    mask = np.concatenate([masks(group) for group in chunks(iter(texts))])
    trie, first, copy, sent = RadixTrie(), [0] * len(ids), [False] * len(ids), [None] * len(ids)
    for at in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)):
        first[at] = trie.insert(texts[at], at)
        copy[at] = ids[at] != ids[first[at]]
        if first[at] == at:
            sent[at] = texts[at]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(base + np.arange(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(mask, pa.int32()),
            pa.array(base + np.array(first), pa.int64()), pa.array(copy, pa.bool_()), pa.array(sent, pa.binary()),
        ],
        names=["rid", "doc_id", "part", "mask", "first", "copy", "text"],
    )


def _rows(docs: DataFrame, part: Column, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        ids, parts, texts, size = [], [], [], 0
        for batch in batches:
            for i, p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and (size + len(data) > block_bytes or len(ids) == BLOCK_DOCS):
                    yield _block(base, ids, parts, texts)
                    base += len(ids)
                    ids, parts, texts, size = [], [], [], 0
                ids.append(i)
                parts.append(p)
                texts.append(data)
                size += len(data)
        if ids:
            yield _block(base, ids, parts, texts)

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(tidy(run), "rid long, doc_id long, part string, mask int, first long, copy boolean, text binary")


def dealt_by_prefix(firsts: DataFrame, work: Scratch, trie_bytes: int) -> DataFrame:
    """firsts (rid, doc_id, text) with the prefix under which each text goes into a trie."""
    out, length, known = firsts.withColumn("prefix", F.substring("text", 1, FIRST_PREFIX)), FIRST_PREFIX, None
    while True:
        longer = out.where(F.octet_length("text") > length)
        if known is not None:  # only what lies under a heavy prefix can lie under a longer heavy one
            longer = longer.where(F.octet_length("prefix") == length)
        heavy = longer.groupBy("prefix").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).where(F.col("n") > trie_bytes)
        known = work.write(heavy.select("prefix", F.lit(True).alias("heavy")), f"heavy-{length}")
        if known.isEmpty():
            return out
        length *= LONGER
        out = out.join(known, "prefix", "left").withColumn("prefix", F.when(F.col("heavy"), F.substring("text", 1, length)).otherwise(F.col("prefix"))).select(*out.columns)


def repeated_texts(firsts: DataFrame, work: Scratch, trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(first) numbers of the rows of firsts (rid, doc_id, text) whose text a row with a smaller id has."""

    def run(batches):
        trie, prefix = None, None
        for batch in batches:
            found = []
            for key, rid, i, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if trie is None or key != prefix:
                    trie, prefix = RadixTrie(), key
                least = trie.insert(text, (i,))[0]  # ids come in order, null last
                if least is not None and least != i:
                    found.append(rid)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["first"])

    total = firsts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = dealt_by_prefix(firsts, work, trie_bytes).select("prefix", "rid", "doc_id", "text")
    ranges = dealt.repartitionByRange(max(1, -(-total // range_bytes)), "prefix").sortWithinPartitions("prefix", F.col("doc_id").isNull(), "doc_id")
    return ranges.mapInArrow(tidy(run), "first long")


def failures(docs: DataFrame, work: Scratch, part: str = "source", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, part, mask) of each document; bit i of the mask is set if it fails filter i."""
    rows = work.write(_rows(docs, F.col(part), id_col, text_col, block_bytes), "rows")
    again = work.write(repeated_texts(rows.where("text IS NOT NULL").select("rid", "doc_id", "text"), work, trie_bytes, range_bytes), "again")
    own = rows.select("doc_id", "part", "mask", "first", "copy").join(again.withColumn("again", F.lit(True)), "first", "left")
    fails = F.col("copy") | F.coalesce("again", F.lit(False))
    return own.select("doc_id", "part", (F.col("mask") + F.when(fails, DUPLICATE).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", **sizes: int) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row
    for each part, order of the filters and step.  The counts are within the part, after the step or of its filter.

    sizes: block_bytes, trie_bytes and range_bytes of ``failures``.
    """
    work = Scratch(docs.sparkSession, "filter_audit")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    cells = failures(docs, work, part, **sizes).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    told = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    cells = work.write(cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), told("quality"), told("toxic")), "cells")
    work.keep("cells")
    return interactions(cells)


def interactions(cells: DataFrame) -> DataFrame:
    """The audit from (part, mask, n, quality, toxic), of which a part has 32 at most."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    own, before = F.col("filter_order").substr(F.col("step"), F.lit(1)), F.expr("substring(filter_order, 1, step - 1)")
    bit = sum((F.when(own == c, 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    earlier = sum((F.when(before.contains(c), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    rows = rows.select("*", bit.alias("bit"), earlier.alias("earlier"))

    def total(holds, field: str = "n", times=lambda mask: F.lit(1)) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(holds(c["mask"]), c[field] * times(c["mask"])).otherwise(F.lit(0).cast("long")))

    has = lambda mask, bits: mask.bitwiseAND(F.col(bits)) != 0
    gone = lambda m: has(m, "bit") & ~has(m, "earlier")
    share = lambda m: F.lit(120) / F.bit_count(m)  # noqa: E731  orders in which a filter comes first of those that a document fails
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~has(m, "bit") & ~has(m, "earlier")).alias("kept"), total(gone).alias("removed"), total(lambda m: has(m, "bit") & has(m, "earlier")).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"), total(gone, "quality").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"),
        total(lambda m: has(m, "bit"), "n", lambda m: share(m).cast("long")).alias("shapley"),
    )
