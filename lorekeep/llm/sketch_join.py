"""Near copies by bottom-k sketches: inverted lists propose, sketches of unions estimate, full sets decide.

A document's set holds the 64-bit hashes of its distinct n-word shingles.  One hash function serves for all: the
sketch of a set is its ``RETAINED`` smallest hashes, a small set's sketch is the set.  The smallest
hashes of a union of two sets are found in the union of their sketches, and each of them is common to both sets with
the probability of their Jaccard similarity.

How many retained values two similar sets must share follows from that: for sets that fit into their sketches
it is exact, and for larger ones it is the count that a binomial variable falls short of with a
probability below ``MISS``.  This is the chance that a link is lost, the order of a collision of hashes.

1. Documents with equal sets form a class; its first document goes on.
2. Inverted lists: a document that must share c of its r retained values with any partner shares one of
   its r - c + 1 rarest, so only those are posted, and of them only values that another document retains.
   What very many documents have in common comes last and is seldom posted at all.
3. Lists are gone through in rounds (``posting_lists.link_lists``): a list of near copies costs a few pairs a
   document, and no pair of a list is left out unless it is connected already.  Pairs whose sizes, or the
   places of the value in both sketches, rule the similarity out are dropped at once.
4. The other pairs are estimated on the sketch of their union; those that reach the least count are
   verified on their full sets.  Pairs of small sets are certain already.

A list of documents that share its value and are no near copies of each other still costs the square of
its length in pairs.  It takes documents that consist mostly of the same common passages.

Cases: null and empty texts, or texts without words, have empty sets and link with nothing; texts with fewer
words than n have their whole sequence as one shingle; repeated rows are rows of one class; a row with a null id
takes part, never lends it to a component and is kept if all of its component have none; an empty table gives no
rows; very long texts are blocks of their own, and a worker needs about ten bytes for each of their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BLOCK_BYTES, Block, Scratch, bucket_count, pack_documents, tidy
from lorekeep.llm.jaccard_join import members_of, shingle_sets
from lorekeep.llm.posting_lists import codes_of, frequencies, link_lists

#: Values of a sketch.
RETAINED = 1024
#: Chance that the sketches of two linked documents share less than is asked for.
MISS = 1e-15
_ORD = 16  # bits of a document's place in its block
_SIGN = np.uint64(1 << 63)  # turned, unsigned hashes keep their order as longs


def sure_matches(k: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest c for which k draws with success num/den give fewer than c with a chance below miss."""
    if num >= den:
        return k
    below, yes, no = 0.0, math.log(num / den), math.log1p(-num / den)
    for c in range(k + 1):
        below += math.exp(math.lgamma(k + 1) - math.lgamma(c + 1) - math.lgamma(k - c + 1) + c * yes + (k - c) * no)
        if below > miss:
            return c
    return k


def least_shared(size: int, k: int, num: int, den: int, sure: int) -> int:
    """Retained values that a set of this size shares at least with any similar one."""

    def with_partner(other: int) -> int:
        overlap = -(-num * (size + other) // (num + den))
        certain = overlap - max(0, size - k) - max(0, other - k)
        return max(certain, sure if max(size, other) > k else 0)

    least, most = -(-num * size // den), den * size // num
    return max(1, min(with_partner(min(max(b, least), most)) for b in (least, k, k + 1, most)))


def sketches_of(block: Block, n: int, k: int) -> list[np.ndarray]:
    """The k smallest shingle hashes of each document."""
    return [s[:k] for s in shingle_sets(block, n)]


def _records(blocks: DataFrame, n: int, num: int, den: int, k: int, buckets: int) -> DataFrame:
    """(rid, size, skipped, prefix, retained) of each class's first document with a posted value; skipped counts the
    values before the posted ones, which no other document retains.  Retained values are in the hashes' order as longs."""
    sure = sure_matches(k, num, den)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                sets = shingle_sets(block, n)
                sketches, chosen = [s[:k] for s in sets], set(row["chosen"] or [])
                codes = codes_of(sketches, row["counts"], buckets)
                rows, at = [], 0
                for d, s in enumerate(sketches):
                    code, at = codes[at : at + len(s)], at + len(s)
                    if d not in chosen or not code.any():
                        continue
                    order = np.lexsort((s, code))
                    # of the retained values but needed - 1, those that no other document retains come first
                    posted = order[: max(0, len(s) - least_shared(len(sets[d]), k, num, den, sure) + 1)]
                    skipped = int((code[posted] == 0).sum())
                    if skipped < len(posted):
                        rows.append(((block.block << _ORD) + d, len(sets[d]), skipped, s[posted[skipped:]].astype(np.int64), (s ^ _SIGN).astype(np.int64)))
                    if len(rows) >= 512:
                        yield _record_batch(rows)
                        rows = []
                if rows:
                    yield _record_batch(rows)

    return blocks.mapInArrow(tidy(run), "rid long, size long, skipped int, prefix array<long>, retained array<long>")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*cols, _lists([r[3] for r in rows]), _lists([r[4] for r in rows])], names=["rid", "size", "skipped", "prefix", "retained"])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), pa.int64()))


def _sets(blocks: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rid, shingles) of the wanted documents (rid)."""
    places = wanted.groupBy(F.shiftright("rid", _ORD).alias("block")).agg(F.collect_list(F.col("rid").bitwiseAND((1 << _ORD) - 1).cast("int")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                sets, wanted = shingle_sets(block, n), sorted(row["wanted"])
                for a in range(0, len(wanted), 512):
                    some = wanted[a : a + 512]
                    yield pa.RecordBatch.from_arrays([pa.array((block.block << _ORD) + np.array(some), pa.int64()), _lists([sets[d].astype(np.int64) for d in some])], names=["rid", "shingles"])

    return blocks.join(places, "block").mapInArrow(tidy(run), "rid long, shingles array<long>")


def _possible(k: int, num: int, den: int) -> Column:
    """Whether a pair that meets at a value can be similar: by the sizes, and by what follows the value in both
    sketches if it is the first that they share."""
    a, b = F.col("a_size"), F.col("b_size")
    near = F.least(a, b) * den >= F.greatest(a, b) * num
    certain = F.ceil((a + b) * num / (num + den) - 1e-9) - F.greatest(F.lit(0), a - k) - F.greatest(F.lit(0), b - k)
    need = F.greatest(F.lit(1), certain, F.when(F.greatest(a, b) > k, sure_matches(k, num, den)).otherwise(0))
    rest = F.least(F.least(a, F.lit(k)) - F.col("a_at"), F.least(b, F.lit(k)) - F.col("b_at"))
    return near & (rest >= need)


def _linked(pairs: DataFrame, records: DataFrame, sets: DataFrame, work: Scratch, step: str, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar: estimated on sketches, then verified on full sets."""
    side = lambda df, s: df.select(*[F.col(c).alias(s if c == "rid" else f"{s}_{c}") for c in df.columns])
    light = records.select("rid", "size", "retained")
    met = pairs.join(side(light, "a"), "a").join(side(light, "b"), "b")
    common = F.array_intersect("a_retained", "b_retained")
    union = F.slice(F.sort_array(F.array_union("a_retained", "b_retained")), 1, k)
    within = F.size(F.array_intersect(common, union))
    similar = lambda shared: shared * (num + den) >= (F.col("a_size") + F.col("b_size")) * num
    small = F.greatest("a_size", "b_size") <= k
    enough = F.when(small, similar(F.size(common))).otherwise(within >= sure_matches(k, num, den))
    estimated = work.write(met.where(enough).select("a", "b", "a_size", "b_size", small.alias("certain")), f"estimated-{step}")
    both = estimated.where("NOT certain").join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    verified = both.where(similar(F.size(F.array_intersect("a_shingles", "b_shingles"))))
    return estimated.where("certain").select("a", "b").unionByName(verified.select("a", "b"))


def near_copies(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, k: int = RETAINED, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document: component_id is the smallest doc_id that links
    of a similarity of num / den or more lead to, and kept tells that it is the document's own."""
    work = Scratch(docs.sparkSession, "sketch_join")
    blocks = work.write(pack_documents(docs, id_col, text_col, block_bytes), "blocks")
    members = work.write(members_of(blocks, n), "members")
    first = work.write(members.where("signature IS NOT NULL").groupBy("signature").agg(F.min("rid").alias("rid")), "first")
    chosen = first.groupBy(F.shiftright("rid", _ORD).alias("block")).agg(F.collect_list(F.col("rid").bitwiseAND((1 << _ORD) - 1).cast("int")).alias("chosen"))
    buckets = bucket_count(blocks)
    counts = work.write(frequencies(blocks, lambda block: sketches_of(block, n, k), buckets), "counts")
    records = work.write(_records(blocks.join(counts, "block", "left").join(chosen, "block", "left"), n, num, den, k, buckets), "records")
    work.drop("counts")
    # sets that are larger than their sketches
    sets = work.write(_sets(blocks.drop("extra"), records.where(F.col("size") > k).select("rid"), n), "sets")
    work.drop("blocks")

    postings = records.select("rid", "size", "skipped", F.posexplode("prefix").alias("i", "token")).select("token", "rid", "size", (F.col("i") + F.col("skipped")).alias("at"))
    labels = records.select("rid", F.col("rid").alias("label"))
    labels = link_lists(postings, _possible(k, num, den), lambda pairs, step: _linked(pairs, records, sets, work, step, k, num, den), labels, work)

    own = members.join(first.select("signature", F.col("rid").alias("first")), "signature", "left").join(labels.select(F.col("rid").alias("first"), "label"), "first", "left")
    own = work.write(own.select("doc_id", "n_shingles", F.coalesce("label", "first", "rid").alias("component")), "own")
    least = work.write(own.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    work.keep("own", "least")
    return own.join(least, "component").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
