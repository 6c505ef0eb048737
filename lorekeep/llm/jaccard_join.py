"""Join of documents whose sets of word n-grams are similar, with adaptive multi-match prefixes.

The tokens of a document are the distinct hashes (64 bits) of its n-word shingles, in one order for
all documents: by their frequency in the corpus, rarest first, then by hash.  Documents of size x
and y with Jaccard similarity t or more share t/(1+t)(x+y) tokens at least, so of the first
x - ceil(t x) + l tokens of one and of the other (the l-prefixes) they share l at least.  Each
document takes the l for which its own cost, matches in the prefix and candidates to verify, is
estimated least; a pair then shares as many prefix tokens as the smaller l of the two asks for.

1. Documents with equal sets form a class; only its first document goes on.
2. Frequencies: blocks of documents send their distinct hashes to buckets, which answer with the
   frequency of each.  A token that one document has can match nothing, so only others are kept.
3. Candidates come from the postings of prefix tokens, in rounds (``posting_lists.link_lists``).  In the end
   each pair of documents that share a prefix token has been tried or lies in one component, and a group
   of near copies costs a few pairs a document and not all pairs.  Length and place filters drop pairs
   that cannot reach the threshold.
4. Pairs that share enough prefix tokens are verified on their whole sets.

Documents that share prefix tokens without being near copies of each other are all tried against each other: where
most of a text is made of common passages, pairs grow with the square of the documents that share a token.

Cases: null and empty texts, or texts without words, have empty sets and link with nothing; texts
with fewer words than n have their whole sequence as one shingle; repeated rows are rows of one
class; rows with a null id take part and never lend it to a component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BLOCK_BYTES, Block, Scratch, Words, bucket_count, chunks, extra_columns, pack_documents, sequence_hash, tidy
from lorekeep.llm.posting_lists import codes_of, frequencies, link_lists

#: Largest number of matches a prefix is lengthened for.
MOST_MATCHES = 6
#: A verification costs as much as matching one posting for so many tokens.
TOKENS_A_MATCH = 8
_ORD = 16  # bits of a document's place in its block


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    out = []
    for group in chunks(block.texts()):
        words = Words(group, lower=True)
        hashes, at = words.windows(n)
        cut = np.searchsorted(at, words.first)
        for d in range(len(group)):
            a, b = words.first[d], words.first[d + 1]
            if 0 < b - a < n:
                out.append(np.array([sequence_hash(words.hashes[a:b])], np.uint64))
            else:
                out.append(np.unique(hashes[cut[d] : cut[d + 1]]))
    return out


def members_of(blocks: DataFrame, n: int) -> DataFrame:
    """(rid, doc_id, n_shingles, signature) of each document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                sets = shingle_sets(block, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((block.block << _ORD) + np.arange(len(block)), pa.int64()),
                        block.doc_ids(),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["rid", "doc_id", "n_shingles", "signature"],
                )

    return blocks.mapInArrow(tidy(run), "rid long, doc_id long, n_shingles long, signature binary")


def choose_matches(code: np.ndarray, size: int, shortest: int) -> int:
    """The number of matches l with the least estimated cost for a document.

    code: of its tokens in order.  A prefix meets at most the other postings of its tokens; a
    candidate takes l of these meetings, and its verification costs in proportion to the size.
    """
    most = min(MOST_MATCHES, size - shortest + 1)
    meetings = np.cumsum(np.exp2(code[: shortest + most - 1] / 8.0) - 1)
    cost = [meetings[shortest + m - 2] * (1 + size / TOKENS_A_MATCH / m) for m in range(1, most + 1)]
    return int(np.argmin(cost)) + 1


def _records(blocks: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """(rid, size, matches, skipped, prefix, tokens) of each class's first document with a prefix
    token that another document has; skipped counts the prefix tokens before the kept ones."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                sets = shingle_sets(block, n)
                chosen = set(row["chosen"] or [])
                codes = codes_of(sets, row["counts"], buckets)
                rows, at = [], 0
                for d, s in enumerate(sets):
                    code, at = codes[at : at + len(s)], at + len(s)
                    if d not in chosen or not code.any():
                        continue
                    size = len(s)
                    shortest = size - -(-num * size // den) + 1
                    order = np.lexsort((s, code))
                    matches = choose_matches(code[order], size, shortest)
                    prefix = order[: shortest + matches - 1]
                    skipped = int((code[prefix] == 0).sum())
                    if skipped < len(prefix):
                        rows.append(((block.block << _ORD) + d, size, matches, skipped, s[prefix[skipped:]].astype(np.int64), s[code > 0].astype(np.int64)))
                    if len(rows) >= 512:
                        yield _record_batch(rows)
                        rows = []
                if rows:
                    yield _record_batch(rows)

    return blocks.mapInArrow(tidy(run), "rid long, size long, matches int, skipped int, prefix array<long>, tokens array<long>")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, col)]), pa.int32()), pa.array(np.concatenate(col), pa.int64())) for col in ([r[4] for r in rows], [r[5] for r in rows])]
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*cols, *lists], names=["rid", "size", "matches", "skipped", "prefix", "tokens"])


def _possible(num: int, den: int):
    """Length and place filters on a pair that meets at a token: if it is their first common one,
    what follows it must be long enough."""
    need = F.ceil((F.col("a_size") + F.col("b_size")) * num / (num + den) - 1e-9)
    near = F.least("a_size", "b_size") * den >= F.greatest("a_size", "b_size") * num
    return near & (F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= need)


def _verify(pairs: DataFrame, records: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that share enough prefix tokens and then enough tokens."""
    light = records.select("rid", "matches", "prefix")
    side = lambda df, s: df.select(*[F.col(c).alias(s if c == "rid" else f"{s}_{c}") for c in df.columns])
    meet = pairs.join(side(light, "a"), "a").join(side(light, "b"), "b")
    meet = meet.where(F.size(F.array_intersect("a_prefix", "b_prefix")) >= F.least("a_matches", "b_matches")).select("a", "b")
    full = records.select("rid", "size", "tokens")
    both = meet.join(side(full, "a"), "a").join(side(full, "b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(shared * (den + num) >= (F.col("a_size") + F.col("b_size")) * num).select("a", "b")


def similar_documents(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component, component_id): components of documents linked by a similarity
    of num / den or more; component is a key of the class, component_id its smallest doc_id."""
    work = Scratch(docs.sparkSession, "jaccard_join")
    blocks = work.write(pack_documents(docs, id_col, text_col, block_bytes), "blocks")
    return _classes(blocks, work, n, num, den, keep_blocks=False).select("doc_id", "n_shingles", "component", "component_id")


def distinct_documents(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs, with their columns, of which one of each component is left: the one with the
    smallest doc_id (null last; of equal ones the first read)."""
    work = Scratch(docs.sparkSession, "jaccard_join")
    blocks = work.write(pack_documents(docs, carry=True), "blocks")
    own = _classes(blocks, work, n, num, den, keep_blocks=True)
    first = own.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")).select("m.rid")
    left = work.write(first.groupBy(F.shiftright("rid", _ORD).alias("block")).agg(F.collect_list(F.col("rid").bitwiseAND((1 << _ORD) - 1).cast("int")).alias("left")), "left")
    columns = docs.columns

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                keep = np.zeros(len(block), bool)
                keep[row["left"] or []] = True
                extra = extra_columns(row["extra"])
                texts = list(block.texts())
                out = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else extra[f"_{c}"].combine_chunks() for c in columns]
                yield from pa.table(out, names=columns).filter(pa.array(keep)).to_batches(max_chunksize=512)

    return blocks.join(left, "block", "left").mapInArrow(tidy(finish), docs.schema)


def _classes(blocks: DataFrame, work: Scratch, n: int, num: int, den: int, keep_blocks: bool) -> DataFrame:
    """(rid, doc_id, n_shingles, component, component_id) of each document."""
    blocks = blocks.drop("extra")
    members = work.write(members_of(blocks, n), "members")
    first = work.write(members.where("signature IS NOT NULL").groupBy("signature").agg(F.min("rid").alias("rid")), "first")
    chosen = first.groupBy(F.shiftright("rid", _ORD).alias("block")).agg(F.collect_list(F.col("rid").bitwiseAND((1 << _ORD) - 1).cast("int")).alias("chosen"))
    buckets = bucket_count(blocks)
    counts = work.write(frequencies(blocks, lambda block: shingle_sets(block, n), buckets), "counts")
    records = work.write(_records(blocks.join(counts, "block", "left").join(chosen, "block", "left"), n, num, den, buckets), "records")
    work.drop("counts", *([] if keep_blocks else ["blocks"]))

    postings = records.select("rid", "size", "skipped", F.posexplode("prefix").alias("i", "token")).select("token", "rid", "size", (F.col("i") + F.col("skipped")).alias("at"))
    labels = records.select("rid", F.col("rid").alias("label"))
    labels = link_lists(postings, _possible(num, den), lambda pairs, _: _verify(pairs, records, num, den), labels, work)

    own = members.join(first.select("signature", F.col("rid").alias("first")), "signature", "left").join(labels.select(F.col("rid").alias("first"), "label"), "first", "left")
    own = own.select("rid", "doc_id", "n_shingles", F.coalesce("label", "first", "rid").alias("component"))
    own = work.write(own, "own")
    # written, so that the join can split a component with many documents
    least = work.write(own.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    work.keep("own", "least", "blocks")
    return own.join(least, "component").select("doc_id", "n_shingles", "component", "component_id", "rid")
