"""Scores of texts under a class-based bigram model whose classes come from exchange clustering.

P(text) is the product over its tokens of P(class | class before) P(word | class); a text's tokens
are its words and one end, and the end stands before the first word too.

1. Blocks of texts keep token numbers, the block's distinct words and their counts in training texts;
   sums over blocks are the vocabulary, a row for each word of the training texts.
2. The ``HEAD`` most frequent words are clustered by exchange.  Their bigrams (all other words are one
   more word) are counted once over the corpus; a table of at most (HEAD + 2)² sums is all that the
   rounds read.  A round moves each word of one half to the class in which the class-bigram likelihood
   gains most; it counts only if the likelihood of the new classes, counted anew, is higher, else fewer
   words move.  Rounds end when both halves in turn raise it by less than ``LEAST_RISE`` of itself.
3. Every other word seen twice or more goes to the class that its own contexts fit best: blocks send
   the classes on both sides of each occurrence to buckets of words, which answer with class and count.
   A word that is frequent in a block is sent as counts, and these are summed over blocks first.
   Words seen once stay together in the last class, which stands for unknown words too.
4. Class transitions are counted with all classes, and then every block scores its texts.

What is broadcast has a fixed size (the head words, class by class); other words are looked up in
buckets.  Within a class words have their share of its tokens, smoothed as in the base score, with one
more word in the last class for all unknown ones.

Cases: null and empty texts have the end only; a null id counts as held out (remainder of the empty
text); repeated rows are texts like others; ties in frequency go by the word, ties in gain to the
smaller class; without training texts the model knows no token and scores by its smoothing alone; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BUCKET_BYTES, Scratch, expand, squeeze, tidy, tidy_group

#: Classes: 0 is the end, the last holds words seen once and unknown ones.
CLASSES = 64
#: Words that are clustered in rounds; one more number stands for all others.
HEAD = 4096
_REST = HEAD + 1
#: A word that occurs so often in a block leaves it as counts, which are summed before they meet in its bucket.
FREQUENT = 8
#: A round that raises the likelihood by less than this share of it changes nothing worth a round.
LEAST_RISE = 2e-4
#: Rows of the table of head bigrams.
GROUPS = 64
#: Bytes of text in a block: the larger, the fewer words to look up.
BLOCK_BYTES = 8 << 20
#: Added to each count of a class transition, and to each word's count.
SMOOTH = 0.1
#: Bigrams that a task keeps before it hands them on, and words of a bucket that are judged at once.
_PAIRS, _PORTION = 1 << 21, 1 << 14
_END = b"\n"

_BLOCKS = "block long, n_bytes long, ids binary, nulls binary, held binary, sizes binary, tokens binary, words binary, counts binary"


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then the next ones; small numbers leave zeros together."""
    return squeeze(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _tokenised(docs: DataFrame, block_bytes: int) -> DataFrame:
    def make(block: int, rows: list[tuple]) -> pa.RecordBatch:
        number: defaultdict = defaultdict(count().__next__)
        number[_END]
        parts, sizes = [], []
        for _, held, text in rows:
            words = text.lower().split()  # of bytes: A-Z, and the white space of ASCII
            words.append(_END)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        tokens = np.concatenate(parts)
        every = np.bincount(tokens)
        every[0] = len(tokens) + 1  # the end is the first, then the more frequent words
        order = np.argsort(-every, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        held = np.array([r[1] for r in rows])
        counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(order))
        names = list(number)
        row = {
            "block": block,
            "n_bytes": sum(len(r[2]) for r in rows),
            "ids": np.array([r[0] or 0 for r in rows], np.int64).tobytes(),
            "nulls": np.array([r[0] is None for r in rows], np.uint8).tobytes(),
            "held": held.astype(np.uint8).tobytes(),
            "sizes": np.array(sizes, np.int64).tobytes(),
            "tokens": _pack_numbers(tokens),
            "words": squeeze(b"\n".join([names[i] for i in order[1:].tolist()])),
            "counts": _pack_numbers(counts),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_SCHEMA)

    def run(batches):
        from pyspark import TaskContext

        block, rows, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for i, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                if rows and size + len(text) + 1 > block_bytes:
                    yield make(block, rows)
                    block, rows, size = block + 1, [], 0
                rows.append((i, held, text))
                size += len(text) + 1
        if rows:
            yield make(block, rows)

    return docs.mapInArrow(tidy(run), _BLOCKS)


_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), *[(n, pa.binary()) for n in ("ids", "nulls", "held", "sizes", "tokens", "words", "counts")]])


def _words(row: dict) -> list[bytes]:
    """The block's words but the end; number 1 is the first of them."""
    data = expand(row["words"])
    return data.split(b"\n") if data else []


def _own(row: dict) -> np.ndarray:
    """Whether each token belongs to a training text."""
    return ~np.repeat(np.frombuffer(row["held"], np.uint8).astype(bool), np.frombuffer(row["sizes"], np.int64))


def _before(classes: np.ndarray) -> np.ndarray:
    """What stands before each token; each text ends with the end, and so begins after one."""
    return np.concatenate([[0], classes[:-1]])


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, n) of the words of training texts, the end among them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = [_END, *_words(row)], _unpack_numbers(row["counts"])
                for a in range(0, len(words), 1 << 16):
                    n = counts[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 16)], pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    return blocks.select("words", "counts").mapInArrow(tidy(run), "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


# Exchange of the head words ---------------------------------------------------------------------


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts


def _codes(words: list[bytes], head: dict[bytes, int]) -> np.ndarray:
    """Number of each of the block's words in the head, the end first."""
    return np.fromiter((head.get(w, _REST) for w in [_END, *words]), np.int64, len(words) + 1)


def head_bigrams(blocks: DataFrame, head: list[bytes], work: Scratch) -> DataFrame:
    """(part, data): for some head words each, their bigrams on both sides, packed.  GROUPS rows."""
    numbers = {_END: 0, **{w: i for i, w in enumerate(head, 1)}}
    shared = blocks.sparkSession.sparkContext.broadcast(numbers)  # HEAD words

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
        for batch in batches:
            for row in batch.to_pylist():
                code = _codes(_words(row), shared.value)[_unpack_numbers(row["tokens"])]
                own = _own(row)
                k, n = np.unique((_before(code) * (HEAD + 2) + code)[own], return_counts=True)
                keys, counts = _merge(np.concatenate([keys, k]), np.concatenate([counts, n]))
                if len(keys) > _PAIRS:
                    yield batch_of()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield batch_of()

    def pack(table: pa.Table) -> pa.Table:
        word, other, side = (table[c].to_numpy().astype(np.uint16) for c in ("word", "other", "side"))
        data = np.int64(len(word)).tobytes() + table["n"].to_numpy().astype(np.int64).tobytes() + word.tobytes() + other.tobytes() + side.astype(np.uint8).tobytes()
        return pa.table({"part": table["part"].slice(0, 1), "data": pa.array([squeeze(data)], pa.binary())})

    found = blocks.select("held", "sizes", "tokens", "words").mapInArrow(tidy(run), "pair long, n long")
    pairs = work.write(found.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a, b = F.floor(F.col("pair") / (HEAD + 2)), F.col("pair") % (HEAD + 2)
    both = pairs.select(F.explode(F.array(F.struct(a.alias("word"), b.alias("other"), F.lit(0).alias("side")), F.struct(b.alias("word"), a.alias("other"), F.lit(1).alias("side")))).alias("s"), "n")
    both = both.select((F.col("s.word") % GROUPS).cast("int").alias("part"), F.col("s.word").cast("int").alias("word"), F.col("s.other").cast("int").alias("other"), F.col("s.side").alias("side"), "n")
    return work.write(both.groupBy("part").applyInArrow(tidy_group(pack), "part int, data binary"), "bigrams")  # 2 (HEAD + 2)² / GROUPS sums a group


def _sides(part: int, data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a group, and how often each class stands before and after each of them."""
    data = expand(data)
    m = int(np.frombuffer(data, np.int64, 1)[0])
    n = np.frombuffer(data, np.int64, m, 8)
    word, other = np.frombuffer(data, np.uint16, m, 8 + 8 * m), np.frombuffer(data, np.uint16, m, 8 + 10 * m)
    side = np.frombuffer(data, np.uint8, m, 8 + 12 * m)
    words = np.arange(part, HEAD + 2, GROUPS)
    cell = (side.astype(np.int64) * len(words) + word // GROUPS) * CLASSES + classes[other]
    right, left = np.bincount(cell, n, 2 * len(words) * CLASSES).reshape(2, -1, CLASSES)
    return words, left, right


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(trans: np.ndarray) -> float:
    """The part of the training texts' log-likelihood that depends on the classes."""
    return float(_phi(trans).sum() - _phi(trans.sum(1)).sum() - _phi(trans.sum(0)).sum())


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class to which each word would best go, and what it gains over the word's own class.

    left, right: a word's counts of classes before and after; own: its class now; trans: transitions.
    The word is taken out of its own class first.  Class 0 is the end's alone, the last the rest's.
    """
    k = len(trans)
    n = left.sum(1)
    size = trans.sum(0)
    gain = np.full((len(own), k), -np.inf)
    for b in range(1, k):
        mine = (own == b)[:, None]
        row = np.maximum(trans[b][None, :] - np.where(mine, right, 0), 0)
        col = np.maximum(trans[:, b][None, :] - np.where(mine, left, 0), 0)
        total = np.maximum(size[b] - np.where(mine[:, 0], n, 0), 0)
        gain[:, b] = (_phi(row + right) - _phi(row)).sum(1) + (_phi(col + left) - _phi(col)).sum(1) - 2 * (_phi(total + n) - _phi(total))
    here = gain[np.arange(len(own)), own]
    gain[:, k - 1] = np.where(own == k - 1, gain[:, k - 1], -np.inf)
    best = gain.argmax(1)
    return best, gain[np.arange(len(own)), best] - here


@dataclass
class Exchange:
    """Clustering by rounds: each asks the table of bigrams for transitions and for moves."""

    bigrams: DataFrame
    classes: np.ndarray  # of the end, the head words, the rest
    history: list[float] = field(default_factory=list)

    def _ask(self, answer: Callable, schema: str) -> list:
        def run(batches):
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_pydict(answer(part, data))

        return self.bigrams.mapInArrow(tidy(run), schema).collect()  # fixed size: classes by classes, or the head words

    def transitions(self, classes: np.ndarray) -> np.ndarray:
        def answer(part, data):
            words, _, right = _sides(part, data, classes)
            trans = np.zeros((CLASSES, CLASSES))
            np.add.at(trans, classes[words], right)
            return {"trans": [trans.tobytes()]}

        return sum((np.frombuffer(r.trans).reshape(CLASSES, CLASSES) for r in self._ask(answer, "trans binary")), np.zeros((CLASSES, CLASSES)))

    def moves(self, trans: np.ndarray, turn: int) -> list:
        """(word, to, gain), the largest gain first."""
        classes = self.classes

        def answer(part, data):
            words, left, right = _sides(part, data, classes)
            due = (words > 0) & (words < _REST) & ((words // GROUPS + words) % 2 == turn % 2) & (left.sum(1) > 0)
            to, gain = best_classes(left[due], right[due], classes[words[due]], trans)
            moving = gain > 1e-9
            return {"word": words[due][moving], "to": to[moving], "gain": gain[moving]}

        return sorted(self._ask(answer, "word long, to long, gain double"), key=lambda r: (-r.gain, r.word))

    def run(self) -> np.ndarray:
        trans = self.transitions(self.classes)
        self.history = [likelihood(trans)]
        turn = still = 0
        while still < 2:
            rows, now = self.moves(trans, turn), self.history[-1]
            while rows:
                new = self.classes.copy()
                new[[r.word for r in rows]] = [r.to for r in rows]
                after = self.transitions(new)
                if likelihood(after) > now:
                    self.classes, trans = new, after
                    self.history.append(likelihood(after))
                    break
                rows = rows[: len(rows) // 4]  # words that move at once can spoil each other's gain
            still = 0 if self.history[-1] - now > LEAST_RISE * abs(now) else still + 1
            turn += 1
        return self.classes


def cluster_head(blocks: DataFrame, head: list[bytes], work: Scratch) -> Exchange:
    """Classes of the head words after the rounds; the most frequent ones begin as classes of their own."""
    classes = np.full(HEAD + 2, CLASSES - 1, np.int64)
    classes[0] = 0
    seeds = min(len(head), CLASSES - 2)
    classes[1 : 1 + seeds] = np.arange(1, 1 + seeds)
    found = Exchange(head_bigrams(blocks, head, work), classes)
    if head:
        found.run()
    return found


# All other words --------------------------------------------------------------------------------


def _bucket_slices(words: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the words by bucket, and the slice of each bucket."""
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    order = np.argsort(crc, kind="stable")
    bucket = crc[order] * buckets >> 32
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    return order, [(int(bucket[a]), slice(a, b)) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(words)], strict=True) if a < b]


def place_words(blocks: DataFrame, head: dict[bytes, tuple[int, int]], trans: np.ndarray, buckets: int, work: Scratch) -> DataFrame:
    """(block, bucket, classes, seen, members): class and training count of the block's words that are
    not in the head; a row without a block tells how many words a bucket has of each class.

    head: class and training count of head words.  A word's class is the one with the largest
    first-order gain in likelihood, sum of log N(class, other) over its contexts less 2 n log N(class).

    Words that are frequent in a block leave it as counts by class and side, which Spark sums over the blocks, so
    that such a word is 2 * CLASSES numbers in its bucket however often it occurs.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(head)  # HEAD words
    log_trans, log_size = np.log(trans + SMOOTH), np.log(trans.sum(0) + SMOOTH)
    columns = ["bucket", "block", "data", "word", "cells", "sums"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row)
                tokens, own, counts = _unpack_numbers(row["tokens"]), _own(row), _unpack_numbers(row["counts"])
                place = np.fromiter((shared.value.get(w, (CLASSES,))[0] for w in words), np.int64, len(words))
                rest = np.flatnonzero(place == CLASSES)
                order, parts = _bucket_slices([words[i] for i in rest.tolist()], buckets)
                rest = rest[order] + 1
                rank = np.full(len(words) + 1, -1)
                rank[rest] = np.arange(len(rest))
                cls = np.concatenate([[0], np.minimum(place, CLASSES - 1)])[tokens]
                at = np.flatnonzero(own & (rank[tokens] >= 0))
                at = at[np.argsort(rank[tokens[at]], kind="stable")]
                # the token after a word is in the same text, for the end is in the head
                left, right = _before(cls)[at], cls[at + 1]
                n = counts[rest].astype(np.int32)
                often = n >= FREQUENT
                word = rank[tokens[at]]
                summed = often[word]
                cells = np.concatenate([word[summed] * 2 * CLASSES + left[summed], (word[summed] * 2 + 1) * CLASSES + right[summed]])
                cells, sums = np.unique(cells, return_counts=True)
                left, right = left[~summed].astype(np.uint8), right[~summed].astype(np.uint8)
                single = np.where(often, 0, n).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(single)])
                rows = []
                for b, s in parts:
                    names = b"\n".join([words[i - 1] for i in rest[s].tolist()])
                    a, z = int(ends[s.start]), int(ends[s.stop])
                    rows.append((b, row["block"], squeeze(np.array([s.stop - s.start, z - a], np.int64).tobytes() + n[s].tobytes() + single[s].tobytes() + left[a:z].tobytes() + right[a:z].tobytes() + names), None, None, None))
                cut = np.flatnonzero(np.diff(cells // (2 * CLASSES), prepend=-1))
                for a, z in zip(cut.tolist(), [*cut.tolist(), len(cells)][1:], strict=True):
                    rows.append((None, None, None, words[rest[cells[a] // (2 * CLASSES)] - 1], (cells[a:z] % (2 * CLASSES)).tolist(), sums[a:z].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=columns)

    def answer(table: pa.Table) -> pa.Table:
        number: defaultdict = defaultdict(count().__next__)
        own, totals, occurrences, left, right = [], [], [], [], []
        packed = table.filter(table["data"].is_valid())
        for data in packed["data"].to_pylist():
            data = expand(data)
            m, t = np.frombuffer(data, np.int64, 2).tolist()
            at = 16 + 8 * m
            own.append(np.fromiter(map(number.__getitem__, data[at + 2 * t :].split(b"\n")), np.int64, m))
            totals.append(np.frombuffer(data, np.int32, m, 16))
            occurrences.append(np.repeat(own[-1], np.frombuffer(data, np.int32, m, 16 + 4 * m)))
            left.append(np.frombuffer(data, np.uint8, t, at))
            right.append(np.frombuffer(data, np.uint8, t, at + t))
        word, left, right = np.concatenate(occurrences), np.concatenate(left), np.concatenate(right)
        total = np.bincount(np.concatenate(own), np.concatenate(totals), len(number)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, left, right = word[order], left[order], right[order]
        summed = table.filter(table["word"].is_valid())
        cells, sums = (summed[c].combine_chunks() for c in ("cells", "sums"))
        often = np.repeat(np.array([number[w] for w in summed["word"].to_pylist()], np.int64), cells.value_lengths().to_numpy(zero_copy_only=False))
        cells, sums = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sums.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        classes = np.full(len(number), CLASSES - 1, np.uint8)
        for a in range(0, len(number), _PORTION):
            m = min(_PORTION, len(number) - a)
            i, j = np.searchsorted(word, [a, a + m])
            cell = (word[i:j] - a) * CLASSES
            before, after = (np.bincount(cell + x[i:j], minlength=m * CLASSES).reshape(m, CLASSES).astype(np.float64) for x in (left, right))
            mine = np.flatnonzero((often >= a) & (often < a + m))
            both = np.bincount((often[mine] - a) * 2 * CLASSES + cells[mine], sums[mine], m * 2 * CLASSES).reshape(m, 2 * CLASSES)
            before, after = before + both[:, :CLASSES], after + both[:, CLASSES:]
            gain = after @ log_trans.T + before @ log_trans - 2 * total[a : a + m, None] * log_size
            classes[a : a + m] = np.where(total[a : a + m] > 1, 1 + gain[:, 1 : CLASSES - 1].argmax(1), CLASSES - 1)
        members = np.bincount(classes[total > 0], minlength=CLASSES).tolist()
        return pa.table({
            "block": pa.array([*packed["block"].to_pylist(), None], pa.int64()), "bucket": pa.array([*packed["bucket"].to_pylist(), None], pa.int64()),
            "classes": pa.array([*(squeeze(classes[x].tobytes()) for x in own), None], pa.binary()),
            "seen": pa.array([*(_pack_numbers(total[x]) for x in own), None], pa.binary()),
            "members": pa.array([*[None] * len(own), members], pa.list_(pa.int64())),
        })

    sent = blocks.select("block", "held", "sizes", "tokens", "words", "counts").mapInArrow(tidy(send), "bucket long, block long, data binary, word binary, cells array<int>, sums array<long>")
    sent = work.write(sent, "sent")
    each = sent.where("word IS NOT NULL").select("word", F.explode(F.arrays_zip("cells", "sums")).alias("c")).groupBy("word", "c.cells").agg(F.sum("c.sums").alias("n"))
    lists = each.groupBy("word").agg(F.collect_list(F.struct("cells", "n")).alias("c"))  # 2 * CLASSES at most
    none = F.lit(None)
    often = lists.select(F.shiftright(F.crc32("word") * buckets, 32).alias("bucket"), none.cast("long").alias("block"), none.cast("binary").alias("data"), "word", F.col("c.cells").alias("cells"), F.col("c.n").alias("sums"))
    return sent.where("word IS NULL").unionByName(often).groupBy("bucket").applyInArrow(tidy_group(answer), "block long, bucket long, classes binary, seen binary, members array<long>")


def class_members(answers: DataFrame, classes: np.ndarray, n_head: int) -> np.ndarray:
    """Words of training texts in each class; unknown ones count as one more of the last."""
    members = np.bincount(classes[1 : 1 + n_head], minlength=CLASSES).astype(np.float64)
    members[0] = 1
    for r in answers.where("members IS NOT NULL").select(F.posexplode("members").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():  # a row for each class
        members[r.c] += r.n
    members[CLASSES - 1] += 1
    return members


def code_blocks(blocks: DataFrame, answers: DataFrame, head: dict[bytes, tuple[int, int]], buckets: int) -> DataFrame:
    """The blocks with class and training count of each of their words in place of the words."""
    shared = blocks.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row)
                classes, seen = np.full(len(words) + 1, CLASSES - 1, np.int64), np.zeros(len(words) + 1, np.int64)
                place = [shared.value.get(w) for w in words]
                rest = np.array([i for i, p in enumerate(place) if p is None], np.int64)
                own = np.array([i for i, p in enumerate(place) if p is not None], np.int64)
                if len(own):
                    classes[own + 1], seen[own + 1] = np.array([place[i] for i in own.tolist()]).T
                order, _ = _bucket_slices([words[i] for i in rest.tolist()], buckets)
                if len(rest):
                    classes[rest[order] + 1] = np.concatenate([np.frombuffer(expand(k["classes"]), np.uint8) for k in row["known"]])
                    seen[rest[order] + 1] = np.concatenate([_unpack_numbers(k["seen"]) for k in row["known"]])
                classes[0], seen[0] = shared.value[_END]
                out = {k: row[k] for k in ("ids", "nulls", "held", "sizes", "tokens")} | {"classes": squeeze(classes.astype(np.uint8).tobytes()), "seen": squeeze(seen.tobytes())}
                yield pa.RecordBatch.from_pylist([out], pa.schema([(k, pa.binary()) for k in out]))

    known = answers.where("block IS NOT NULL").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes", "seen"))).alias("known"))
    return blocks.join(known, "block", "left").mapInArrow(tidy(run), "ids binary, nulls binary, held binary, sizes binary, tokens binary, classes binary, seen binary")


def class_transitions(coded: DataFrame) -> np.ndarray:
    """Transitions between classes in training texts."""

    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                cls = np.frombuffer(expand(row["classes"]), np.uint8).astype(np.int64)[_unpack_numbers(row["tokens"])]
                own = _own(row)
                total += np.bincount((_before(cls) * CLASSES + cls)[own], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    trans = np.zeros(CLASSES * CLASSES)
    for r in coded.select("held", "sizes", "tokens", "classes").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        trans[r.cell] = r.n
    return trans.reshape(CLASSES, CLASSES)


def held_out(doc_id: str = "doc_id"):
    """Texts which the model does not learn from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    work = Scratch(docs.sparkSession, "class_ngrams")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("doc_id", (held_out() if held is None else held).alias("held"), "text")
    blocks = work.write(_tokenised(source, block_bytes), "blocks")
    buckets = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))
    words = work.write(vocabulary(blocks), "words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == _END, F.col("n"))).alias("ends")).first()
    train_tokens, kinds = total.n or 0, total.v
    top = words.where(F.col("word") != _END).orderBy(F.desc("n"), "word").limit(HEAD).collect()  # HEAD words
    exchange = cluster_head(blocks, [bytes(r.word) for r in top], work)
    head = {_END: (0, total.ends or 0), **{bytes(r.word): (int(exchange.classes[i]), r.n) for i, r in enumerate(top, 1)}}
    answers = work.write(place_words(blocks, head, exchange.transitions(exchange.classes), buckets, work), "answers")
    coded = work.write(code_blocks(blocks, answers, head, buckets), "coded")
    trans, members = class_transitions(coded), class_members(answers, exchange.classes, len(top))
    work.drop("blocks", "words", "pairs", "bigrams", "sent", "answers")

    log_trans = np.log10((trans + SMOOTH) / (trans.sum(1, keepdims=True) + SMOOTH * CLASSES))
    log_weight = np.log10(trans.sum(0) + SMOOTH * np.maximum(members, 1))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _unpack_numbers(row["tokens"])
                classes, seen = np.frombuffer(expand(row["classes"]), np.uint8).astype(np.int64), np.frombuffer(expand(row["seen"]), np.int64)
                cls = classes[tokens]
                sizes = np.frombuffer(row["sizes"], np.int64)
                first = np.cumsum(sizes) - sizes
                base = np.log10((seen + 0.1) / (train_tokens + 0.1 * (kinds + 1)))
                emit = np.log10(seen + SMOOTH) - log_weight[classes]
                score = np.add.reduceat(emit[tokens] + log_trans[_before(cls), cls], first)
                cols = [pa.array(np.frombuffer(row["held"], np.uint8).astype(bool)), pa.array(sizes), pa.array(np.add.reduceat((seen > 0)[tokens].astype(np.int64), first)), pa.array(np.full(len(sizes), train_tokens)), pa.array(np.add.reduceat(base[tokens], first)), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300))]
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return coded.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
