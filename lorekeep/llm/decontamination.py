"""Benchmark decontamination: passages of a text within a few edits of a test item.

Items and texts are lower-cased, ASCII punctuation and white space become single blanks.  An item of n
characters has a budget of k = floor(n * ERRORS) edits and is split into k + 1 pieces: k edits leave one
piece whole, so a passage within the budget holds a piece exactly.  An Aho-Corasick automaton finds all
pieces in one reading of a text; round each hit Myers' bit-parallel algorithm gives the least edit
distance of the item to any passage there.

Items are broadcast in blocks of at most ``ITEM_BYTES``, and every block's pass reads all documents.

Cases: null and empty texts match nothing; items without a letter or digit, and null items, are left
out; repeated items and rows are reported each; of equal distances the first passage is given; empty
tables give no rows; extra columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import tidy

#: Edits allowed for a character of an item.
ERRORS = 0.06
#: Text of the items of one pass.
ITEM_BYTES = 1 << 19

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().translate(_TABLE).split()).decode()


def pieces(item: str, errors: float) -> list[tuple[int, str]]:
    """Place and text of the k + 1 pieces."""
    k = int(len(item) * errors)
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def myers(item: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any part of the text, and where the first such part ends;
    None above ``most``."""
    n = len(item)
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best = None
    for at, char in enumerate(text, 1):
        eq = masks.get(char, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
            most = score
    return best


class Matcher:
    """The items of one block.  items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple], errors: float):
        import ahocorasick

        self.items = [(i, t) for i, text in items if (t := normal(text))]
        self.budget = [int(len(t) * errors) for _, t in self.items]
        self.masks: list[dict[str, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, t) in enumerate(self.items):
            masks: dict[str, int] = {}
            for at, char in enumerate(t):
                masks[char] = masks.get(char, 0) | 1 << at
            self.masks.append(masks)
            for at, piece in pieces(t, errors):
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple]:
        """(item_id, distance, start, end): the best passage of each item, in characters of the
        normal text; start is where the item would begin without edits before the hit."""
        if not self.items:
            return
        found: dict[int, tuple[int, int, int]] = {}
        tried = set()
        for end, (size, where) in self.automaton.iter(text):
            for number, at in where:
                k, item = self.budget[number], self.items[number][1]
                begin = end + 1 - size - at
                if (number, begin) in tried or found.get(number, (1,))[0] == 0:
                    continue
                tried.add((number, begin))
                if text.startswith(item, begin) and begin >= 0:
                    found[number] = (0, begin, begin + len(item))
                    continue
                if k == 0:
                    continue
                low = max(0, begin - k)
                best = myers(item, self.masks[number], text[low : begin + len(item) + k], k)
                if best and best[0] < found.get(number, (k + 1,))[0]:
                    found[number] = (best[0], max(0, begin), low + best[1])
        for number, (distance, begin, end) in sorted(found.items()):
            yield self.items[number][0], distance, begin, end


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple, errors: float) -> Matcher:
    return Matcher(list(items), errors)


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """The items, in lists of at most about ``most`` bytes (a longer item stands alone)."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.length(text_col) > 0)
    total = rows.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(1, -(-2 * total // most))
    block, size = [], 0
    # the driver holds a part at a time, half a block as the shuffle deals them out
    for i, text in rows.repartition(parts, id_col, text_col).toLocalIterator():
        if block and size + len(text.encode()) > most:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text.encode())
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, errors: float = ERRORS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end) of each document and item of which it holds a passage."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    out = None
    for block in item_blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(block, key=str)))  # ITEM_BYTES

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, errors)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.find(normal(t))]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = source.mapInArrow(tidy(run), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of docs, with their columns, whose text holds no passage of an item."""
    place, schema = docs.columns.index("text"), docs.schema
    for block in item_blocks(items, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(block, key=str)))

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, errors)
            for batch in batches:
                clean = [next(matcher.find(normal(t)), None) is None for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs


