"""Removal of byte strings that an earlier document holds, by sorting suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id.  All is judged on the input; strings never cross documents.

1. Documents are packed into blocks.  In each window of ``length`` bytes the least hash of its
   ``k``-byte strings marks the *anchor*: equal windows have equal anchors.  A block sends the
   distinct hashes of its anchors to buckets, which answer with one bit each: seen in another
   document or not.  Windows round an anchor that no other document has repeat nowhere.
2. For each other anchor the block takes the bytes that its windows span (the context).  Of equal
   contexts in a block only the smallest document's goes on; the others are cut at once.  So the
   contexts of a hot passage are one a block, however many documents repeat it.
3. A bucket gets all contexts of its anchors.  Equal contexts are settled by their smallest id.  The
   windows of anchors with several contexts are suffixes of the bucket's buffer; they are ordered by
   deep-shallow sorting: multikey quicksort, eight bytes a step, to ``SHALLOW`` bytes, and a blind
   trie for each group that still agrees there.  Windows that end in one leaf are equal; all but
   those of the smallest document are cut.  Anchors with more than ``HOT_CONTEXTS`` contexts do not
   come together: each block sends their distinct windows, with the smallest id it has, to buckets
   by a hash of the whole window, so that only equal windows meet, one a block or portion of it.
4. The cuts go back to their blocks, which join them into spans.

The texts go to their flags once and are written with them; steps 2 and 3 then take the buckets in ``TURNS``
turns, each written before the next begins, so that the disk holds the contexts of one turn at a time.

Hashes only choose candidates; what is cut has been compared byte by byte.

Cases: null and empty texts have no bytes; a null id counts as larger than all others; rows with
equal ids never cut each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BLOCK_BYTES, Block, Scratch, bucket_count, chunks, expand, extra_columns, mix, pack_documents, squeeze, tidy, tidy_group

#: Bytes to which multikey quicksort orders suffixes before blind tries take over.
SHALLOW = 24
#: The most contexts of an anchor that are compared in one group (at most 254: counts travel as a byte).
HOT_CONTEXTS = 200
#: Windows, or bytes of contexts, that are sorted at once, and buckets for windows of hot anchors by one of the others.
PORTION, WINDOW_BUCKETS = 1 << 18, 4
#: Turns in which the buckets are compared: all contexts together are several times the texts.
TURNS = 3
_NONE = np.uint64(2**64 - 1)
_LOW = np.uint64(0xFFFFFFFF)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def anchor_size(length: int) -> int:
    """Bytes of an anchor: 16, or less where windows are short."""
    if length < 16:
        raise ValueError("length is 16 bytes at least")
    return 16 if length >= 32 else 8


def anchors(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand end to end: hash and place of each anchor, and its first and last window.

    The windows of an anchor are consecutive; each window of each text belongs to one anchor.
    """
    n, k = len(data), anchor_size(length)
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    h = words[: n - k + 1] * _A
    h += words[k - 8 : n - 7] * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    bits = np.uint64(32)  # the same for all texts: equal windows choose alike
    low = (h >> np.uint64(1)) >> bits << bits  # ties in a window: the first place
    low |= np.arange(len(h), dtype=np.uint64)
    wide, size = length - k + 1, 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    for end in ends[ends < n].tolist():  # windows that would cross into the next text
        low[max(0, end - length + 1) : end] = _NONE
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.concatenate([change[1:], [len(low)]]) - 1
    real = low[change] != _NONE
    change, last = change[real], last[real]
    at = (low[change] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return h[at], at, change, last


def block_anchors(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """Of a whole block: hash, place, first and last window, number of the document."""
    found, doc, base = [], 0, 0
    for group in chunks(block.texts()):
        ends = np.cumsum([len(t) for t in group])
        data = b"".join(group)
        h, at, first, last = anchors(data, ends, length)
        found.append((h, at + base, first + base, last + base, doc + np.searchsorted(ends, first, side="right")))
        doc, base = doc + len(group), base + len(data)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)


def hash_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket in the upper and 32 bits of the hash in the lower half."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & _LOW)


def split_buckets(keys: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of sorted keys by bucket."""
    if not len(keys):
        return []
    high = (keys >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
    return [(int(high[a]), slice(a, b)) for a, b in zip(cut, [*cut[1:], len(high)], strict=True)]


def repeated_flags(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """(block, flags): two bits for each distinct anchor of the block, in the order of its key: other
    documents hold it, and it is hot.  All the first bits of a bucket stand before the second ones."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                h, place, first, last, doc = block_anchors(block, length)
                keys = hash_keys(h, buckets)
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], doc[order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                # documents stand in order within equal keys: several if the last is not the first
                ends = np.concatenate([at[1:], [len(keys)]]) - 1 if len(at) else at
                several = doc[at] != doc[ends]
                size = ends - at + 1
                group = np.repeat(np.arange(len(at)), size)
                more = np.flatnonzero(size[group] > 1)
                group, of = group[more], order[more]
                a, b, off = first[of].tolist(), (last[of] + length).tolist(), (place[of] - first[of]).tolist()
                kind = np.array([hash((o, block.data[x:y])) for o, x, y in zip(off, a, b, strict=True)], np.int64)
                by = np.lexsort((kind, group))
                group, kind = group[by], kind[by]
                fresh = np.ones(len(by), bool)
                fresh[1:] = (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])
                contexts = np.clip(np.bincount(group[fresh], minlength=len(at)), 1, HOT_CONTEXTS + 1).astype(np.uint8)
                keys = keys[at]
                parts = split_buckets(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in parts], pa.int64()),
                        pa.array([block.block] * len(parts), pa.int64()),
                        pa.array([(keys[s] & _LOW).astype(np.uint32).tobytes() for _, s in parts], pa.binary()),
                        pa.array([np.packbits(several[s]).tobytes() for _, s in parts], pa.binary()),
                        pa.array([contexts[s].tobytes() for _, s in parts], pa.binary()),
                    ],
                    names=["bucket", "block", "hashes", "several", "contexts"],
                )

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(table["several"].to_pylist(), hashes, strict=True)]).astype(bool)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        s = every[order]
        same = s[1:] == s[:-1]
        hit = several.copy()
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        contexts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["contexts"].to_pylist()]).astype(np.int64)
        many = np.add.reduceat(contexts[order], heads) > HOT_CONTEXTS
        hot = np.zeros(len(s), bool)
        hot[order] = np.repeat(many, np.diff(np.concatenate([heads, [len(s)]])))
        cut = np.cumsum([len(h) for h in hashes])[:-1]
        both = zip(np.split(hit, cut), np.split(hit & hot, cut), strict=True)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": pa.array([np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in both], pa.binary()), "n": pa.array([len(h) for h in hashes], pa.int64())})

    sent = blocks.mapInArrow(tidy(send), "bucket long, block long, hashes binary, several binary, contexts binary")
    flags = sent.groupBy("bucket").applyInArrow(tidy_group(answer), "block long, bucket long, flags binary, n long")
    return flags.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "flags"))).alias("flags"))


# Deep-shallow sorting -------------------------------------------------------------------------


def multikey_sort(data: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and where groups that agree begin.

    Multikey quicksort with eight bytes as a character: suffixes with equal characters go on to the
    next one, the others are in place.  data must reach ``depth`` bytes beyond each start.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    order = np.arange(len(starts))
    head = np.zeros(len(starts), bool)  # true where a group begins
    if len(head):
        head[0] = True
    for at in range(0, depth, 8):
        group = np.cumsum(head)
        size = np.bincount(group, minlength=1)
        todo = np.flatnonzero(size[group] > 1)
        if not len(todo):
            break
        w = words[starts[order[todo]] + at].astype(np.uint64)
        if depth - at < 8:
            w >>= np.uint64(8 * (8 - (depth - at)))
        g = group[todo]
        by = np.lexsort((w, g))
        order[todo] = order[todo][by]
        w, g = w[by], g[by]
        split = np.concatenate([[False], (w[1:] != w[:-1]) & (g[1:] == g[:-1])])
        head[todo[split]] = True
    return order, np.flatnonzero(head)


def blind_trie_groups(strings: list[bytes]) -> list[list[int]]:
    """Numbers of the equal strings, the groups in ascending order of their strings.

    A node keeps only a depth and its branching bytes; the string of the leaf that a blind descent
    reaches gives the true common prefix, at which a new leaf is put in.  All strings have one length.
    """
    root = (strings[0], [0])  # leaf: (string, numbers); node: [depth, {byte: child}]
    for number in range(1, len(strings)):
        s = strings[number]
        node = root
        while type(node) is list:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == s:
            node[1].append(number)
            continue
        common = _common(other, s)
        up, node = None, root
        while type(node) is list and node[0] < common:
            up, node = node, node[1][s[node[0]]]
        leaf = (s, [number])
        if type(node) is list and node[0] == common:
            node[1][s[common]] = leaf
            continue
        new = [common, {other[common]: node, s[common]: leaf}]
        if up is None:
            root = new
        else:
            up[1][s[up[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            out.append(node[1])
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def _common(a: bytes, b: bytes) -> int:
    n = len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (x.bit_length() + 7) // 8


def equal_suffixes(data: bytes, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow order of the suffixes by ``length`` bytes, and the beginnings of equal ones."""
    padded = data + bytes(length + 8)
    order, heads = multikey_sort(padded, starts, min(shallow, length))
    if length <= shallow:
        return order, heads
    ends = np.concatenate([heads[1:], [len(order)]])
    single = ends - heads == 1
    out_heads = []
    at_order = order.tolist()
    from_ = starts.tolist()
    for a, b, one in zip(heads.tolist(), ends.tolist(), single.tolist(), strict=True):
        if one:
            out_heads.append(a)
            continue
        members = at_order[a:b]
        groups = blind_trie_groups([padded[from_[m] + shallow : from_[m] + length] for m in members])
        at = a
        for g in groups:
            out_heads.append(at)
            for x in g:
                at_order[at] = members[x]
                at += 1
    return np.array(at_order, np.int64), np.array(out_heads, np.int64)


# Contexts -------------------------------------------------------------------------------------

_BIG = np.iinfo(np.int64).max


def _cut_in_block(data: bytes, off: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an equal context of a smaller document stands in the block; contexts are told apart by a
    hash first and then byte by byte."""
    kind = np.fromiter((hash((o, data[x:y])) for o, x, y in zip(off.tolist(), a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
    order = np.lexsort((ids, kind))
    new = np.ones(len(order), bool)
    new[1:] = kind[order[1:]] != kind[order[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    cut = np.zeros(len(order), bool)
    more = ids[order] > ids[head]
    for i, h in zip(order[more].tolist(), head[more].tolist(), strict=True):
        cut[i] = off[i] == off[h] and data[a[i] : b[i]] == data[a[h] : b[h]]
    return cut


def _contexts(blocks: DataFrame, flags: DataFrame | None, length: int, buckets: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(bucket, block, contexts, cuts, windows) of a turn's buckets: contexts and windows to compare and what a
    block cuts by itself.  Equal windows have equal anchors and so one bucket and turn.  flags is None where the
    blocks hold them."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                h, place, first, last, doc = block_anchors(block, length)
                keys = hash_keys(h, buckets)
                own = np.flatnonzero((keys >> np.uint64(32)) % np.uint64(turns) == np.uint64(turn))
                keys, place, first, last, doc = (x[own] for x in (keys, place, first, last, doc))
                _, inverse = np.unique(keys, return_inverse=True)
                parts = [np.unpackbits(np.frombuffer(f["flags"], np.uint8).reshape(2, -1), axis=1, count=f["n"]) for f in row["flags"] or [] if f["bucket"] % turns == turn]
                bits, hot = np.concatenate(parts, axis=1).astype(bool) if parts else np.zeros((2, 0), bool)
                hit = np.flatnonzero(bits[inverse]) if len(own) else np.zeros(0, np.int64)
                hot = hot[inverse[hit]]
                bucket = (keys[hit] >> np.uint64(32)).astype(np.int64)
                off = place[hit] - first[hit]
                ids = np.where(block.nulls, _BIG, block.ids)[doc[hit]]
                data = block.data
                a, b = first[hit], last[hit] + length
                cut = _cut_in_block(data, off, a, b, ids)
                send_on = np.flatnonzero(~cut & ~hot)
                order = send_on[np.argsort(bucket[send_on], kind="stable")]
                rows = []
                for bk, s in split_buckets(bucket[order].astype(np.uint64) << np.uint64(32)):
                    at = order[s]
                    rows.append((bk, _pack_contexts(a[at], off[at], ids[at], [data[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]), None, None))
                if cut.any():
                    rows.append((block.block % buckets, None, np.stack([first[hit][cut], last[hit][cut]]).astype(np.int64).tobytes(), None))
                of = np.flatnonzero(~cut & hot)
                for w, packed, gone in _hot_windows(data, first[hit][of], last[hit][of], ids[of], length, WINDOW_BUCKETS * buckets):
                    rows.append((block.block % buckets, None, gone, None) if packed is None else (buckets + w, None, None, packed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([block.block] * len(rows), pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]],
                    names=["bucket", "block", "contexts", "cuts", "windows"],
                )

    flagged = blocks if flags is None else blocks.join(flags, "block", "left")
    return flagged.mapInArrow(tidy(send), "bucket long, block long, contexts binary, cuts binary, windows binary")


def _equal_windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and where those of equal words begin."""
    order = np.lexsort(words.T)
    s = words[order]
    return order, np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)]))


def _window_words(windows: np.ndarray) -> np.ndarray:
    """Windows, a row of bytes each, as 64-bit words filled up with zeros."""
    n, length = windows.shape
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = windows
    return padded.view("<u8")


def _joined(starts: np.ndarray) -> bytes:
    """Cut windows as runs, the first and the last of each."""
    s = np.sort(starts)
    new = s[1:] != s[:-1] + 1
    return np.stack([s[np.concatenate([[True], new])], s[np.concatenate([new, [True]])]]).astype(np.int64).tobytes()


def _hot_windows(data: bytes, first: np.ndarray, last: np.ndarray, ids: np.ndarray, length: int, buckets: int):
    """(bucket, packed windows, None) to compare and (0, None, cuts) of a block's contexts of hot anchors.

    A portion of them sends each distinct window once, with its smallest id and where it stands there.
    """
    total = np.cumsum(last - first + 1)
    buf = np.frombuffer(data, np.uint8)
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(total // PORTION)) + 1):
        if not len(part):
            continue
        n = (last - first + 1)[part]
        starts = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        windows = np.lib.stride_tricks.sliding_window_view(buf, length)[starts]
        words = _window_words(windows)
        order, heads = _equal_windows(words)
        key = np.repeat(ids[part], n)[order]
        low = np.minimum.reduceat(key, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(order)]])))
        cut = key > low[group]
        if cut.any():
            yield 0, None, _joined(starts[order[cut]])
        h = np.zeros(len(heads), np.uint64)
        for w in words[order[heads]].T:
            h = mix(h * _A + w)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        stay = np.flatnonzero(~cut)
        stay = stay[np.argsort(rank[group[stay]], kind="stable")]
        places, counts = starts[order[stay]].astype(np.int64), np.bincount(group[stay], minlength=len(heads))[turn].astype(np.int32)
        ends = np.cumsum(counts)
        for b, s in split_buckets(bucket[turn].astype(np.uint64) << np.uint64(32)):
            of = turn[s]
            own = places[ends[s.start] - counts[s.start] : ends[s.stop - 1]]
            head = np.array([len(of)], np.int64).tobytes()
            yield b, squeeze(head + low[of].astype(np.int64).tobytes() + counts[s].tobytes() + windows[order[heads[of]]].tobytes() + own.tobytes()), None


def _unpack_windows(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest id and number of places of each window, its bytes, and all places."""
    data = expand(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, counts = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int32, n, 8 + 8 * n)
    windows = np.frombuffer(data, np.uint8, n * length, 8 + 12 * n).reshape(n, length)
    return ids, counts, windows, np.frombuffer(data[8 + (12 + length) * n :], np.int64)


def _settle_windows(rows: list[tuple[int, bytes]], length: int) -> list[tuple[int, bytes]]:
    """(block, cuts) of windows which a smaller id holds too."""
    found = [(b, *_unpack_windows(w, length)) for b, w in rows]
    ids = np.concatenate([f[1] for f in found])
    order, heads = _equal_windows(_window_words(np.concatenate([f[3] for f in found])))
    low = np.minimum.reduceat(ids[order], heads)
    cut = np.zeros(len(ids), bool)
    cut[order] = ids[order] > np.repeat(low, np.diff(np.concatenate([heads, [len(order)]])))
    out, at = [], 0
    for block, own, counts, _, places in found:
        gone = places[np.repeat(cut[at : at + len(own)], counts)]
        at += len(own)
        if len(gone):
            out.append((block, _joined(gone)))
    return out


def _pack_contexts(first: np.ndarray, off: np.ndarray, ids: np.ndarray, context: list[bytes]) -> bytes:
    sizes = np.array([len(c) for c in context], np.int32)
    head = np.array([len(context)], np.int64).tobytes()
    return squeeze(head + first.astype(np.int64).tobytes() + ids.astype(np.int64).tobytes() + off.astype(np.int32).tobytes() + sizes.tobytes() + b"".join(context))


def _unpack_contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    data = expand(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    first, ids = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    off, sizes = np.frombuffer(data, np.int32, n, 8 + 16 * n), np.frombuffer(data, np.int32, n, 8 + 20 * n)
    ends = np.cumsum(sizes, dtype=np.int64) + 8 + 24 * n
    return first, ids, off, [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _portions(groups: list[list[int]], sizes: list[int]) -> Iterator[list[int]]:
    """The members of some groups together, of about ``PORTION`` bytes."""
    part, total = [], 0
    for g in groups:
        part += g
        total += sum(sizes[i] for i in g)
        if total >= PORTION:
            yield part
            part, total = [], 0
    if part:
        yield part


def settle(ids: np.ndarray, off: np.ndarray, context: list[bytes], anchor: int, length: int) -> list[np.ndarray | None]:
    """Cut windows of each context: a flag a window, or None for all of them."""
    number: dict[tuple[int, bytes], int] = {}
    of = np.array([number.setdefault(k, len(number)) for k in zip(off.tolist(), context, strict=True)], np.int64)
    least = np.full(len(number), _BIG, np.int64)
    np.minimum.at(least, of, ids)
    kinds = list(number)
    groups: dict[bytes, list[int]] = {}
    for i, (o, c) in enumerate(kinds):
        groups.setdefault(c[o : o + anchor], []).append(i)
    flags: dict[int, np.ndarray] = {}
    for mixed in _portions([g for g in groups.values() if len(g) > 1], [len(c) for _, c in kinds]):
        data = b"".join(kinds[i][1] for i in mixed)
        sizes = np.array([len(kinds[i][1]) for i in mixed], np.int64)
        counts = sizes - length + 1
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(mixed)), counts)
        local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        order, heads = equal_suffixes(data, begin[owner] + local, length)
        key = least[np.array(mixed, np.int64)][owner]
        low = np.minimum.reduceat(key[order], heads)
        cut = np.zeros(len(order), bool)
        cut[order] = key[order] > np.repeat(low, np.diff(np.concatenate([heads, [len(order)]])))
        for i, part in zip(mixed, np.split(cut, np.cumsum(counts)[:-1]), strict=True):
            if part.any():
                flags[i] = part
    none = np.zeros(0, bool)
    return [None if i > least[k] else flags.get(k, none) for i, k in zip(ids.tolist(), of.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _compare(length: int):
    anchor = anchor_size(length)

    def run(table: pa.Table) -> pa.Table:
        out = [(b, c) for b, c in zip(table["block"].to_pylist(), table["cuts"].to_pylist(), strict=True) if c is not None]
        rows = [(b, *_unpack_contexts(c)) for b, c in zip(table["block"].to_pylist(), table["contexts"].to_pylist(), strict=True) if c is not None]
        if rows:
            ids, off = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
            verdicts = settle(ids, off, [c for r in rows for c in r[4]], anchor, length)
            at = 0
            for block, first, _, _, context in rows:
                a, b = [], []
                for begin, c, v in zip(first.tolist(), context, verdicts[at : at + len(context)], strict=True):
                    if v is None:
                        a.append(begin)
                        b.append(begin + len(c) - length)
                    elif len(v):
                        x, y = _runs(v)
                        a += (begin + x).tolist()
                        b += (begin + y).tolist()
                at += len(context)
                if a:
                    out.append((block, np.array([a, b], np.int64).tobytes()))
        windows = [(b, w) for b, w in zip(table["block"].to_pylist(), table["windows"].to_pylist(), strict=True) if w is not None]
        if windows:
            out += _settle_windows(windows, length)
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "cuts": pa.array([x[1] for x in out], pa.binary())})

    return run


def spans(cuts: list[bytes], length: int) -> np.ndarray:
    """Maximal removed runs [from, to) of a block's bytes, in order."""
    if not cuts:
        return np.zeros((0, 2), np.int64)
    both = np.concatenate([np.frombuffer(c, np.int64).reshape(2, -1) for c in cuts], axis=1)
    order = np.argsort(both[0], kind="stable")
    a, b = both[0][order], np.maximum.accumulate(both[1][order] + length)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    at = np.flatnonzero(new)
    return np.stack([a[at], b[np.concatenate([at[1:], [len(a)]]) - 1]], axis=1)


def _cuts(blocks: DataFrame, work: Scratch, length: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, written anew with their flags, and (block, cuts) of those with something to remove.  blocks are
    the table "blocks" of work, which goes."""
    buckets = 2 * bucket_count(blocks)  # contexts take several times their bytes in a task
    flags = work.write(repeated_flags(blocks.drop("extra"), length, buckets), "flags")
    flagged = work.write(blocks.join(flags, "block", "left"), "flagged")
    work.drop("blocks", "flags")
    turns = min(TURNS, buckets)
    for turn in range(turns):
        compared = _contexts(flagged.drop("extra"), None, length, buckets, turn, turns).groupBy("bucket").applyInArrow(tidy_group(_compare(length)), "block long, cuts binary")
        part = work.write(compared, f"cuts{turn}")
        cuts = part if turn == 0 else cuts.unionByName(part)
    return flagged.drop("flags"), cuts.groupBy("block").agg(F.collect_list("cuts").alias("cuts"))


def _parted(block: Block, cuts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Removed runs of each document, in bytes of the block."""
    cut = spans(cuts, length)
    rows: list[list[tuple[int, int]]] = [[] for _ in range(len(block))]
    for d, (a, b) in zip(np.searchsorted(block.ends, cut[:, 0], side="right").tolist(), cut.tolist(), strict=True):
        while b > block.ends[d]:  # it touches the next text's
            rows[d].append((a, int(block.ends[d])))
            a, d = int(block.ends[d]), d + 1
            while block.sizes[d] == 0:
                d += 1
        rows[d].append((a, b))
    return rows


def _kept(block: Block, rows: list[list[tuple[int, int]]]) -> list[bytes]:
    out = []
    for at, end, parts in zip(block.starts.tolist(), block.ends.tolist(), rows, strict=True):
        left = []
        for a, b in parts:
            left.append(block.data[at:a])
            at = b
        out.append(b"".join([*left, block.data[at:end]]))
    return out


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): spans are array<struct<from, to>> in bytes of the
    text, kept is what is left of it (binary, for a cut can fall within a character)."""
    work = Scratch(docs.sparkSession, "suffix_dedup")
    blocks = work.write(pack_documents(docs, id_col, text_col, block_bytes), "blocks")
    blocks, cuts = _cuts(blocks, work, length)

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                rows = _parted(block, row["cuts"] or [], length)
                kept = _kept(block, rows)
                removed = [sum(b - a for a, b in parts) for parts in rows]
                own = [[{"from": a - s, "to": b - s} for a, b in parts] for s, parts in zip(block.starts.tolist(), rows, strict=True)]
                for i in range(0, len(kept), 256):
                    yield pa.RecordBatch.from_arrays(
                        [block.doc_ids()[i : i + 256], pa.array(block.sizes[i : i + 256], pa.int64()), pa.array(removed[i : i + 256], pa.int64()), pa.array(own[i : i + 256], SPANS), pa.array(kept[i : i + 256], pa.binary())],
                        names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                    )

    return blocks.drop("extra").join(cuts, "block", "left").mapInArrow(tidy(finish), "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary")


def cut_documents(docs: DataFrame, length: int = 50, size_col: str = "n_chars") -> DataFrame:
    """The rows of docs with what is left of their texts; ``size_col``, if there is one, counts its
    characters anew.  A character which a cut parts goes; a document of which nothing but white
    space is left goes too."""
    work = Scratch(docs.sparkSession, "suffix_dedup")
    blocks = work.write(pack_documents(docs, carry=True), "blocks")
    blocks, cuts = _cuts(blocks, work, length)
    columns = docs.columns

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                rows = _parted(block, row["cuts"] or [], length)
                texts = [k.decode("utf-8", "ignore") for k in _kept(block, rows)]
                extra = extra_columns(row["extra"])
                keep = pa.array([not parts or bool(t.strip()) for parts, t in zip(rows, texts, strict=True)])
                out = []
                for c in columns:
                    if c == "text":
                        out.append(pa.array(texts, pa.string()))
                    elif c == size_col:
                        kind = extra.schema.field(f"_{c}").type
                        old = extra[f"_{c}"].to_pylist()
                        out.append(pa.array([len(t) if parts else n for parts, t, n in zip(rows, texts, old, strict=True)], kind))
                    else:
                        out.append(extra[f"_{c}"].combine_chunks())
                table = pa.table(out, names=columns).filter(keep)
                yield from table.to_batches(max_chunksize=512)

    return blocks.join(cuts, "block", "left").mapInArrow(tidy(finish), docs.schema)


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def digest(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

