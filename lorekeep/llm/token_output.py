"""Token ids written to files: frequency-ranked ids, byte-aligned variable-length, control bytes apart.

``encode`` turns texts into ids, ``frequency_ranks`` counts them, ``write_files`` writes files in
ascending document order and ``read_files`` decodes them with numpy table lookups.

A file (all integers little-endian)::

    b"FVB1"  n_docs int64  n_tokens int64  data_bytes int64
    doc_ids int64[n_docs]  null flags uint8[n_docs]  token counts int64[n_docs]
    control uint8[(n_tokens + 3) // 4]   two bits a value: its bytes less one
    data uint8[data_bytes]               the ranks, 1 to 4 bytes each

Ranks are undone with the table of ``frequency_ranks``.  Files hold at most ``FILE_TOKENS`` tokens
unless one document has more, whatever the ranges of ids hold, so a hot id cannot fill a task.

Cases: null and empty texts give the end id only; null ids stand first; rows with equal ids keep
all their copies, ordered by a checksum of their tokens; an empty table gives no file and no row; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Scratch, expand, squeeze, tidy

MAGIC = b"FVB1"
#: Tokens of a file.
FILE_TOKENS = 8 << 20
#: Pieces of text kept with their ids in each of a worker's two generations, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 48

#: White space other than blanks and line feeds, and two or more of these at once.
_ODD = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f", "  ", "\n\n", " \n", "\n "]
_ODD_BEYOND = [*"\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff", *map(chr, range(0x2000, 0x200C))]


def _is_odd(text: str) -> bool:
    """Texts with other white space than single blanks and line feeds within them are encoded in one go."""
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD) or (not text.isascii() and any(x in text for x in _ODD_BEYOND))


#: A piece that the tokenizer's own split parts before its word, if a line feed is there, and after it:
#: a word of letters and the symbols behind it.
_PIECE = re.compile(r"([\n\r]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:#*$%&|<>]*)\Z")
_STATE: dict[str, _Encoder] = {}

#: How byte-level models write bytes: printable ones of Latin-1 stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_BLANK = chr(_LETTER[32])


class _Encoder:
    """A tokenizer with the ids of the pieces that a worker has met lately, in two generations."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        pre = json.loads(self.tok.to_str())["pre_tokenizer"] or {}
        self.splits = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.plain = self.splits and self.tok.normalizer is None
        self.code, self.tokenize = self.kind(0).dtype.char, self.tok.model.tokenize
        self.tails: dict[str, bytes] = {}
        self.young, self.old = _Pieces(self), {}

    def _new(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each by itself."""
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, shown: str) -> bytes:
        """Ids of a word of letters, which the tokenizer's own split leaves whole: the model's alone."""
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 4096:
                self.tails.clear()
            self.tails[tail] = self._new([tail])[0]
        return self.tails[tail]

    def learn(self, piece: str) -> bytes:
        """Ids of a piece that the young generation lacks, and puts it there."""
        ids = self.old.get(piece)
        if ids is None:
            if self.plain and piece.isascii() and piece.isalpha():
                ids = self._word(_BLANK + piece)
            elif self.plain and (m := _PIECE.match(piece)):
                lead, word, tail = m.groups()
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER)
                ids = self._word(shown if lead else _BLANK + shown)
                if lead == "\n":
                    ids = self._tail(lead) + ids
                if tail:
                    ids += self._tail(tail)
            else:
                ids = self._new([piece[1:] if piece[0] == "\r" else piece if piece[0] == "\n" else " " + piece])[0]
        if len(piece) <= CACHE_CHARS:
            self.young[piece] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """A text is parted at its blanks and before its line feeds, where the tokenizer's own split
        has an end too.  A piece stands for itself after a blank, or after nothing with a leading
        carriage return, which a parted text does not hold."""
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, _Pieces(self)
        get = self.young.__getitem__
        out = [None if not t or not self.splits or _is_odd(t) else np.frombuffer(b"".join(map(get, ("\r" + t.replace("\n", " \n")).split(" "))), self.kind) for t in texts]
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._new([texts[i] for i in whole]), strict=True):
            out[i] = np.frombuffer(ids, self.kind)
        return out


class _Pieces(dict):
    """Ids of pieces; the encoder adds those that are looked up in vain."""

    def __init__(self, encoder: _Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        return self.encoder.learn(piece)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""
    if path not in _STATE:
        _STATE[path] = _Encoder(path)
    return _STATE[path](texts)


def encode(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids, counts): ids are packed, two bytes each where that is enough, and
    compressed.  A task's last row is no document: it has nothing but counts, of each token in the task."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(ids), 64):
                found = encode_texts(tokenizer, [t or "" for t in texts.slice(a, 64).to_pylist()])
                if end_id is not None:
                    found = [np.append(x, x.dtype.type(end_id)) for x in found]
                n = np.bincount(np.concatenate(found), minlength=len(total))
                n[: len(total)] += total
                total = n
                crc = [zlib.crc32(x) for x in found]
                yield _encoded(ids.slice(a, 64), [len(x) for x in found], crc, [_squeeze_ids(x) for x in found], [None] * len(found))
        yield _encoded([None], [None], [None], [None], [squeeze(total.tobytes())])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_crc32 long, ids binary, counts binary")


def _encoded(doc_id, n_tokens: list, crc: list, ids: list, counts: list) -> pa.RecordBatch:
    columns = [(doc_id, pa.int64()), (n_tokens, pa.int64()), (crc, pa.int64()), (ids, pa.binary()), (counts, pa.binary())]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns], names=["doc_id", "n_tokens", "ids_crc32", "ids", "counts"])


def _squeeze_ids(ids: np.ndarray) -> bytes:
    return bytes([ids.itemsize]) + _ZSTD.compress(ids.tobytes())


def _expand_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(_UNZSTD.decompress(memoryview(data)[1:]), np.uint16 if data[0] == 2 else np.uint32)


_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def token_counts(encoded: DataFrame) -> DataFrame:
    """(token, n) over the corpus, from the tasks' counts."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = np.frombuffer(expand(data), np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return encoded.select("counts").where("counts IS NOT NULL").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequency_ranks(encoded: DataFrame) -> np.ndarray:
    """rank of each token id up to the largest seen, 0 for the most frequent (ties: the smaller id).

    Ids which never occur come last, so that ranks invert.  The counts have a row for each id of
    the vocabulary at most, which bounds what the driver gets.
    """
    rows = token_counts(encoded).collect()
    if not rows:
        return np.zeros(0, np.uint32)
    n = np.zeros(max(r.token for r in rows) + 1, np.int64)
    for r in rows:
        n[r.token] = r.n
    ranks = np.zeros(len(n), np.uint32)
    ranks[np.lexsort((np.arange(len(n)), -n))] = np.arange(len(n), dtype=np.uint32)
    return ranks


# The byte code --------------------------------------------------------------------------------

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    width = max(1, -(-int(v.max(initial=0)).bit_length() // 8))
    wide = 2 if width <= 2 else 4
    raw = v.astype(f"<u{wide}").view(np.uint8).reshape(len(v), wide)
    taken = np.ones(raw.shape, bool)
    extra = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    for j in range(1, wide):
        taken[:, j] = v >= np.uint32(1 << 8 * j)
        extra[: len(v)] += taken[:, j]
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), raw.ravel()[taken.ravel()].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values; each control byte is looked up in a table of four lengths."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64)
    at -= lengths
    buf = np.frombuffer(data, np.uint8)
    out = buf[at].astype(np.uint32)
    for j in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > j)
        out[more] |= buf[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def file_bytes(doc_ids: list, counts: list[int], values: np.ndarray) -> bytes:
    control, data = pack(values)
    return b"".join(
        [
            MAGIC,
            struct.pack("<qqq", len(doc_ids), len(values), len(data)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<i8").tobytes(),
            control,
            data,
        ]
    )


def parse_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, token counts and values of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    n, tokens, size = struct.unpack_from("<qqq", data, 4)
    at = 28
    ids = np.frombuffer(data, "<i8", n, at)
    nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(data, "<i8", n, at + 9 * n)
    at += 17 * n
    quads = -(-tokens // 4)
    values = unpack(data[at : at + quads], data[at + quads : at + quads + size], tokens)
    return [None if x else int(i) for i, x in zip(ids, nulls, strict=True)], counts, values


def _save(uri: str, data: bytes) -> None:
    """Writes under a name of this attempt, then renames, so that a repeated task leaves one file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, path)


def write_files(encoded: DataFrame, ranks: np.ndarray, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files in ascending doc_id order; (part, piece, n_docs, n_tokens) for each."""
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // file_tokens))
    table = encoded.sparkSession.sparkContext.broadcast(ranks)  # 4 bytes for each id of the vocabulary

    def run(batches):
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        ids, found, size = [], [], 0

        def flush():
            values = np.concatenate(found) if found else np.zeros(0, np.uint32)
            _save(f"{folder}/part-{part:08d}-{piece:06d}.fvb", file_bytes(ids, [len(x) for x in found], values))
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [piece], "n_docs": [len(ids)], "n_tokens": [len(values)]})

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _expand_ids(x)
                if ids and size + len(x) > file_tokens:
                    yield flush()
                    ids, found, size, piece = [], [], 0, piece + 1
                ids.append(i)
                found.append(table.value[x])
                size += len(x)
        if ids:
            yield flush()

    order = F.col("doc_id").asc_nulls_first(), F.col("ids_crc32")
    dealt = encoded.where("counts IS NULL").select("doc_id", "ids", "ids_crc32").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(tidy(run), "part long, piece long, n_docs long, n_tokens long")


def read_files(spark: SparkSession, folder: str, index: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): decoded from the files.

    start counts the ids of all documents before this one; the running sum over files reads one
    row of the index for each file.
    """
    tokens = np.zeros(len(ranks), np.uint32)
    tokens[ranks] = np.arange(len(ranks), dtype=np.uint32)
    table = spark.sparkContext.broadcast(tokens)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer().to_pybytes()
                doc_ids, counts, values = parse_file(raw)
                ids = table.value[values].astype("<u4")
                ends = np.cumsum(counts)
                part, piece = map(int, re.search(r"part-(\d+)-(\d+)\.fvb$", path).groups())
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in ([part] * len(crc), [piece] * len(crc), doc_ids, ends - counts, counts, crc)],
                    names=["part", "piece", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fvb").load(folder)
    found = files.select("path", "content").mapInArrow(tidy(run), "part long, piece long, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    base = index.select("part", "piece", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return found.join(base, ["part", "piece"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Encodes, ranks, writes and reads back.  One row per document."""
    spark = docs.sparkSession
    work = Scratch(spark, "token_output")
    encoded = work.write(encode(docs, tokenizer, end_id), "encoded", compression="none")  # the ids are compressed
    ranks = frequency_ranks(encoded)
    folder = f"{work.root}/files"
    _mkdir(spark, folder)
    index = work.write(write_files(encoded, ranks, folder), "index")
    work.drop("encoded")
    return read_files(spark, folder, index, ranks)


def _mkdir(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
