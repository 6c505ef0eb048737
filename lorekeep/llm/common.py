"""What the text operators share: the scratch folder, table writing, packed blocks of documents.

Documents travel in *blocks*: one row holds the texts of some documents, at most
``BLOCK_BYTES`` unless a single text is longer, compressed.  A block is written once, so its
number and the place (``ord``) of a document in it name a row for good, whatever its ``doc_id``
is (null and repeated ids are rows like any other).
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a block (before compression), so that a task holds one block at a time.
BLOCK_BYTES = 8 << 20
#: Most documents of a block, so that block and place fit into one long.
BLOCK_DOCS = 1 << 16
#: Bytes of text for one bucket of hashes; the number of buckets follows the input.
BUCKET_BYTES = 8 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another system's C library
    _LIBC = None

BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("ids", T.BinaryType()),  # int64, zero where null
        T.StructField("nulls", T.BinaryType()),  # uint8, one where the id is null
        T.StructField("sizes", T.BinaryType()),  # int64 bytes of each text
        T.StructField("texts", T.BinaryType()),  # the texts end to end
        T.StructField("extra", T.BinaryType()),  # carried columns, as an Arrow stream
    ]
)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where that is unset, as in tests, one in the
    warehouse, which a cluster shares too."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


class Scratch:
    """Tables of one run of an operator, each in its own folder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", set()
        _FOLDERS.append(self.root)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Writes the rows and reads them back: lineage ends here and lost executors cost nothing."""
        self.names.add(name)
        df.write.option("compression", compression).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables which no later step reads."""
        for name in names:
            self.names.discard(name)
            _delete(self.spark, f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which the result reads."""
        self.drop(*(self.names - set(names)))


#: Folders that this process has made, in order.
_FOLDERS: list[str] = []


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folders_made() -> int:
    return len(_FOLDERS)


def drop_folders(spark: SparkSession, since: int) -> None:
    """Deletes the folders made since then: of operators whose results are written elsewhere by now."""
    for place in _FOLDERS[since:]:
        _delete(spark, place)
    del _FOLDERS[since:]


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidy(run):
    """A function of batches, for ``mapInArrow``, that releases memory at the end of its task."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def tidy_group(run):
    """The same for a function of a table, for ``applyInArrow``."""

    @functools.wraps(run)
    def wrapped(table):
        out = run(table)
        release()
        return out

    return wrapped


def squeeze(data: bytes | memoryview) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Block:
    """The documents of one block; texts are UTF-8 bytes, empty for null."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = expand(row["texts"])

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            yield self.data[a:b]

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=self.nulls, type=pa.int64())


def _pack(partition: int, part: int, ids: list, texts: list[bytes], extra: list[pa.RecordBatch]) -> pa.RecordBatch:
    row = {
        "block": (partition << 20) | part,
        "n_docs": len(ids),
        "n_bytes": sum(map(len, texts)),
        "ids": np.array([x or 0 for x in ids], np.int64).tobytes(),
        "nulls": np.array([x is None for x in ids], np.uint8).tobytes(),
        "sizes": np.array([len(x) for x in texts], np.int64).tobytes(),
        "texts": squeeze(b"".join(texts)),
        "extra": None,
    }
    if extra and extra[0].num_columns:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, extra[0].schema) as out:
            for batch in extra:
                out.write_batch(batch)
        row["extra"] = squeeze(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_pylist([row], SCHEMA)


def extra_columns(data: bytes) -> pa.Table:
    """The carried columns of a block's documents."""
    with pa.ipc.open_stream(expand(data)) as stream:
        return stream.read_all()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Blocks of the documents, in the order in which the tasks read them.  Write them before use.

    carry: all columns but the text go along, for operators that give the rows back.
    """

    def pack(batches):
        from pyspark import TaskContext

        partition, part, ids, texts, size, extra = TaskContext.get().partitionId(), 0, [], [], 0, []
        for batch in batches:
            begin = 0
            rest = batch.select(range(2, batch.num_columns))
            for row, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and (size + len(data) > block_bytes or len(ids) == BLOCK_DOCS):
                    yield _pack(partition, part, ids, texts, [*extra, rest.slice(begin, row - begin)])
                    part, ids, texts, size, extra, begin = part + 1, [], [], 0, [], row
                ids.append(i)
                texts.append(data)
                size += len(data)
            extra.append(rest.slice(begin))
        if ids:
            yield _pack(partition, part, ids, texts, extra)

    others = [F.col(c).alias(f"_{c}") for c in docs.columns if c != text_col] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *others).mapInArrow(tidy(pack), BLOCKS)


SCHEMA = pa.schema(
    [("block", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())] + [(n, pa.binary()) for n in ("ids", "nulls", "sizes", "texts", "extra")]
)


def bucket_count(blocks: DataFrame) -> int:
    """Buckets for hashes of these blocks, in proportion to their text."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


# Hashes ---------------------------------------------------------------------------------------

#: Fixed odd multipliers.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
_SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts with a 64-bit hash of each, by which operators tell words apart.

    texts are joined by a line feed, which ends words.  first[d] is the number of the first word
    of text d, first[-1] the number of all words.  A worker needs some ten bytes for each byte of the texts.
    """

    def __init__(self, texts: list[bytes], lower: bool):
        data = b"\n".join([*texts, b""])
        if lower:
            data = data.lower()  # of bytes: A-Z only
        self.data = data
        buf = np.frombuffer(data, np.uint8)
        self.buf = buf
        self.offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        word = np.zeros(len(buf) + 2, np.int8)
        word[1:-1] = ~_SPACE[buf]
        step = np.diff(word)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash_words()

    def _hash_words(self) -> np.ndarray:
        """Eight bytes a step, each step a bijection of the eight bytes for what came before."""
        size = self.ends - self.starts
        lanes = np.ndarray((len(self.data),), "<u8", self.data + bytes(8), strides=(1,))
        h = size.astype(np.uint64) * _Q
        live = np.flatnonzero(size <= _SHORT)
        for at in range(0, _SHORT, 8):
            live = live[size[live] > at]
            lane = lanes[self.starts[live] + at]
            cut = np.minimum(size[live] - at, 8).astype(np.uint64) * np.uint64(8)
            lane &= np.where(cut == 64, ~np.uint64(0), (np.uint64(1) << (cut & np.uint64(63))) - np.uint64(1))
            h[live] = mix(h[live] * _P + lane)
        for i in np.flatnonzero(size > _SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return mix(h)

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words within a text, and the number of its first word."""
        if len(self) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = window_hash(self.hashes, n)
        doc = self.doc_of_word()
        at = np.flatnonzero(doc[: len(h)] == doc[n - 1 :])
        return h[at], at


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; first[d] is the number of the first value of text d."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    h = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        h = mix(h * _P + words[j : len(words) - n + 1 + j])
    return mix(h + np.uint64(n))


def sequence_hash(words: np.ndarray) -> int:
    """Of a whole short sequence of words."""
    return int(window_hash(words, len(words))[0])


def chunks(texts: Iterator[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in groups of about so many bytes, in order."""
    group, total = [], 0
    for text in texts:
        group.append(text)
        total += len(text) + 1
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
