"""Quality rules: counted rules on words and lines, then calibrated classifiers.

``rule_counts`` counts what the rules need.  ``fit_quality_model`` trains logistic regressions on
hashed word n-grams (1 and 2) and character n-grams (``CHAR_N`` bytes) of labelled rows, one for
quality and one for toxicity, and calibrates each one's scores to probabilities on rows that its
training has not seen (Platt's method).  ``score`` applies them in Arrow batches against fixed
thresholds.  An n-gram counts once a text, and only n-grams of ``LEAST_DOCS`` training texts whose
share differs between the two classes by ``LEAST_Z`` standard errors count: the bulk of a text's
n-grams, which tell nothing of the class, would hide the few that do.

Training takes at most ``TRAIN_ROWS`` labelled documents and ``TRAIN_BYTES`` of their texts, those
with the least hash of their id, and none longer than ``TRAIN_TEXT_BYTES``: more labels or longer
texts do not change what a task holds.  Features of the sample are made where the documents are;
only they, one row a document, come together in the training task.

Cases: null and empty texts have no words and fail the rules; a label row with a null counts as
none; several labels of one document count as their worst, and of several texts of one id the one
with the least features is learnt from; without labelled rows, or with one class only, a classifier
keeps what passes the rules; repeated rows are judged alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Words, chunks, expand, mix, squeeze, sums_by_text, tidy, tidy_group

#: Slots of the hashed features.
SLOTS = 1 << 20
#: Bytes of a character n-gram.
CHAR_N = 5
#: The most labelled documents that training takes.
TRAIN_ROWS = 16_000
#: The most bytes of one text that training takes, and of all of them.
TRAIN_TEXT_BYTES, TRAIN_BYTES = 1 << 20, 256 << 20
#: The sum of n weights is divided by n to this power: few bad words shall count in a long text.
POWER = 0.25
#: Training texts that hold an n-gram which counts.
LEAST_DOCS = 5
#: Standard errors between the classes' shares of texts with an n-gram that counts.  With few rows even a
#: perfect sign cannot reach it (its greatest value is the root of their number): half of that will do.
LEAST_Z = 5.0
#: What the classifiers tell, by the columns of ``good_labels``.
HEADS = ("fine", "clean")
#: A document goes if its calibrated probability of being fine, or of being clean, is below these:
#: under a half, since a good document lost weighs more than a poor one kept.
LEAST_PROBABILITY = (0.25, 0.3)
#: Rules: fewest words, and the most words of a hundred that stand in repeated 5-word windows.
LEAST_WORDS, MOST_REPEATED = 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_WORD_CHAR = _WORD & ((np.arange(256) & 0xC0) != 0x80)


def rule_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(texts, lower=False)
    n_words = np.diff(words.first)
    dup = []
    for t in texts:
        seen, n = set(), 0
        for line in t.split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip():
                seen.add(line)
        dup.append(n)
    hashes, at = words.windows(5)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        key = mix(hashes + words.doc_of_word()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 5, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": sums_by_text(_WORD_CHAR[words.buf], words.offsets),
        "n_symbols": sums_by_text(_SYMBOL[words.buf], words.offsets),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": sums_by_text(repeated, words.first),
    }


def _distinct(slots: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text, in order, and the first one of each text."""
    bits = SLOTS.bit_length() - 1
    key = np.sort(doc.astype(np.int64) << bits | slots.astype(np.int64))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & (SLOTS - 1)).astype(np.int32), np.searchsorted(key >> bits, np.arange(n_docs + 1))


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words (1 and 2), then characters: distinct slots of each text's n-grams, and the first one of each text."""
    words = Words(texts, lower=True)
    pairs, at = words.windows(2)
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    doc = words.doc_of_word()
    of_words = _distinct(np.concatenate([words.hashes, pairs]) >> shift, np.concatenate([doc, doc[at]]), len(texts))
    n = len(words.buf)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets))  # with the line feed after the text
    left = np.minimum(words.offsets[doc + 1] - np.arange(n), CHAR_N).astype(np.uint64)  # no byte of the next text
    grams = np.ndarray((n,), "<u8", words.data + bytes(8), strides=(1,)) & ((np.uint64(1) << left * np.uint64(8)) - np.uint64(1))
    return [of_words, _distinct((grams * np.uint64(0x9E3779B97F4A7C15)) >> shift, doc, len(texts))]


def linear_scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each head, the sum of weights of each kind's n-grams over a power of their number."""
    total = np.zeros((len(weights), len(texts)))
    for slots, first in features(texts):
        scale = np.maximum(np.diff(first), 1) ** POWER
        for z, w in zip(total, weights, strict=True):
            z += sums_by_text(w[slots].astype(np.float64), first) / scale
    return total


def _sparse(text: bytes) -> bytes:
    """Distinct slots of a text, packed: how many are of words, then each one's distance to the one before."""
    slots = [s for s, _ in features([text])]
    return squeeze(np.concatenate([[len(slots[0])], *[np.diff(s, prepend=0) for s in slots]]).astype(np.int32).tobytes())


def unpack_row(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a text, and for words and characters the number of slots and the value of each."""
    raw = np.frombuffer(expand(packed), np.int32)
    cut = 1 + raw[0]
    size = np.array([raw[0], len(raw) - cut])
    return np.concatenate([np.cumsum(raw[1:cut]), np.cumsum(raw[cut:])]).astype(np.int32), size, np.maximum(size, 1) ** -POWER


def common_slots(packed: Sequence[bytes]) -> np.ndarray:
    """Slots that ``LEAST_DOCS`` of the rows hold."""
    seen = np.zeros(SLOTS, np.int32)
    for p in packed:
        seen[np.unique(unpack_row(p)[0])] += 1
    return seen >= LEAST_DOCS


def telling(packed: Sequence[bytes], good: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """For each row of good, the slots whose share of its good rows and of its others differs by ``LEAST_Z``
    standard errors; of the rows that own numbers."""
    held = np.zeros((len(good), 2, SLOTS), np.int32)
    for i in own.tolist():
        slots = np.unique(unpack_row(packed[i])[0])
        for h, y in zip(held, good, strict=True):
            h[int(y[i])][slots] += 1
    found = []
    for (h0, h1), y in zip(held, good[:, own], strict=True):
        n1, n0 = y.sum(), len(y) - y.sum()
        if not n1 or not n0:
            found.append(np.ones(SLOTS, bool))
            continue
        share = (h0 + h1) / len(y)
        error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        found.append((error > 0) & (np.abs(h1 / n1 - h0 / n0) >= min(LEAST_Z, len(y) ** 0.5 / 2) * error))
    return found


def with_slots(rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows without slots that are not chosen."""
    found = []
    for slots, size, value in rows:
        stay = chosen[slots]
        n = np.count_nonzero(stay[: size[0]])
        slots = slots[stay]
        found.append((slots, np.array([n, len(slots) - n]), value))
    return found


def fit_heads(packed: Sequence[bytes], good: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The numbers of each head, learnt from the n-grams that tell its classes apart.

    Rows are unpacked one at a time in each pass, so that only the slots that a head learns from are in memory
    together.
    """
    often, heads = common_slots(packed), []
    for y, tells in zip(good, telling(packed, good, np.flatnonzero(~fold)), strict=True):
        heads.append(train(with_slots(map(unpack_row, packed), often & tells), y[None], fold))
    return np.concatenate(heads)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], good: np.ndarray, fold: np.ndarray, rate: float = 0.5, batch: int = 128) -> np.ndarray:
    """For each row of good, a head: weights, bias and the two calibration numbers.

    fold marks the rows kept for calibration.  Few rows are passed over more often than many.
    """
    w, b = np.zeros((len(good), SLOTS), np.float32), np.zeros(len(good))
    seen, seen_b = np.full(w.shape, 1e-2, np.float32), np.full(len(good), 1e-2)
    own = np.flatnonzero(~fold)
    turn = np.random.default_rng(7)
    for _ in range(min(100, max(8, 80_000 // max(len(own), 1)))):
        own = turn.permutation(own)
        for at in range(0, len(own), batch):
            part = own[at : at + batch]
            slots = np.concatenate([rows[i][0] for i in part])
            values = np.repeat(np.concatenate([rows[i][2] for i in part]), np.concatenate([rows[i][1] for i in part]))
            size = np.array([len(rows[i][0]) for i in part])
            first = np.concatenate([[0], np.cumsum(size)])
            for h, y in enumerate(good):
                z = sums_by_text(w[h][slots] * values, first) + b[h]
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
                g = (np.bincount(slots, np.repeat(error, size) * values, SLOTS) / len(part)).astype(np.float32)
                seen[h] += g * g
                w[h] -= rate * g / np.sqrt(seen[h])
                g_b = error.mean()
                seen_b[h] += g_b * g_b
                b[h] -= rate * g_b / np.sqrt(seen_b[h])
    ends = []
    for h, y in enumerate(good):
        z = np.array([w[h][rows[i][0]] @ np.repeat(rows[i][2], rows[i][1]) + b[h] for i in np.flatnonzero(fold)])
        ends.append([b[h], *(platt(z, y[fold]) if y.min() < y.max() else (0.0, 30.0))])  # one class only: all pass
    return np.concatenate([w, np.array(ends, np.float32)], axis=1)


def platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a and c of the probability 1 / (1 + exp(-(a z + c))), by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([z, np.ones(len(z))], axis=1)
    x = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(x):
        s = design @ x
        return (np.logaddexp(0, s) - t * s).sum()

    now = loss(x)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ x, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - t))
        while (after := loss(x - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2  # a full step can go past the least loss and on without end
        if after > now or np.abs(step).max() < 1e-9:
            break
        x, now = x - step, after
    return float(x[0]), float(x[1])


def good_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, fine, clean, good): 1 for quality, for no toxicity, for both."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    worst = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("fine"), F.min((F.col("toxic") == 0).cast("int")).alias("clean"))
    return worst.withColumn("good", F.least("fine", "clean"))


def fit_quality_model(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """Numbers of the model (for each head ``SLOTS`` weights and three more), None if there is nothing to learn."""
    known = good_labels(labels).select(F.col("doc_id").cast("long").alias("doc_id"), *HEADS, F.xxhash64("doc_id", F.lit("quality")).alias("turn"))
    sample = F.broadcast(known.orderBy("turn", "doc_id").limit(train_rows))  # train_rows ids at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.max(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    sizes = texts.join(sample, "doc_id").groupBy("doc_id", *HEADS, "turn").agg(size.alias("size")).where(F.col("size") <= TRAIN_TEXT_BYTES)
    in_turn = Window.orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over train_rows rows at most
    chosen = sizes.withColumn("bytes", F.sum("size").over(in_turn)).where(F.col("bytes") <= TRAIN_BYTES).select("doc_id", *HEADS)
    rows = texts.join(F.broadcast(chosen), "doc_id")
    names = ["doc_id", *HEADS, "features", "part"]

    def prepare(batches):
        for b in batches:
            packed = pa.array([_sparse((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(2 + h).cast(pa.int32()) for h in range(len(HEADS))], packed, pa.array([0] * len(b), pa.int32())], names=names)

    def fit(table: pa.Table) -> pa.Table:
        ids = np.array(table["doc_id"].to_pylist(), np.int64)
        order = np.argsort(ids)
        good = np.array([table[h].to_pylist() for h in HEADS], np.float64)[:, order]
        if (good.min(axis=1) == good.max(axis=1)).all():
            return pa.table({"model": pa.array([], pa.binary())})
        fold = mix(ids[order].astype(np.uint64)) % np.uint64(5) == 0
        features = [table["features"][i].as_buffer() for i in order.tolist()]  # no copies
        return pa.table({"model": pa.array([fit_heads(features, good, fold).tobytes()], pa.binary())})

    made = rows.select("doc_id", "text", *HEADS).mapInArrow(tidy(prepare), "doc_id long, fine int, clean int, features binary, part int")
    each = made.groupBy("doc_id", *HEADS, "part").agg(F.min("features").alias("features"))
    model = each.select(*names).groupBy("part").applyInArrow(tidy_group(fit), "model binary").collect()
    return np.frombuffer(model[0][0], np.float32).reshape(len(HEADS), -1) if model else None


def verdicts(texts: list[bytes], model: np.ndarray | None, least: tuple[float, ...]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Rule counts, failed by the rules, probability of each head, kept."""
    c = rule_counts(texts)
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    p = np.ones((len(HEADS), len(texts)))
    if model is not None:
        bias, slope, shift = model[:, SLOTS:].astype(np.float64).T[:, :, None]
        z = slope * (linear_scores(texts, model[:, :SLOTS]) + bias) + shift
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return c, failed, p, ~failed & (p >= np.array(least)[:, None]).all(axis=0)


def _text_groups(column):
    return chunks((t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: np.ndarray | None, least: tuple[float, ...] = LEAST_PROBABILITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rule counts, base_failed, kept and the probability of each head, of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of one fixed size
    names = ["doc_id", *COUNTS, "base_failed", "kept", *[f"p_{h}" for h in HEADS]]

    def run(batches):
        for batch in batches:
            done = 0
            for texts in _text_groups(batch.column(1)):
                counts, failed, p, kept = verdicts(texts, shared.value, least)
                cols = [pa.array(counts[k], pa.int64()) for k in COUNTS]
                cols += [pa.array(failed), pa.array(kept), *map(pa.array, p)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *cols], names=names)
                done += len(texts)

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, p_fine double, p_clean double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def filter_documents(docs: DataFrame, labels: DataFrame, least: tuple[float, ...] = LEAST_PROBABILITY) -> DataFrame:
    """The rows of docs, with their columns, that the rules and the classifier keep.

    A verdict depends on the text only, so it is made where the row is: no join, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality_model(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [verdicts(texts, shared.value, least)[3] for texts in _text_groups(batch.column(place))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tidy(run), docs.schema)
