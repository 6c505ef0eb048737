"""SentencePiece encoding and decoding: best segmentation by the scores of a model's pieces.

An Aho-Corasick automaton over the pieces reads a word once; at each position it follows the output
links to all pieces that end there, and each relaxes the best score of a segmentation up to there
(Viterbi in a single pass).  Characters that no piece covers become byte pieces.  No piece of a usable
model goes on over the start of a next word (checked when it is read), so words segment alone and a
worker keeps the segmentations of the words it has met lately.

Blanks stand as U+2581 with one before the text, as the model has them; a U+2581 of the text itself is
written in bytes, so decoding gives every text back.

The texts are not normalised, and the segmentation is the one with the best sum of scores, whatever order
of merges the model was trained with: ids can differ from those of the model's own ``encode``.

Cases: null and empty texts have no pieces (a null text decodes as empty); of segmentations with one
score the one whose last piece is longest stays; repeated rows are encoded alike; an empty table gives
no rows; extra columns are ignored by ``encode`` and kept by ``with_pieces``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import expand, squeeze, tidy

#: The mark for a blank.
MARK = "▁"
_HIDDEN = "\ud800"
#: Words kept with their pieces in each of a worker's two generations, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48
_WORD = re.compile(r" *[^ \n]+| +|\n")
_CODECS: dict = {}


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes = [0] * 256
        self.piece: list[bytes] = []
        least = 0.0
        longest_gap = False
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.bytes[value] = i
                self.piece.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.piece.append(b"")
            else:
                self.piece.append(text.replace(MARK, " ").encode())
                score = model.get_score(i)
                if score > -1e8:  # others are for merged blanks of the user, which never win
                    least = min(least, score)
                self.automaton.add_word(text, (len(text), i, score))
                longest_gap |= MARK in text.lstrip(MARK) or "\n" in text
        if longest_gap:
            raise ValueError("the model has pieces over the start of a word")
        self.automaton.make_automaton()
        self.unknown = least - 10  # of a character in bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a word, blanks before it included."""
        # a lone surrogate, which no text holds, hides the text's own marks from the automaton
        word = text.replace(MARK, _HIDDEN).replace(" ", MARK)
        n = len(word)
        best = [0.0] + [-1e300] * n
        came: list = [None] * (n + 1)
        done = 0
        for end, (size, i, score) in self.automaton.iter(word):
            end += 1
            while done < end - 1:  # positions that no piece ends at are reached by bytes
                done += 1
                self._by_bytes(best, came, done)
            total = best[end - size] + score
            if done < end:
                done = end
                self._by_bytes(best, came, done)
            if total > best[end]:
                best[end], came[end] = total, (size, i)
        while done < n:
            done += 1
            self._by_bytes(best, came, done)
        out, at = [], n
        while at:
            size, i = came[at]
            if i >= 0:
                out.append(i)
            else:
                char = text[at - 1]
                out += [self.bytes[b] for b in reversed(char.encode())]
            at -= size
        return out[::-1]

    def _by_bytes(self, best: list, came: list, at: int) -> None:
        best[at], came[at] = best[at - 1] + self.unknown, (1, -1)

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.segment(word), np.uint32).tobytes()
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        words = _WORD.findall(" " + text)
        young = self.young
        new = set(words).difference(young)
        for w in new:
            young[w] = self._word(w)
        ids = np.frombuffer(b"".join(map(young.__getitem__, words)), np.uint32)
        for w in new:
            if len(w) > CACHE_CHARS:
                del young[w]
        if len(young) > CACHE_ENTRIES:
            self.old, self.young = young, {}
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.piece.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def codec(path: str) -> PieceCodec:
    """The model's codec, made once in a worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): ids are uint32, compressed; round_trip says that decoding them gave the text."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for a in range(0, len(batch), 128):
                texts = [t or "" for t in batch.column(1).slice(a, 128).to_pylist()]
                ids = [c.encode(t) for t in texts]
                back = [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 128), pa.array([len(x) for x in ids], pa.int64()), pa.array([squeeze(x.tobytes()) for x in ids], pa.binary()), pa.array(back)], names=["doc_id", "n_pieces", "ids", "round_trip"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids binary, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded rows."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(np.frombuffer(expand(x), np.uint32)) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) for every document."""

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(expand(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), batch.column(3)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return encode(docs, model).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
