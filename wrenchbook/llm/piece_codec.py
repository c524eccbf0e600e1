"""SentencePiece encoding and decoding with a batched Viterbi search.

Spaces become the mark of the vocabulary, and a text gets one in front. No piece goes on behind a
mark that follows other characters, nor over a line end, so texts are cut there into words that
are segmented once per task. The best segmentation has the largest sum of piece scores, of equal
ones that with the longest last piece. Characters without a piece become their UTF-8 bytes; so
does the mark itself when a text has it, and every text is decoded to itself.

The scores are those of the model as they are. A model that was made by merging pairs has ranks as
scores; this search then prefers few and early pieces and can differ from replaying the merges.

Defined results: null and empty text have no pieces; null is decoded to the empty text. Long words
cost time in proportion to their length. Extra columns are ignored by ``encode``.
With ``carry`` all columns come along; ``pieces`` and ``text`` take the place of columns with their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.lattice import MARK, MODEL, SPACE, Lattice, Vocabulary, by_length, load, utf8_lengths
from wrenchbook.llm.shared import slices, with_text

#: A task forgets its segmented words beyond this number.
KNOWN_WORDS = 100_000

_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def words_of(text: str) -> list[str]:
    """The pieces of text that are segmented by themselves."""
    return _WORD.findall((" " + text).replace(SPACE, MARK).replace(" ", SPACE)) if text else []


class Encoder:
    """Segments words; one per task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.lattice = Lattice(vocabulary, vocabulary.ordinary)
        self.byte_ids = vocabulary.byte_ids
        ordinary = vocabulary.scores[vocabulary.ordinary]
        usual = ordinary[ordinary > -1e8]
        # The last entry is the score of no piece; a byte is worse than any piece.
        self.scores = np.append(vocabulary.scores, -np.inf)
        self.byte_score = (float(usual.min()) if len(usual) else 0.0) - 1.0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _segment(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces per word and all pieces of words of one length."""
        n, rows = len(words), np.arange(len(words))
        edges = self.lattice.edges(words, length)
        loose = self.byte_score * utf8_lengths(words, length)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        size_of, piece_of = np.zeros((n, length + 1), np.int64), np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = range(min(len(edges), end), 0, -1)
            pieces = np.stack([edges[s - 1][:, end - s] for s in sizes], 1)
            scores = self.scores[pieces]
            alone = pieces[:, -1] < 0
            scores[alone, -1] = loose[alone, end - 1]
            scores += best[:, end - len(sizes) : end]
            chosen = scores.argmax(1)
            best[:, end], piece_of[:, end] = scores[rows, chosen], pieces[rows, chosen]
            size_of[:, end] = len(sizes) - chosen
        at, steps = np.full(n, length), []
        while (at > 0).any():
            steps.append((np.where(at > 0, piece_of[rows, at], -2), at.copy()))
            at = at - size_of[rows, at]
        ids = np.stack([s[0] for s in steps[::-1]], 1)
        used = ids != -2
        sizes, flat = used.sum(1), ids[used]
        if (flat == -1).any():
            return self._with_bytes(words, ids, np.stack([s[1] for s in steps[::-1]], 1))
        return sizes, flat

    def _with_bytes(self, words: list[str], ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces per word and all pieces, where some characters are spelled in bytes."""
        out: list[list[int]] = []
        for word, own, ends in zip(words, ids.tolist(), places.tolist()):
            spelled = ([self.byte_ids[b] for b in word[end - 1].replace(MARK, SPACE).encode()] if piece == -1 else [piece] for piece, end in zip(own, ends) if piece != -2)
            out.append(list(chain.from_iterable(spelled)))
        return np.array([len(o) for o in out]), np.fromiter(chain.from_iterable(out), np.int64)

    def _learn(self, new: set[str]) -> None:
        sizes, flats = [self.sizes], [self.flat]
        for length, words in by_length(new):
            own, flat = self._segment(words, length)
            self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
            sizes.append(own)
            flats.append(flat.astype(np.int32))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flats)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of the texts, and how many each text has."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        split = [words_of(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            self._learn(new)
        counts = np.array([len(words) for words in split], np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        sizes = self.sizes[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return _gathered(self.flat, self.starts[number], sizes), np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with the given starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """What each piece stands for."""
    plain = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
    for value, piece in enumerate(vocabulary.byte_ids):
        plain[piece] = bytes([value])
    return plain


def encode(docs: DataFrame, model: str = MODEL, carry: bool = False) -> DataFrame:
    """``doc_id`` and ``pieces``, the piece numbers of every text; with ``carry`` behind all columns of ``docs``."""
    # Plain values, which a worker reads without this package.
    shared = docs.sparkSession.sparkContext.broadcast(load(model).values())
    columns = docs.columns if carry else ["doc_id", "text"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in slices(with_text(batches), size=1 << 20):
            pieces, counts = encoder([t or "" for t in batch.column("text").to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(ends, pa.array(pieces, pa.int32()))], ["row", "pieces"])

    made = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, pieces array<int>")
    return made.select(*[F.col(f"row.`{c}`") for c in (docs.columns if carry else ["doc_id"]) if c != "pieces"], "pieces")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``text``, what its ``pieces`` stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(piece_bytes(load(model)))
    kept = [F.col(f"`{c}`") for c in encoded.columns]
    plain = encoded.select(F.struct(*kept).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in shared.value], np.int64)
        letters, starts = np.frombuffer(b"".join(shared.value), np.uint8), np.cumsum(sizes) - sizes
        for batch in slices(with_text(batches, "pieces"), "pieces", 1 << 20):
            lists = batch.column("pieces").cast(pa.large_list(pa.int32()))
            counts = lists.value_lengths().fill_null(0).to_numpy()
            pieces = lists.drop_null().flatten().to_numpy()
            whole = _gathered(letters, starts[pieces], sizes[pieces])
            # Where each text starts: with the space that was put in front.
            ends = np.concatenate([[0], np.cumsum(sizes[pieces])])[np.concatenate([[0], np.cumsum(counts)])]
            whole = np.delete(whole, ends[:-1][counts > 0])
            ends = ends - np.concatenate([[0], np.cumsum(counts > 0)])
            texts = pa.Array.from_buffers(pa.large_string(), len(batch), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts.cast(pa.string())], ["row", "decoded"])

    return plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, decoded string").select(*[F.col(f"row.`{c}`") for c in encoded.columns if c != "text"], F.col("decoded").alias("text"))
