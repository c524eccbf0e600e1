"""Lattices of vocabulary pieces over batches of equally long words.

The pieces of a vocabulary are kept as sorted hashes by length. All words of one length advance
together: the hash of every substring is probed in the sorted keys of its length, and each end
position takes the best, or the sum, of all pieces that end there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from wrenchbook.llm.shared import MIX_C, mixed

#: The installed model; a caller may name another one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of one length that are worked on together.
GROUP = 4096

# The mark of a space, and a code point that no text has, for the mark itself.
SPACE = "▁"
MARK = "\ud800"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``byte_ids`` are those of the 256 bytes."""

    pieces: tuple[str, ...]
    scores: np.ndarray
    byte_ids: tuple[int, ...]
    ordinary: np.ndarray

    def values(self) -> tuple:
        return self.pieces, self.scores, self.byte_ids, self.ordinary


def load(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model on the driver; its size bounds what is broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
    byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return Vocabulary(pieces, np.array([model.get_score(i) for i in range(n)]), byte_ids, ~special)


def _grown(hashes: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of substrings one code point longer."""
    n = codes.shape[1] - length + 1
    return hashes[:, :n] * MIX_C + mixed(codes[:, length - 1 :])


def _codes(words: list[str], length: int) -> np.ndarray:
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(words), length).astype(np.uint64)


def by_length(words: Iterable[str], group: int = GROUP) -> Iterator[tuple[int, list[str]]]:
    """Words in groups of one length; a group of long words is smaller."""
    found: dict[int, list[str]] = {}
    for word in words:
        found.setdefault(len(word), []).append(word)
    for length, same in found.items():
        step = max(group * 16 // max(length, 16), 1)
        for start in range(0, len(same), step):
            yield length, same[start : start + step]


class Lattice:
    """Finds the pieces in words; one per task."""

    def __init__(self, vocabulary: Vocabulary, wanted: np.ndarray) -> None:
        ids = np.flatnonzero(wanted)
        self.longest = max((len(vocabulary.pieces[i]) for i in ids), default=0)
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)]
        for length in range(1, self.longest + 1):
            own = np.array([i for i in ids if len(vocabulary.pieces[i]) == length], np.int64)
            keys = self._hash(_codes([vocabulary.pieces[i] for i in own], length)) if len(own) else np.empty(0, np.uint64)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.ids.append(own[order])

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        hashes = mixed(codes)
        for length in range(2, codes.shape[1] + 1):
            hashes = _grown(hashes, codes, length)
        return mixed(hashes[:, 0])

    def edges(self, words: list[str], length: int) -> list[np.ndarray]:
        """For every piece length the piece that starts at each position, or -1."""
        codes = _codes(words, length)
        hashes, found = mixed(codes), []
        for size in range(1, min(self.longest, length) + 1):
            if size > 1:
                hashes = _grown(hashes, codes, size)
            keys, ids = self.keys[size], self.ids[size]
            if len(keys):
                probe = mixed(hashes)
                at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                found.append(np.where(keys[at] == probe, ids[at], -1))
            else:
                found.append(np.full(hashes.shape, -1))
        return found


def utf8_lengths(words: list[str], length: int) -> np.ndarray:
    """Bytes of every code point; the stand-in of the space mark has three."""
    codes = _codes(words, length)
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
