"""Words of whole Arrow text columns as flat arrays of 64-bit hashes, without a Python object per word.

A byte is replaced by a random 64-bit value and weighed by a power of an odd base; differences of
running sums, divided by the power at the start, are then the same wherever a word stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from wrenchbook.llm.shared import MIX_C, mixed

#: Texts are hashed in slabs of about so many bytes, which stay in a core's cache.
SLAB = 1 << 18

# The white space that separates words, and the capital letters that are lowered.
SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0x5851F42D4C957F2D


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    exact = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_C)
    lower = exact.copy()
    lower[ord("A") : ord("Z") + 1] = exact[ord("a") : ord("z") + 1]
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    return exact, lower, inside


class _Powers:
    """Powers of the base and of its inverse, as many as the longest slab needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


@dataclass
class Words:
    """Flat words of some texts: where they start and end in ``data``, their hashes, how many per text."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: list[np.ndarray]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        return np.split(flat, np.cumsum(self.counts)[:-1]) if len(self.counts) else []


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its texts; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1)
        yield first, min(last, n)
        first = min(last, n)


class WordHasher:
    """Splits at ASCII white space, and at other separators if told, and hashes; one per task."""

    def __init__(self, cases: tuple[str, ...] = ("lower",), separators: bytes = b"") -> None:
        exact, lower, self.inside = _tables()
        self.inside[list(separators)] = False
        self.tables = [{"exact": exact, "lower": lower}[case] for case in cases]
        self.powers = _Powers()

    def __call__(self, column: pa.Array) -> Words:
        data, offsets = buffers(column)
        starts, ends, hashes = [], [], [[] for _ in self.tables]
        for first, last in slabs(offsets):
            low, high = offsets[first], offsets[last]
            part = data[low:high]
            if not len(part):
                continue
            inside = self.inside[part]
            border = np.zeros(len(part) + 1, bool)
            border[offsets[first:last] - low] = True
            border[-1] = True
            before = np.concatenate([[True], ~inside[:-1]]) | border[:-1]
            after = np.concatenate([~inside[1:], [True]]) | border[1:]
            a, b = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
            up, down = self.powers.upto(len(part) + 1)
            for values, out in zip(self.tables, hashes):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(values[part] * up[: len(part)], out=sums[1:])
                out.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
            starts.append(a + low)
            ends.append(b + low)
        flat = np.concatenate(starts) if starts else np.empty(0, np.int64)
        counts = np.diff(np.searchsorted(flat, offsets))
        return Words(
            data, offsets, flat, np.concatenate(ends) if ends else np.empty(0, np.int64), counts,
            [np.concatenate(h) if h else np.empty(0, np.uint64) for h in hashes],
        )


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of every text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def runs(flat: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` neighbours that stay inside a text, and how many per text."""
    n = len(flat) - size + 1
    per = np.maximum(counts - size + 1, 0)
    if n <= 0:
        return np.empty(0, np.uint64), per
    out = flat[:n].copy()
    for k in range(1, size):
        out *= MIX_C
        out += flat[k : n + k]
        out ^= out >> np.uint64(31)
    # The last size - 1 words of a text start no run.
    keep = np.ones(len(flat), bool)
    ends = np.cumsum(counts)
    for k in range(1, size):
        at = ends[counts >= k] - k
        keep[at] = False
    return mixed(out[keep[:n]]), per
