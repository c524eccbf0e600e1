"""Line dedup: passages that an earlier document has, and repeated content-defined chunks of lines.

Lines with a letter, a digit or a character beyond ASCII have content; others (empty ones, brackets, rules)
are separators and never make a passage. A passage of ``LEAST_LINES`` lines with content or more that stands
in an earlier document, in the order of ``doc_id`` (null last, then place), goes from its first to its last
line, whatever stands around it and whichever separators stand in it: each run of ``LEAST_LINES`` neighbouring
lines with content is looked up by itself. Inside one document whole chunks go that stand in an earlier place
of it: a rolling hash over the last ``ROLLED`` line hashes ends a chunk wherever it is divisible by ``MODULUS``,
so an inserted line moves the borders near it and no others. A separator goes where the lines with content on
both sides of it go; the ends of a text count as gone.

Equal fingerprints only nominate; the bytes of a run are compared with those of the first run of its
fingerprint before it is removed. Fingerprints are counted without the texts. The texts of documents that
have a nominated run are read once more. Of runs that overlap only as many are compared as cover their
lines, and each meets the first one in a join that adaptive execution can split, so a passage in a third
of all rows is no single task.

Defined results: null text is one separator and stays null; a text without content stays as it is; the line
end behind a removed line goes with it; a text that loses all lines is empty; repeated rows are documents of
their own; other columns are carried along. Chunks are those of the lines with content; a removed one is one
of which no line is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.decontaminate import _bitmap, _may_matter
from wrenchbook.llm.shared import mixed, slices, stored, utf8, windows_hash, with_row_key

#: Lines of the rolling hash, and the inverse share of lines that end a chunk.
ROLLED = 2
MODULUS = 4
#: Passages and chunks of fewer lines with content are never removed.
LEAST_LINES = 2

_CONTENT = re.compile(rb"[0-9A-Za-z\x80-\xff]")

_PIECES = "row_key long, at int, high long, low long, is_first boolean, piece binary"


def with_content(lines: list[bytes]) -> list[int]:
    """The places of the lines that have content."""
    return [at for at, line in enumerate(lines) if _CONTENT.search(line)]


def content_lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if _CONTENT.search(line)]


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """First line and end of every chunk of a sequence of lines."""
    if not lines:
        return []
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(line) for line in lines), np.uint64, len(lines))
    rolled = windows_hash(hashes, ROLLED)
    ends = np.flatnonzero(mixed(rolled) % np.uint64(MODULUS) == 0) + ROLLED
    borders = [0, *[int(e) for e in ends if e < len(lines)], len(lines)]
    return list(zip(borders[:-1], borders[1:]))


def run_prints(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the fingerprint of every run of ``LEAST_LINES`` neighbouring lines."""
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.uint64).reshape(-1, 2)
    return windows_hash(hashes[:, 0], LEAST_LINES).view(np.int64), windows_hash(hashes[:, 1], LEAST_LINES).view(np.int64)


def covering(at: np.ndarray) -> np.ndarray:
    """As many of the places of runs, in ascending order, as hold the lines of all of them."""
    if not len(at):
        return at
    alone = np.diff(at) != 1
    first = np.maximum.accumulate(np.where(np.concatenate([[True], alone]), at, 0))
    return at[((at - first) % LEAST_LINES == 0) | np.concatenate([alone, [True]])]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of every row, each once."""
    for batch in slices(batches):
        halves = [run_prints(content_lines(text)) for text in utf8(batch.column("text"))]
        which = np.repeat(np.arange(len(batch)), [len(high) for high, _ in halves])
        high, low = (np.concatenate([h[k] for h in halves] or [np.empty(0, np.int64)]) for k in (0, 1))
        order = np.lexsort((low, high, which))
        which, high, low = which[order], high[order], low[order]
        new = np.ones(len(which), bool)
        new[1:] = (np.diff(which) != 0) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        rows = pa.array(which[new])
        yield pa.RecordBatch.from_pydict({"row_key": batch.column("row_key").take(rows), "doc_id": batch.column("doc_id").take(rows), "high": high[new], "low": low[new]})


def _asked(texts: DataFrame, per_row: DataFrame) -> DataFrame:
    """The texts of rows that may be in ``per_row``: a bitmap of fixed size keeps most others out of the shuffle."""
    place = F.xxhash64("row_key").alias("gram")
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(per_row.select(place)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = _may_matter(shared.value, batch.column("gram").to_numpy().view(np.uint64))
            yield batch.select(["row_key", "text"]).filter(pa.array(may))

    return texts.select("row_key", "text", place).mapInArrow(run, "row_key long, text binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of nominated runs: the first place of a row's own firsts, and what covers the others."""
    for batch in slices(batches):
        out = []
        for row, text, asked in zip(batch.column("row_key").to_pylist(), utf8(batch.column("text")), batch.column("prints").to_pylist()):
            lines = content_lines(text)
            own = list(zip(*(half.tolist() for half in run_prints(lines))))
            others = {(p["high"], p["low"]) for p in asked if not p["is_first"]}
            firsts = {(p["high"], p["low"]) for p in asked if p["is_first"]}
            places = [(int(at), False) for at in covering(np.array([at for at, p in enumerate(own) if p in others], np.int64))]
            for at, p in enumerate(own):
                if p in firsts:
                    firsts.discard(p)
                    places.append((at, True))
            out += [(row, at, *own[at], is_first, b"\n".join(lines[at : at + LEAST_LINES])) for at, is_first in places]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], [f.split()[0] for f in _PIECES.split(", ")])


def _cut(text: bytes | None, places: list[int] | None) -> tuple[bytes | None, int, int, int, int]:
    """The text without its repeated lines, and its lines, chunks, removed lines and removed chunks.

    ``places`` count lines with content, like the chunks.
    """
    lines = (text or b"").split(b"\n")
    at = with_content(lines)
    gone = np.zeros(len(at), bool)
    for place in places or ():
        gone[place : place + LEAST_LINES] = True
    bounds, seen = chunk_bounds([lines[i] for i in at]), set()
    for first, end in bounds:
        if end - first >= LEAST_LINES:
            chunk = b"\n".join(lines[i] for i in at[first:end])
            gone[first:end] |= chunk in seen
            seen.add(chunk)
    if not gone.any():
        return text, len(lines), len(bounds), 0, 0
    # Each line lies behind as many lines with content as this counts; a separator needs both neighbours gone.
    behind = np.searchsorted(at, np.arange(len(lines)))
    is_content = np.zeros(len(lines), bool)
    is_content[at] = True
    edged = np.concatenate([[True], gone, [True]])
    drop = edged[behind + 1] & (is_content | edged[behind])
    kept = b"\n".join(line for line, g in zip(lines, drop) if not g)
    return kept, len(lines), len(bounds), int(drop.sum()), sum(bool(gone[a:b].all()) for a, b in bounds)


#: Columns behind those of the documents; they take the place of columns with their names.
COUNTED = ("n_lines", "n_chunks", "removed_lines", "removed_chunks")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the shortened ``text``, and ``n_lines``, ``n_chunks``, ``removed_lines``, ``removed_chunks`` behind its columns."""
    done, columns = _shortened(docs)
    return done.select(*[column for name, column in columns if name not in COUNTED], *COUNTED)


def keep_worded(docs: DataFrame) -> DataFrame:
    """``docs`` with the shortened ``text`` and its ``n_chars``, without those that have lost all their words."""
    done, columns = _shortened(docs)
    left = done.where((F.col("removed_lines") == 0) | F.regexp_like("cut", F.lit(r"[^\x20\x09-\x0D]")))
    return left.select(*[F.length("cut").cast("long").alias(name) if name == "n_chars" else column for name, column in columns])


def _shortened(docs: DataFrame) -> tuple[DataFrame, list]:
    """Rows with their shortened text and counts, and the names and columns of ``docs`` in them."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    keyed = with_row_key(docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text"))
    texts = keyed.select("row_key", F.col("text").cast("binary").alias("text"), "row")
    prints = stored(keyed.select("row_key", "doc_id", "text").mapInArrow(_fingerprints, "row_key long, doc_id long, high long, low long"), "line-prints")

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    repeated = prints.groupBy("high", "low").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("high", "low", F.col("first.row_key").alias("first_row"))
    nominated = prints.join(repeated, ["high", "low"]).select("row_key", F.struct("high", "low", (F.col("row_key") == F.col("first_row")).alias("is_first")).alias("print"))
    per_row = stored(nominated.groupBy("row_key").agg(F.collect_list("print").alias("prints")), "line-nominated")

    # The content of nominated runs only; the first one of a fingerprint meets all others.
    pieces = stored(_asked(texts, per_row).join(per_row, "row_key").mapInArrow(_pieces, _PIECES), "line-pieces")
    first = pieces.where("is_first").select("high", "low", F.col("piece").alias("first_piece"))
    same = pieces.where("NOT is_first").join(first, ["high", "low"]).where(F.col("piece") == F.col("first_piece"))
    removed = stored(same.select("row_key", "at"), "line-removed").groupBy("row_key").agg(F.collect_list("at").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [_cut(t, p) for t, p in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())]
            cut, *numbers = zip(*done) if done else [()] * 5
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "cut": pa.array(cut, pa.binary()).cast(pa.string()), **{c: pa.array(n, pa.int64()) for c, n in zip(COUNTED, numbers)}})

    fields = [(c, F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in columns]
    # The text is carried once: as bytes, beside the other columns.
    rest = F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]).alias("row")
    shape = docs.select(row).schema["row"].dataType.simpleString()
    # Sorted and merged at every size: removed rows grow with the table, so a broadcast would fit small ones only.
    whole = texts.join(removed.hint("merge"), "row_key", "left").select(rest, "text", "places")
    done = whole.mapInArrow(run, f"row {shape}, cut string, " + ", ".join(f"{c} long" for c in COUNTED))
    return done, fields
