"""Repeated byte strings by sorted, recursively named samples of all suffixes.

The suffix of every position is named by its first bytes: a triple of letters is a name, a triple
of names is the name of a longer prefix, and so on (3, 9, 27, 81 bytes). Names are hashes, equal
for equal prefixes everywhere, so the recursion needs no shuffle to renumber them.

Only a sample of the suffixes is sorted. The sample is a cover: of each window of ``LENGTH``
positions the suffix with the least 27-byte name is in it, so two equal strings always have a
sampled suffix at the same distance from their start, whatever their positions are. Residues that
are fixed beforehand have this property too, but keep two thirds of all suffixes; this cover
keeps one in about 37. Samples whose name occurs once are dropped: no string around them occurs twice.

The remaining suffixes are merged in groups of their sample: the strings that start before a
sample travel with it as one piece of text, are sorted by name, and neighbours are compared byte
by byte. Of equal strings the first one stays, and all others mark their bytes.

A chunk of documents hands on every piece of text once, so a passage that a third of all rows
share arrives once per chunk. Everything that is grouped is a bucket of names or a chunk.

Defined results: null text is empty; texts below ``LENGTH`` bytes lose nothing; documents are ordered
by ``doc_id`` (cast to long, null last), rows of one id by their place; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.shared import MIX_A, MIX_B, MIX_C, mixed, partitions, slices, stored
from wrenchbook.llm.wordhash import buffers

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: Bytes that the name of a sampled suffix covers: three levels of triples.
NAMED = 27
#: Text of a chunk, and positions that are worked on at once.
CHUNK = 4 << 20
#: Bytes of pieces that are sorted at once; a larger bucket is worked off by ranges of names.
PASS = 2 << 20
PIECE = 1 << 18

_PLACE = np.uint64((1 << 20) - 1)


def _triples(names: np.ndarray, step: int) -> np.ndarray:
    n = max(len(names) - 2 * step, 0)
    out = names[:n] * MIX_A
    out += names[step : n + step] * MIX_B
    out += names[2 * step : n + 2 * step] * MIX_C
    out ^= out >> np.uint64(29)
    return out


def prefix_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 27-byte prefix and of the ``LENGTH``-byte prefix of every suffix that has one."""
    letters = mixed(np.arange(1, 257, dtype=np.uint64))
    names = letters[data]
    for step in (1, 3, 9):
        names = _triples(names, step)
    long = _triples(names, NAMED)
    overlap = LENGTH - 3 * NAMED
    whole = mixed(long[: max(len(long) - overlap, 0)] * MIX_C + long[overlap:])
    return names, whole


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


@dataclass
class Samples:
    """Sampled suffixes: position, name, and the first and last string start that they stand for."""

    at: np.ndarray
    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def samples(data: np.ndarray, offsets: np.ndarray) -> Samples:
    """The cover of the strings of some texts that lie one after another in ``data``."""
    found: list[tuple[np.ndarray, ...]] = []
    total, width = len(data), LENGTH - NAMED + 1
    inside = np.ones(total, bool)
    # No string starts in the last bytes of a text.
    for k in range(1, LENGTH):
        at = offsets[1:][np.diff(offsets) >= k] - k
        inside[at] = False
    for start in range(0, max(total - LENGTH + 1, 0), PIECE):
        part = data[start : start + PIECE + LENGTH - 1]
        names = prefix_names(part)[0]
        least = _least((names & ~_PLACE) | np.arange(len(names), dtype=np.uint64), width)
        starts = np.flatnonzero(inside[start : start + len(least)])
        place = (least[starts] & _PLACE).astype(np.int64)
        if not len(starts):
            continue
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        found.append((place[first] + start, names[place[first]], starts[first] + start, starts[last] + start))
    if not found:
        none = np.empty(0, np.int64)
        return Samples(none, np.empty(0, np.uint64), none, none)
    return Samples(*[np.concatenate(columns) for columns in zip(*found)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The task's documents in chunks with numbers of their own."""
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(slices(batches, size=CHUNK)):
        yield (task << 24) | number, batch


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _parts(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    return used, np.split(order, starts[1:]) if len(used) else []


def _sampled_names(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The names in a chunk, by bucket; the lowest bit tells whether the chunk has a name twice."""
    pack = zstandard.ZstdDecompressor()
    for chunk, text, offsets in (row.values() for batch in batches for at in range(len(batch)) for row in batch.slice(at, 1).to_pylist()):
        data = np.frombuffer(pack.decompress(text), np.uint8)
        names, counts = np.unique(samples(data, np.frombuffer(offsets, np.int64)).name & ~np.uint64(1), return_counts=True)
        names |= (counts > 1).astype(np.uint64)
        if len(names):
            used, parts = _parts(_bucket(names, buckets))
            yield pa.RecordBatch.from_pydict({"bucket": used, "chunk": np.full(len(used), chunk), "names": pa.array([names[p].tobytes() for p in parts], pa.binary())})


def _repeated_names(bucket: pa.Table) -> pa.Table:
    """The names of a bucket that occur twice, for each chunk that has them."""
    payloads = [np.frombuffer(p, np.uint64) for p in bucket.column("names").to_pylist()]
    flat = np.concatenate(payloads)
    names, which, counts = np.unique(flat & ~np.uint64(1), return_inverse=True, return_counts=True)
    again = counts > 1
    again[which[(flat & np.uint64(1)) == 1]] = True
    ends = np.cumsum([len(p) for p in payloads])[:-1]
    out = [(c, p[keep] & ~np.uint64(1)) for c, p, keep in zip(bucket.column("chunk").to_pylist(), payloads, np.split(again[which], ends)) if keep.any()]
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "names": pa.array([n.tobytes() for _, n in out], pa.binary())})


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for chunk, batch in _chunks(batches):
        data, offsets = buffers(batch.column("text"))
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([chunk], pa.int64()),
                "ids": pa.array([ids.fill_null(0).to_numpy().tobytes()], pa.binary()),
                "missing": pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                "offsets": pa.array([offsets.tobytes()], pa.binary()),
                "text": pa.array([pack.compress(data.tobytes())], pa.binary()),
            }
        )


@dataclass
class Chunk:
    """A chunk's documents, unpacked."""

    number: int
    ids: np.ndarray
    missing: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def _unpacked(packed: pa.Table) -> Chunk:
    row = {name: packed.column(name)[0].as_py() for name in packed.column_names}
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    return Chunk(row["chunk"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["missing"], bool), np.frombuffer(row["offsets"], np.int64), data)


def _spans_table(chunk: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, pa.Array]:
    """Per chunk the rows of documents and their marked bytes, packed."""
    used, parts = _parts(chunk)
    spans = [np.stack([row[p], low[p], high[p]]).astype(np.int64).tobytes() for p in parts]
    return {"chunk": pa.array(used.astype(np.int64), pa.int64()), "spans": pa.array(spans, pa.binary())}


# The parts of a record on its way to the bucket of its name, beside its piece of text.
_RECORD = np.dtype([("name", "<u8"), ("no_id", "?"), ("id", "<i8"), ("chunk", "<i8"), ("row", "<i4"), ("low", "<i8"), ("strings", "<i4")])


def _candidates(packed: pa.Table, names: pa.Table, buckets: int) -> pa.Table:
    """Pieces of text around samples whose name is repeated, each once in the chunk."""
    kinds = pa.schema([("bucket", pa.int64()), ("records", pa.binary()), ("chunk", pa.int64()), ("spans", pa.binary())])
    if not packed.num_rows or not names.num_rows:
        return kinds.empty_table()
    chunk = _unpacked(packed)
    wanted = np.sort(np.frombuffer(b"".join(names.column("names").to_pylist()), np.uint64))
    cover = samples(chunk.data, chunk.offsets)
    key = cover.name & ~np.uint64(1)
    hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
    row = np.searchsorted(chunk.offsets, cover.low[hit], "right") - 1
    low, high = cover.low[hit], cover.high[hit] + LENGTH
    # In the order of the documents, so that of equal pieces the first one stays.
    order = np.lexsort((low, row, chunk.ids[row], chunk.missing[row]))
    body, seen, first, again = chunk.data.tobytes(), set(), [], []
    for at, a, b in zip(order.tolist(), low[order].tolist(), high[order].tolist()):
        piece = body[a:b]
        if piece in seen:
            again.append(at)
        else:
            seen.add(piece)
            first.append(at)
    del seen
    again, first = np.array(again, np.int64), np.array(first, np.int64)
    own = _spans_table(np.full(len(again), chunk.number), row[again], low[again] - chunk.offsets[row[again]], high[again] - chunk.offsets[row[again]])
    records = np.zeros(len(first), _RECORD)
    records["name"] = key[hit[first]]
    records["no_id"], records["id"], records["chunk"] = chunk.missing[row[first]], chunk.ids[row[first]], chunk.number
    records["row"], records["low"] = row[first], low[first] - chunk.offsets[row[first]]
    records["strings"] = high[first] - low[first] - LENGTH + 1
    used, parts = _parts(_bucket(key[hit[first]], buckets))
    pack, payloads = zstandard.ZstdCompressor(level=3), []
    for part in parts:
        part = part[np.argsort(key[hit[first[part]]], kind="stable")]
        pieces = b"".join(body[a:b] for a, b in zip(low[first[part]].tolist(), high[first[part]].tolist()))
        payloads.append(pack.compress(len(part).to_bytes(8, "little") + records[part].tobytes() + pieces))
    there, local = len(used), len(own["chunk"])
    # Spans found here pass by the buckets under a number of their own.
    return pa.table(
        {
            "bucket": pa.array([*used.tolist(), *([-1 - chunk.number] * local)], pa.int64()),
            "records": pa.array([*payloads, *([None] * local)], pa.binary()),
            "chunk": pa.array([*([None] * there), *own["chunk"].to_pylist()], pa.int64()),
            "spans": pa.array([*([None] * there), *own["spans"].to_pylist()], pa.binary()),
        },
        schema=kinds,
    )


def _equal_neighbours(data: np.ndarray, starts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether the strings at sorted places p and p - 1 have the same bytes."""
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    out = np.zeros(len(pairs), bool)
    for a in range(0, len(pairs), 1 << 14):
        p = pairs[a : a + (1 << 14)]
        out[a : a + len(p)] = (view[starts[p]] == view[starts[p - 1]]).all(1)
    return out


def _judged(bucket: pa.Table) -> pa.Table:
    """Spans of all strings of a bucket that have an equal one before them."""
    if bucket.column("records").null_count:
        return bucket.select(["chunk", "spans"])
    unpack, loaded = zstandard.ZstdDecompressor(), []
    for payload in bucket.column("records").to_pylist():
        raw = unpack.decompress(payload)
        n = int.from_bytes(raw[:8], "little")
        loaded.append((np.frombuffer(raw, _RECORD, n, 8), np.frombuffer(raw, np.uint8, offset=8 + n * _RECORD.itemsize)))
    passes = max(sum(len(body) for _, body in loaded) // PASS, 1)
    return pa.concat_tables([_later_strings(*_of_pass(loaded, number, passes)) for number in range(passes)])


def _of_pass(loaded: list[tuple[np.ndarray, np.ndarray]], number: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The records with names of one range, and their pieces."""
    records, bodies = [], []
    for record, body in loaded:
        mine = mixed(record["name"]) % np.uint64(passes) == number
        sizes = record["strings"].astype(np.int64) + LENGTH - 1
        begin = (np.cumsum(sizes) - sizes)[mine]
        sizes = sizes[mine]
        records.append(record[mine])
        bodies.append(body[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())])
    return np.concatenate(records), np.concatenate(bodies)


def _later_strings(record: np.ndarray, data: np.ndarray) -> pa.Table:
    if not len(record):
        return pa.table({"chunk": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    sizes = record["strings"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    # Strings in the order of the documents; a stable sort by name then keeps this order.
    order = np.lexsort((record["low"], record["row"], record["chunk"], record["id"], record["no_id"]))
    counts = record["strings"][order].astype(np.int64)
    owner = np.repeat(order.astype(np.int32), counts)
    nth = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    starts = (begin[owner] + nth).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    names = np.concatenate([prefix_names(data[a : a + PIECE + LENGTH - 1])[1] for a in range(0, max(len(data) - LENGTH + 1, 0), PIECE)])
    key = names[starts]
    del names
    by_name = np.argsort(key, kind="stable").astype(owner.dtype)
    sorted_starts = starts[by_name]
    same = np.flatnonzero(np.diff(key[by_name]) == 0) + 1
    equal = _equal_neighbours(data, sorted_starts, same)
    later = np.zeros(len(owner), bool)
    later[by_name[same[equal]]] = True
    if not equal.all():
        # Different strings of one name: compare these names' strings one by one.
        clash = np.unique(key[by_name[same[~equal]]])
        seen: set[bytes] = set()
        for at in by_name[np.isin(key[by_name], clash)].tolist():
            string = data[starts[at] : starts[at] + LENGTH].tobytes()
            later[at] = string in seen
            seen.add(string)
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, bool)
    before = np.concatenate([[False], later[:-1]]) & ~fresh
    after = np.concatenate([later[1:] & ~fresh[1:], [False]])
    first, last = np.flatnonzero(later & ~before), np.flatnonzero(later & ~after)
    who = record[owner[first]]
    out = _spans_table(who["chunk"], who["row"], who["low"] + nth[first], who["low"] + nth[last] + LENGTH)
    return pa.table(out)


def _marked_runs(length: int, spans: np.ndarray) -> np.ndarray:
    """Maximal runs of covered bytes, as rows of start and end."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, spans[1], 1)
    np.add.at(steps, spans[2], -1)
    covered = np.concatenate([[0], (np.cumsum(steps)[:-1] > 0).astype(np.int8), [0]])
    edges = np.diff(covered)
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1)


def _cut(packed: pa.Table, spans: pa.Table) -> pa.Table:
    chunk = _unpacked(packed)
    parts = [np.frombuffer(s, np.int64).reshape(3, -1) for s in spans.column("spans").to_pylist()]
    marks = np.concatenate(parts, 1) if parts else np.empty((3, 0), np.int64)
    marks = marks[:, np.argsort(marks[0], kind="stable")]
    n = len(chunk.ids)
    edges = np.searchsorted(marks[0], np.arange(n + 1))
    body, kept, removed = chunk.data.tobytes(), [], []
    for i, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
        own = marks[:, edges[i] : edges[i + 1]]
        if not own.shape[1]:
            removed.append([])
            kept.append(body[a:b])
            continue
        runs = _marked_runs(b - a, own).tolist()
        removed.append([{"start": s, "end": e} for s, e in runs])
        borders = [0, *[x for run in runs for x in run], b - a]
        kept.append(b"".join(body[a + x : a + y] for x, y in zip(borders[::2], borders[1::2])))
    return pa.table(
        {
            "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.missing),
            "n_bytes": pa.array(np.diff(chunk.offsets), pa.int64()),
            "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (maximal runs of removed bytes) and the ``kept`` bytes of every row."""
    # Buckets of names are small; those of texts must fit into a worker with all their strings.
    buckets = 2 * partitions(docs.sparkSession)
    text_buckets = 8 * buckets
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Written once: a chunk has the same number in all that follows, however the table is split.
    texts = stored(plain.mapInArrow(_packed_texts, "chunk long, ids binary, missing binary, offsets binary, text binary"), "suffix-chunks")
    names = texts.select("chunk", "text", "offsets").mapInArrow(lambda b: _sampled_names(b, buckets), "bucket int, chunk long, names binary")
    repeated = names.groupBy("bucket").applyInArrow(_repeated_names, "chunk long, names binary")
    candidates = texts.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(
        lambda left, right: _candidates(left, right, text_buckets), "bucket long, records binary, chunk long, spans binary"
    )
    spans = candidates.groupBy("bucket").applyInArrow(_judged, "chunk long, spans binary")
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(
        _cut, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    )
