"""Hard-negative mining with Kronecker-packed products.

Components become whole numbers. A block of candidates is packed by component: each candidate's component,
biased to be non-negative, fills a field of its own in one wide integer. An anchor multiplies each of these
integers once by its own component; the fields of the sum are the inner products with all candidates of the
block, exact, as no field can run over into the next one.

Anchors come in blocks of about ``ANCHORS``, which is what a task is sent; every block meets all rows. A first pass
keeps each anchor's best rows of its label, a second one the best rows of other labels inside the band of scores that
each of these positives sets. Tasks hold that many rows per anchor, whatever the size of the table.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a vector
shorter than another one has zeros behind its end; a null ``vec_id`` is no anchor and comes last in ties; repeated
rows are rows of their own, so they may be each other's positives; an empty table gives no rows; extra columns are ignored.
Scores must fit in a long: vectors whose components are too large for that raise ``OverflowError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.llm.shared import stored
from wrenchbook.session import scratch_path

#: A component is multiplied by this and rounded down.
SCALE = 256
#: Positives of an anchor, and negatives of each of them.
POSITIVES, NEGATIVES = 5, 5
#: The band of a negative's score, in hundredths of the positive's.
LEAST_PART, MOST_PART = 80, 100
#: Anchors that are sent to tasks at a time, and candidates of one packed integer.
ANCHORS, PACKED = 4096, 4096

_BEST = "anchor long, slot int, key long, vec_id long, score long"


def whole(vectors: DataFrame) -> DataFrame:
    """``key``, ``vec_id``, ``label``, ``parts``: the rows that take part, with whole components."""
    number = F.col("embedding")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where(F.col("label").isNotNull() & number.isNotNull() & finite)
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    return usable.select(
        F.monotonically_increasing_id().alias("key"), vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(number, lambda x: F.floor(SCALE * x.cast("double"))).alias("parts"),
    )


class Packed:
    """Candidates packed by component, and products with an anchor."""

    def __init__(self, parts: np.ndarray, bias: int, bits: int) -> None:
        self.n, self.bias, self.kind = len(parts), bias, f"<u{bits // 8}"
        self.wide = [int.from_bytes((column + bias).astype(self.kind).tobytes(), "little") for column in parts.T]
        # Lifts all fields above zero, so that a negative product borrows nothing from its neighbour.
        self.half = 1 << (bits - 1)
        self.lift = int.from_bytes(np.full(self.n, self.half, self.kind).tobytes(), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        total = self.lift
        for part, wide in zip(anchor, self.wide):
            if part:
                total += part * wide
        fields = np.frombuffer(total.to_bytes(self.lift_bytes, "little"), self.kind)
        return (fields - np.array(self.half, self.kind)).view(self.kind.replace("u", "i")).astype(np.int64) - self.bias * sum(anchor)

    @property
    def lift_bytes(self) -> int:
        return self.n * int(self.kind[2:])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, zeros behind short ones."""
    lists = column.cast(pa.large_list(pa.int64()))
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def field_bits(width: int, largest: int) -> int:
    """Bits of a field that holds every product of biased candidates and anchors."""
    most = max(width, 1) * largest * (2 * largest + 1)
    if most >= 1 << 63:
        raise OverflowError(f"inner products of {width} components up to {largest} do not fit in a long")
    return 32 if most < 1 << 31 else 64


def _first(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` of the places ``at`` with the highest scores, ties by id and key."""
    if len(at) > n:
        least = np.partition(scores[at], len(at) - n)[len(at) - n]
        at = at[scores[at] >= least]
    return at[np.lexsort((keys[at], ids[at], -scores[at]))][:n]


class _Best:
    """The best rows of every (anchor, slot) that a task has seen."""

    def __init__(self, n: int) -> None:
        self.n, self.held = n, {}

    def least(self, slot: tuple[int, int]) -> int | None:
        held = self.held.get(slot)
        return held[0][-1] if held is not None and len(held[0]) == self.n else None

    def add(self, slot: tuple[int, int], scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> None:
        at = _first(scores, ids, keys, at, self.n)
        new = (scores[at], ids[at], keys[at])
        if slot in self.held:
            new = tuple(map(np.concatenate, zip(self.held[slot], new)))
            order = np.lexsort((new[2], new[1], -new[0]))[: self.n]
            new = tuple(a[order] for a in new)
        self.held[slot] = new

    def rows(self) -> pa.RecordBatch:
        sizes = [len(held[0]) for held in self.held.values()]
        slots = np.repeat(np.array(list(self.held), np.int64).reshape(-1, 2), sizes, axis=0)
        scores, ids, keys = (np.concatenate(x) for x in zip(*self.held.values())) if self.held else (np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_pydict({
            "anchor": slots[:, 0], "slot": slots[:, 1].astype(np.int32), "key": keys, "vec_id": pa.array(ids, mask=ids == _NO_ID), "score": scores,
        })


#: Stands for a null id, behind all others.
_NO_ID = np.iinfo(np.int64).max


def _passed(rows: DataFrame, shape: tuple[int, int], anchors: list[tuple], kept: int, choose: Callable) -> DataFrame:
    """The best rows of every slot of the anchors; ``choose`` gives (slot, least, most, of the same label) of an anchor."""
    width, bias = shape
    bits = field_bits(width, bias)
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(kept)
        for batch in batches:
            for start in range(0, len(batch), PACKED):
                part = batch.slice(start, PACKED)
                packed = Packed(_matrix(part.column("parts"), width), bias, bits)
                keys, labels = part.column("key").to_numpy(), part.column("label").to_numpy()
                ids = part.column("vec_id").fill_null(_NO_ID).to_numpy()
                for key, label, parts, bands in sent.value:
                    scores, same = packed.scores(parts), labels == label
                    for slot, least, most, alike in choose(bands):
                        ask = (same & (keys != key)) if alike else ~same
                        floor = best.least((key, slot))
                        if least is not None:
                            ask &= (scores >= least) & (scores <= most)
                        if floor is not None:
                            ask &= scores >= floor
                        at = np.flatnonzero(ask)
                        if len(at):
                            best.add((key, slot), scores, ids, keys, at)
        yield best.rows()

    found = rows.mapInArrow(run, _BEST)
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key"))
    return found.withColumn("rank", place).where(F.col("rank") <= kept)


def _anchors(rows: DataFrame, block: int, blocks: int, every: int) -> list[tuple]:
    """Key, label and components of the anchors of one block, which bounds what comes to the driver."""
    own = rows.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)).orderBy("key")
    return [(r["key"], r["label"], list(r["parts"]), []) for r in own.select("key", "label", "parts").toLocalIterator()]


def mine(vectors: DataFrame, every: int = 100, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores; anchors are the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = stored(whole(vectors), "vectors")
    size, width, largest = rows.agg(
        F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("parts")),
        F.max(F.array_max(F.transform("parts", F.abs))),
    ).first()
    shape, blocks = (width or 0, largest or 0), max(-(-size // anchors), 1)
    field_bits(*shape)
    path = scratch_path(spark, "hard-negatives")
    for block in range(blocks):
        _block(rows, shape, _anchors(rows, block, blocks, every)).write.parquet(f"{path}/block={block}")
    return spark.read.schema(_MINED).parquet(*[f"{path}/block={block}" for block in range(blocks)])


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _block(rows: DataFrame, shape: tuple[int, int], anchors: list[tuple]) -> DataFrame:
    positives = stored(_passed(rows, shape, anchors, POSITIVES, lambda _: [(0, None, None, True)]), "positives")
    bands: dict[int, list] = {}
    # At most POSITIVES rows per anchor of the block.
    for r in positives.select("anchor", "rank", "score").collect():
        bands.setdefault(r["anchor"], []).append((r["rank"], -(-LEAST_PART * r["score"] // 100), MOST_PART * r["score"] // 100, False))
    asked = [(key, label, parts, bands.get(key, [])) for key, label, parts, _ in anchors]
    negatives = _passed(rows, shape, asked, NEGATIVES, lambda own: own)
    ids = rows.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    of = positives.join(ids, "anchor").select("anchor", F.col("rank").alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
