"""Ordered computations per key that survive one very long key.

A window over ``keys`` sends all rows of a key to one task. Here the key is cut
into calendar segments first: rows meet only inside (key, segment), and a
summary with one row per segment carries values across the cuts. The longest
group is then the busiest interval of one key, not the key, and the second
window sees at most one row per interval. Choose ``grain`` so that the busiest
interval of the busiest key fits one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.session import scratch_path

SEGMENT = "_segment"
#: Rows of a segment of equal size as a power of two, and segments of a node above them.
SEGMENT_BITS, FAN = 12, 1024


def in_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], bits: int = SEGMENT_BITS) -> DataFrame:
    """``df`` with segment numbers that rise along ``order`` inside a key; a segment holds 2 ** ``bits`` rows at most.

    The table is sorted by ranges, which cut a key wherever it is long, and written once with the
    numbers, as another run of the sort may cut elsewhere. ``order`` must be unique within a key.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = ordered.withColumn(SEGMENT, F.shiftright(F.monotonically_increasing_id(), bits))
    path = scratch_path(spark, "segments")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", bits: int = SEGMENT_BITS) -> DataFrame:
    """Adds the place of each row in its key, from 1: places inside a segment, behind the rows of earlier segments.

    A window sees the rows of one segment, or one row per segment of a node, or one row per node of a key.
    """
    cut = in_segments(df, keys, order, bits)
    node = F.floor(F.col(SEGMENT) / FAN).alias("_node")
    sizes = cut.groupBy(*keys, SEGMENT, node).agg(F.count(F.lit(1)).alias("_rows"))

    def before(rows: DataFrame, groups: list[str], by: str, amount: str, into: str) -> DataFrame:
        earlier = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(into, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))

    nodes = before(sizes.groupBy(*keys, "_node").agg(F.sum("_rows").alias("_all")), list(keys), "_node", "_all", "_ahead")
    segments = before(sizes, [*keys, "_node"], SEGMENT, "_rows", "_inside").join(nodes.select(*keys, "_node", "_ahead"), [*keys, "_node"])
    local = F.row_number().over(Window.partitionBy(*keys, SEGMENT).orderBy(*order))
    placed = cut.withColumn("_local", local).join(segments.select(*keys, SEGMENT, "_inside", "_ahead"), [*keys, SEGMENT])
    return placed.select(*df.columns, (F.col("_local") + F.col("_inside") + F.col("_ahead")).alias(name))


def scan_maps(
    segments: DataFrame, keys: Sequence[str], start: DataFrame, identity: Column, compose: Callable[[Column, Column], Column], follow: Callable[[Column, Column], Column], fan: int = FAN
) -> tuple[DataFrame, DataFrame]:
    """Start state of every segment, and end state of every key, from the maps of the segments.

    ``segments`` has the keys, a numbered segment and its ``effect``, a map from each start state to an end state.
    ``start`` has the keys and ``state``, and ``compose`` and ``follow`` say how a map is put behind another one and where it
    takes a state. Maps go up a tree: those of ``fan`` neighbours become one of their node, and the nodes of a key are
    followed from its start; then each node follows its own segments. No list is longer than ``fan`` or the nodes of a key.
    """
    node = F.floor(F.col(SEGMENT) / fan).alias("_node")
    chained = segments.groupBy(*keys, node).agg(F.array_sort(F.collect_list(F.struct(F.col(SEGMENT).alias("at"), "effect"))).alias("_chain"))
    lifted = chained.withColumn("_effect", F.aggregate("_chain", identity, lambda all_, part: compose(all_, part["effect"])))
    tops = lifted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_node").alias("at"), F.col("_effect").alias("effect")))).alias("_chain"))

    def walked(rows: DataFrame) -> DataFrame:
        kind = rows.schema["state"].dataType.simpleString()
        begin = F.struct(F.col("state").alias("state"), F.array().cast(f"array<{kind}>").alias("starts"))
        return rows.withColumn("_walk", F.aggregate(
            "_chain", begin, lambda acc, part: F.struct(follow(part["effect"], acc["state"]).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))
        ))

    def starts(rows: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.arrays_zip(F.transform("_chain", lambda part: part["at"]).alias("at"), F.col("_walk.starts").alias("state"))).alias("_p")
        return rows.select(*keys, pairs).select(*keys, F.col("_p.at").alias(name), F.col("_p.state").alias("state"))

    top = walked(tops.join(start, list(keys)))
    inner = walked(chained.join(starts(top, "_node"), [*keys, "_node"]))
    return starts(inner, SEGMENT), top.select(*keys, F.col("_walk.state").alias("state"))


def by_time(moment: str, grain: str = "day") -> Column:
    """Calendar segments of a timestamp."""
    return F.date_trunc(grain, F.col(moment)).cast("timestamp_ntz")


def by_number(position: str, width: int = 1_000_000) -> Column:
    """Segments of equal width of a number, such as an arrival sequence."""
    return F.floor(F.col(position) / F.lit(width))


def _inside(keys: Sequence[str], order: Sequence[str], descending: bool = False):
    columns = [F.col(c).desc() if descending else F.col(c) for c in order]
    return Window.partitionBy(*keys, SEGMENT).orderBy(*columns)


def _neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], name: str, segment: Column, back: bool
) -> DataFrame:
    picked = F.struct(*values)
    position = F.struct(*order)
    cut = df.withColumn(SEGMENT, segment)
    # The row next to the cut: the last one of an earlier segment, or the first one of a later segment.
    edge = F.max_by(picked, position) if back else F.min_by(picked, position)
    across = Window.partitionBy(*keys).orderBy(F.col(SEGMENT) if back else F.col(SEGMENT).desc())
    edges = (
        cut.groupBy(*keys, SEGMENT)
        .agg(edge.alias("_edge"))
        .select(*keys, SEGMENT, F.lag("_edge").over(across).alias("_carried"))
    )
    local = cut.withColumn(name, F.lag(picked).over(_inside(keys, order, descending=not back)))
    return local.join(edges, [*keys, SEGMENT], "left").select(
        *df.columns, F.coalesce(F.col(name), F.col("_carried")).alias(name)
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], segment: Column, name: str = "previous"
) -> DataFrame:
    """Adds a struct of ``values`` from the row before, NULL on the first row of a key.

    ``order`` must be unique within a key, and ``segment`` must not decrease along it.
    """
    return _neighbour(df, keys, order, values, name, segment, back=True)


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], segment: Column, name: str = "next"
) -> DataFrame:
    """Adds a struct of ``values`` from the row after, NULL on the last row of a key."""
    return _neighbour(df, keys, order, values, name, segment, back=False)


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str, segment: Column
) -> DataFrame:
    """Adds the sum of ``amount`` over all rows of the key up to and including this one.

    ``segment`` must not decrease along ``order``.
    """
    cut = df.withColumn(SEGMENT, segment).withColumn("_amount", amount)
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*keys, SEGMENT)
        .agg(F.sum("_amount").alias("_total"))
        .select(*keys, SEGMENT, F.sum("_total").over(before).alias("_before"))
    )
    running = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.withColumn("_running", F.sum("_amount").over(running))
        .join(totals, [*keys, SEGMENT], "left")
        .select(*df.columns, (F.col("_running") + F.coalesce("_before", F.lit(0))).alias(name))
    )
