"""Connected components by alternating stars: every round is two small joins and a written table.

Rows are turned round by a generator instead of a union, which would plan and scan all that is before it twice: a driver keeps
some megabytes per stage and scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.shared import stored


def _each(rows: DataFrame, names: list[str], *several: list[Column]) -> DataFrame:
    """One row per list of values for every row, without a second plan of ``rows``."""
    made = F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, values)]) for values in several])
    return rows.select(F.inline(made))


def _both(edges: DataFrame) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    return _each(edges, ["u", "v"], [u, v], [v, u])


def _to_least(pairs: DataFrame) -> DataFrame:
    """Every neighbour of a node with the least of them and the node itself."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    # Neighbours that are larger move to the least neighbour, then the smaller ones do.
    large = _to_least(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    near = _to_least(down)
    small = _each(near, ["u", "v"], [F.col("v"), F.col("m")], [F.col("u"), F.col("m")])
    return small.where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one larger end or is the lesser one of all its edges."""
    ends = _each(edges, ["node", "down", "up"], [F.col("u"), F.lit(1), F.lit(0)], [F.col("v"), F.lit(0), F.lit(1)])
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root``, the least node it is linked with; nodes without edges are not listed.

    ``edges`` has two columns of long node numbers. A round halves the depth of the trees, so a chain
    of n nodes takes about log n rounds.
    """
    u, v = edges.columns
    plain = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = stored(plain, name)
    while not _done(now):
        now = stored(_round(now), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extended(known: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """``known`` components (``node``, ``root``) after more ``edges`` between any nodes."""
    u, v = edges.columns
    upper, lower = (known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in (u, v))
    placed = edges.join(upper, u, "left").join(lower, v, "left")
    joined = components(placed.select(F.coalesce(f"{u}_root", u).alias("u"), F.coalesce(f"{v}_root", v).alias("v")), name)
    moved = known.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    new = joined.join(known.select("node"), "node", "left_anti").select("node", "root")
    return stored(moved.unionByName(new), name)
