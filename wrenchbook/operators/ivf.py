"""Inverted-file vector search: cells around learned centroids, several cells probed per query, exact distances inside.

Centroids are learned on a bounded sample. Vectors are dealt out by tenant and nearest cell and can be written that way,
so a search reads the cells that it probes. How many cells a query has to probe depends on the data: the number is
calibrated on a bounded sample of queries, whose exact hits tell in which of their nearest cells they are. Vectors in clusters need a few
cells, vectors without any structure need most of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchbook.operators.nearest import matrix, nearest
from wrenchbook.operators.retrieve import CANDIDATES, MAX_DISTANCE, dealt, vector_topk

#: Vectors that centroids are learned on, and queries that the number of probes is calibrated on.
LEARNED, CALIBRATED = 65_536, 256
#: Share of the exact hits of the calibration queries that the probed cells must hold.
RECALL = 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Unit centroids, one per row, and the vectors with their ``cell``."""

    centroids: np.ndarray
    vectors: DataFrame

    def write(self, path: str) -> VectorIndex:
        """Writes the cells as folders and the centroids beside them; ``read_index`` reads both back."""
        spark = self.vectors.sparkSession
        # The hash of the id splits a crowded cell among tasks.
        dealt = self.vectors.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
        dealt.sortWithinPartitions("cell", "tenant_id").write.partitionBy("cell").parquet(f"{path}/vectors")
        rows = [(at, row.tolist()) for at, row in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return VectorIndex(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/vectors"))


def _unit(df: DataFrame) -> DataFrame:
    """Rows with a usable vector: not null, finite, of a positive length."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.where(F.col("embedding").isNotNull() & (norm > 0) & (norm < float("inf")))


def _learned(vectors: DataFrame, cells: int, sample: int, seed: int) -> np.ndarray:
    few = vectors.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(sample)
    points = few.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")).repartition(8)
    n = points.count()
    if not n:
        return np.empty((0, 0))
    model = KMeans(k=min(cells, n), maxIter=10, seed=seed, distanceMeasure="cosine").fit(points) if n > 1 else None
    centers = np.array(model.clusterCenters() if model else [points.first()["features"].toArray()])
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def _with_cells(rows: DataFrame, centroids: np.ndarray, count: int, ids: Sequence[str], listed: bool = False) -> DataFrame:
    """Every row once for each of its ``count`` nearest cells, with ``cell`` and its ``place`` among them; ``listed``: once, with all as ``cells``."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = np.argsort(-(matrix(batch.column("embedding")) @ sent.value.T), axis=1, kind="stable")[:, :count]
            if listed:
                ends = np.arange(len(batch) + 1, dtype=np.int32) * near.shape[1]
                yield batch.append_column("cells", pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel(), pa.int64())))
                continue
            again = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
            columns = {name: batch.column(name).take(again) for name in batch.schema.names}
            yield pa.RecordBatch.from_pydict({**columns, "cell": near.ravel().astype(np.int32), "place": np.tile(np.arange(near.shape[1], dtype=np.int32), len(batch))})

    chosen = rows.select(*ids, "embedding")
    if not centroids.size:
        return chosen.limit(0).withColumns({"cells": F.array().cast("array<long>")} if listed else {"cell": F.lit(0), "place": F.lit(0)})
    more = ["cells array<bigint>"] if listed else ["cell int", "place int"]
    return chosen.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema), *more]))


_IDS = ("tenant_id", "document_key", "ordinal", "chunk_id")


def vector_index(vectors: DataFrame, cells: int = 1024, sample: int = LEARNED, seed: int = 7) -> VectorIndex:
    """Cells over the vectors of all tenants (``tenant_id``, ``document_key``, ``ordinal``, ``chunk_id``, ``embedding``).

    Centroids are learned on at most ``sample`` vectors, those with the least hashes of their ids; every vector is indexed.
    Vectors that are null or of length zero have no direction and are left out.
    """
    usable = _unit(vectors)
    centroids = _learned(usable, cells, sample, seed)
    return VectorIndex(centroids, _with_cells(usable, centroids, 1, _IDS).drop("place"))


def probes_for(
    queries: DataFrame, index: VectorIndex, k: int = CANDIDATES, max_distance: float = MAX_DISTANCE, recall: float = RECALL, sample: int = CALIBRATED
) -> int:
    """How many of its nearest cells a query must probe, by the exact hits of a sample of the queries."""
    few = _unit(queries).orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "tenant_id", "embedding")
    hits = vector_topk(few, index.vectors, k, max_distance).select("query_id", "tenant_id", "chunk_id")
    cells = index.vectors.select("tenant_id", "chunk_id", "cell")
    order = _with_cells(few, index.centroids, len(index.centroids), ("query_id", "tenant_id")).select("query_id", "cell", "place")
    places = hits.join(cells, ["tenant_id", "chunk_id"]).join(order, ["query_id", "cell"]).groupBy("place").count()
    # One row per cell at most.
    found = sorted((r["place"], r["count"]) for r in places.collect())
    needed, seen = recall * sum(n for _, n in found), 0
    for place, n in found:
        seen += n
        if seen >= needed:
            return place + 1
    return 1


def probed(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """``query_id``, ``tenant_id``, ``embedding`` and ``cell``, a row for each cell that a query probes."""
    # Lists come from Python, so that a count of cells carries no vector for each of them.
    listed = _with_cells(_unit(queries), index.centroids, probes, ("query_id", "tenant_id"), listed=True)
    return listed.select("query_id", "tenant_id", "embedding", F.explode(F.col("cells").cast("array<int>")).alias("cell"))


def pairs_met(asked: DataFrame, index: VectorIndex) -> DataFrame:
    """``pairs_met``: how many distances a search computes, counted by cells."""
    sizes = index.vectors.groupBy("tenant_id", "cell").agg(F.count(F.lit(1)).alias("vectors"))
    per_cell = asked.groupBy("tenant_id", "cell").agg(F.count(F.lit(1)).alias("queries"))
    return per_cell.join(sizes, ["tenant_id", "cell"]).agg(F.coalesce(F.sum(F.col("queries") * F.col("vectors")), F.lit(0)).alias("pairs_met"))


def vector_topk_ivf(
    queries: DataFrame, index: VectorIndex, probes: int | None = None, k: int = CANDIDATES, max_distance: float = MAX_DISTANCE, block_rows: int = 2048
) -> DataFrame:
    """Best ``k`` vectors per query among the probed cells, with exact distances; ties as in ``vector_topk``.

    Queries keep the list of their cells, so a vector passes them once and meets those that probe its cell.
    """
    probes = probes or probes_for(queries, index, k, max_distance)
    usable = _unit(queries)
    parts, shares = dealt(usable, 1 << 20)
    asked = _with_cells(usable, index.centroids, probes, ("query_id", "tenant_id"), listed=True)
    corpus = index.vectors.withColumn("cells", F.array(F.col("cell").cast("long")))
    near = nearest(asked, corpus, k, max_distance, parts, shares, block_rows, in_cells=True)
    order = Window.partitionBy("query_id").orderBy("distance", "document_key", "ordinal", "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
