"""Keyword index that is written once: impact-ordered blocks of postings, and BM25+ search that skips what cannot matter.

The chunks of a tenant are dealt out to shards of about ``SHARD``. A block holds the postings of one term in one shard, by
falling impact, and its first impact bounds the others. A search joins the blocks of the terms that are asked for, each
block once for all queries of a tenant, and scores a shard at a time. Terms come by falling bound; as soon as the
bounds of the rest cannot lift another chunk over the k-th score, only chunks that can still get there go on.
No plan needs figures on the driver: an index is read, joined and ranked in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchbook.functions.text import is_blank, search_tokens
from wrenchbook.operators.retrieve import B, CANDIDATES, DELTA, K1, SCORE_DIGITS, Tokenizer, term_counts
from wrenchbook.session import scratch_path

#: Chunks of a shard and queries that meet it at once, about.
SHARD, TOGETHER = 8192, 1024

_PLACE = ["tenant_id", "document_key", "ordinal", "chunk_id"]
_WRITTEN = (
    "tenant_id string, shard int, term string, n int, bound double, places binary, impacts binary, "
    "place int, document_key string, ordinal int, chunk_id string"
)


@dataclass(frozen=True)
class Postings:
    """``blocks`` (tenant_id, shard, term, n, bound, places, impacts), ``chunks`` (their places) and ``tenants`` (their figures)."""

    blocks: DataFrame
    chunks: DataFrame
    tenants: DataFrame


def _blocks(shard: pa.Table) -> pa.Table:
    """One row per term of a shard, and one per chunk, whose places follow the order of ties."""
    tenant, number, mean = (shard.column(c)[0].as_py() for c in ("tenant_id", "shard", "mean_length"))
    shard = shard.sort_by([(c, "ascending") for c in _PLACE[1:]]).combine_chunks()
    counts = shard.column("counts").combine_chunks()
    per, flat = counts.value_lengths().to_numpy(), counts.flatten()
    place = np.repeat(np.arange(len(shard), dtype=np.int32), per)
    tf = flat.field("tf").to_numpy().astype(np.float64)
    norm = K1 * (1 - B + B * shard.column("length").to_numpy() / (mean or 1.0))
    impact = tf * (K1 + 1) / (norm[place] + tf)
    words = flat.field("term").dictionary_encode()
    code = words.indices.to_numpy()
    order = np.lexsort((place, -impact, code))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0])) if len(order) else np.empty(0, np.int64)
    ends = np.append(starts, len(order)).astype(np.int32)
    place, impact = place[order], impact[order]
    n, more = len(starts), len(shard)

    def packed(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * values.itemsize).tobytes()), pa.py_buffer(values.tobytes())])

    def beside(blocks: pa.Array | None, chunks: pa.Array | None, kind: pa.DataType) -> pa.ChunkedArray:
        return pa.chunked_array([pa.nulls(n, kind) if blocks is None else blocks.cast(kind), pa.nulls(more, kind) if chunks is None else chunks.cast(kind)])

    ids = {c: shard.column(c).combine_chunks() for c in _PLACE[1:]}
    return pa.table({
        "tenant_id": pa.array([tenant] * (n + more), pa.string()), "shard": pa.array([number] * (n + more), pa.int32()),
        "term": beside(words.dictionary.take(pa.array(code[order][starts])), None, pa.string()),
        "n": beside(pa.array(np.diff(ends)), None, pa.int32()), "bound": beside(pa.array(impact[starts]), None, pa.float64()),
        "places": beside(packed(place), None, pa.binary()), "impacts": beside(packed(impact), None, pa.binary()),
        "place": beside(None, pa.array(np.arange(more, dtype=np.int32)), pa.int32()),
        **{c: beside(None, ids[c], kind) for c, kind in zip(_PLACE[1:], (pa.string(), pa.int32(), pa.string()))},
    })


def write_postings(chunks: DataFrame, path: str, tokenize: Tokenizer = search_tokens, shard: int = SHARD) -> Postings:
    """Indexes title, section and text of the chunks of every tenant, and writes the index to ``path``."""
    spark = chunks.sparkSession
    tokens = tokenize(F.concat_ws(" ", "title", "section", "text"))
    chunks.select(*_PLACE, tokens.alias("t")).select(*_PLACE, F.size("t").alias("length"), term_counts(F.col("t")).alias("counts")).write.parquet(f"{path}/counted")
    counted = spark.read.parquet(f"{path}/counted")
    counted.groupBy("tenant_id").agg(F.count("*").alias("chunks"), F.avg("length").alias("mean_length")).coalesce(1).write.parquet(f"{path}/tenants")
    tenants = spark.read.parquet(f"{path}/tenants")
    # A large tenant has many shards, so no group grows with it.
    number = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("chunks") / shard)).cast("int")
    placed = counted.join(tenants, "tenant_id").withColumn("shard", number).select(*_PLACE, "length", "counts", "mean_length", "shard")
    placed.groupBy("tenant_id", "shard").applyInArrow(_blocks, _WRITTEN).withColumn("is_chunk", F.col("term").isNull()).write.partitionBy("is_chunk").parquet(f"{path}/postings")
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    written = spark.read.schema(f"{_WRITTEN}, is_chunk boolean").parquet(f"{path}/postings")
    blocks = written.where("NOT is_chunk").select("tenant_id", "shard", "term", "n", "bound", "places", "impacts")
    return Postings(blocks, written.where("is_chunk").select("tenant_id", "shard", "place", *_PLACE[1:]), spark.read.parquet(f"{path}/tenants"))


#: Indexes of this application by source, so that a second search reads what the first one wrote.
_SAVED: dict[tuple[str, ...], str] = {}


def saved_postings(chunks: DataFrame, source: str) -> Postings:
    """The index of ``chunks``, written on first use; ``source`` names their content, files and their times included."""
    spark = chunks.sparkSession
    key = (spark.sparkContext.applicationId, source)
    if key not in _SAVED:
        path = scratch_path(spark, "postings")
        write_postings(chunks, path)
        _SAVED[key] = path
    return read_postings(spark, _SAVED[key])


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` highest scores, of equal ones the first places."""
    shown = np.round(scores, SCORE_DIGITS)
    if len(shown) > k:
        least = np.partition(shown, len(shown) - k)[len(shown) - k]
        keep = shown >= least
        shown, places, scores = shown[keep], places[keep], scores[keep]
    order = np.lexsort((places, -shown))[:k]
    return np.stack([places[order].astype(np.float64), scores[order]])


def score_shard(parts: list[tuple[float, np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, int]:
    """Places and sums of the best ``k`` chunks, from (weight, places, impacts) of the terms, and the postings that were added."""
    parts = sorted(parts, key=lambda p: -p[0] * p[2][0])
    rest = np.append(np.cumsum([p[0] * p[2][0] for p in parts][::-1])[::-1], 0.0)
    sums, open_places, added = np.zeros(size), None, 0
    for at, (weight, places, impacts) in enumerate(parts):
        # Looked at ahead of a long list: sums only grow, so the k-th of now bounds the last one.
        if at and size > k and len(places) > size // 16:
            least = np.partition(sums, size - k)[size - k] - 10.0**-SCORE_DIGITS
            if least > rest[at]:
                open_places = sums + rest[at] >= least
        if open_places is not None:
            inside = open_places[places]
            places, impacts = places[inside], impacts[inside]
        sums[places] += weight * impacts
        added += len(places)
    found = np.flatnonzero(sums > 0) if open_places is None else np.flatnonzero((sums > 0) & open_places)
    return np.stack([found.astype(np.float64), sums[found]]), added


def _scorer(k: int):
    def run(met: pa.Table) -> pa.Table:
        size, parts, floors = 0, {}, {}
        for row in met.select(["places", "impacts", "asked"]).to_pylist():
            places, impacts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["impacts"], np.float64)
            size = max(size, int(places.max()) + 1)
            for q in row["asked"]:
                parts.setdefault(q["query_id"], []).append((q["weight"], places, impacts))
                floors[q["query_id"]] = q["floor"]
        out = []
        for query, own in parts.items():
            (places, sums), _ = score_shard(own, size, k)
            out.append((query, *_best(sums + floors[query], places, k)))
        sizes = [len(p) for _, p, _ in out]
        n, tenant, shard = sum(sizes), met.column("tenant_id")[0].as_py(), met.column("shard")[0].as_py()
        flat = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in (1, 2)]
        return pa.table({
            "query_id": pa.array([q for (q, _, _), size in zip(out, sizes) for _ in range(size)], pa.string()), "tenant_id": pa.array([tenant] * n, pa.string()),
            "shard": pa.array([shard] * n, pa.int32()), "place": pa.array(flat[0].astype(np.int32)), "score": pa.array(flat[1]),
        })

    return run


def query_terms(queries: DataFrame, tokenize: Tokenizer = search_tokens) -> DataFrame:
    """Distinct terms of each query with their multiplicity; blank queries have none."""
    tokens = queries.filter(~is_blank(F.col("query"))).select("query_id", "tenant_id", tokenize(F.col("query")).alias("t"))
    return tokens.select("query_id", "tenant_id", F.explode(term_counts(F.col("t"))).alias("c")).select("query_id", "tenant_id", "c.term", F.col("c.tf").alias("times"))


def search(queries: DataFrame, index: Postings, k: int = CANDIDATES, pad: bool = True, tokenize: Tokenizer = search_tokens, together: int = TOGETHER) -> DataFrame:
    """Best ``k`` chunks per query by BM25+, as :func:`retrieve.bm25_search` ranks them.

    Queries (query_id, tenant_id, query) of a tenant are dealt out to groups of about ``together``, so the
    queries that meet a shard are as bounded as the shard.
    """
    terms = query_terms(queries, tokenize)
    asked = terms.select("tenant_id", "term").distinct()
    df = index.blocks.select("tenant_id", "term", "n").join(asked, ["tenant_id", "term"], "left_semi").groupBy("tenant_id", "term").agg(F.sum("n").alias("df"))
    weight = F.col("times") * F.log((F.col("chunks") + 1) / F.col("df"))
    weighted = terms.join(df, ["tenant_id", "term"]).join(index.tenants, "tenant_id").select("query_id", "tenant_id", "term", weight.alias("weight"))
    floors = weighted.groupBy("query_id", "tenant_id").agg(F.sum(F.col("weight") * DELTA).alias("floor"))
    groups = queries.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / together).alias("groups"))
    per_query = weighted.join(floors, ["query_id", "tenant_id"]).join(groups, "tenant_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("groups")))
    per_term = per_query.groupBy("tenant_id", "term", "part").agg(F.collect_list(F.struct("query_id", "weight", "floor")).alias("asked"))
    met = index.blocks.join(per_term, ["tenant_id", "term"]).select("tenant_id", "shard", "part", "places", "impacts", "asked")
    scored = met.groupBy("tenant_id", "shard", "part").applyInArrow(_scorer(k), "query_id string, tenant_id string, shard int, place int, score double")
    columns = ["query_id", *_PLACE]
    ranked = scored.join(index.chunks, ["tenant_id", "shard", "place"]).select(*columns, F.round("score", SCORE_DIGITS).alias("score"))
    if pad:
        first = Window.partitionBy("tenant_id").orderBy(*_PLACE[1:])
        heads = index.chunks.select(*_PLACE, F.row_number().over(first).alias("at")).where(F.col("at") <= k).drop("at")
        ranked = ranked.unionByName(floors.join(heads, "tenant_id").select(*columns, F.round("floor", SCORE_DIGITS).alias("score")).where("score > 0"))
        # Of equal chunks the matched one has the higher score.
        ranked = ranked.groupBy(*columns).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *_PLACE[1:])
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
