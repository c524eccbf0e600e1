"""Embedding vectors: validation, deterministic vectors, upsert and backlog runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcome codes of an embedding attempt.
UNKNOWN_ERROR_CODE = "EMBEDDING_PROVIDER_UNAVAILABLE"
INVALID_VECTOR_CODE = "EMBEDDING_VECTOR_INVALID"
MISSING_CHUNK_CODE = "EMBEDDING_CHUNK_MISSING"
RETRY_MINUTES = 5


class EmbeddingFailure(Exception):
    """Raised by an embedding function for a whole batch."""

    def __init__(self, code: str, retryable: bool):
        super().__init__(code)
        self.code = code
        self.retryable = retryable


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def normalize(df: DataFrame, dimensions: int, column: str = "embedding") -> DataFrame:
    """Adds ``reason`` (NULL when valid) and replaces the vector by its unit vector, or NULL."""
    raw = F.transform(F.col(column), lambda x: x.cast("double"))
    out = df.withColumn("_raw", raw).withColumn("_norm", _norm(F.col("_raw")))
    not_finite = F.exists("_raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    reason = (
        F.when(F.col("_raw").isNull(), "missing")
        .when(F.size("_raw") != dimensions, "dimensions")
        .when(not_finite, "not_finite")
        .when((F.col("_norm") == 0) | (F.col("_norm") == F.lit(float("inf"))), "norm")
    )
    return (
        out.withColumn("reason", reason)
        .withColumn(column, F.when(F.col("reason").isNull(), F.transform("_raw", lambda x: x / F.col("_norm"))))
        .drop("_raw", "_norm")
    )


def hash_vectors(texts: Sequence[str], dimensions: int) -> np.ndarray:
    """SHAKE-256 of each text as big-endian 32-bit numbers, scaled to [-1, 1) and normalised."""
    digests = b"".join(hashlib.shake_256(t.encode("utf-8")).digest(dimensions * 4) for t in texts)
    numbers = np.frombuffer(digests, dtype=">u4").reshape(len(texts), dimensions).astype(np.float64)
    scaled = numbers / 2.0**31 - 1.0
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def hash_embed(df: DataFrame, dimensions: int, text: str = "text", name: str = "embedding") -> DataFrame:
    """Adds a deterministic unit vector of the text."""

    @F.pandas_udf("array<double>")
    def vectors(column: pd.Series) -> pd.Series:
        if len(column) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(hash_vectors([t or "" for t in column], dimensions)))

    return df.withColumn(name, vectors(F.col(text)))


def upsert_vectors(existing: DataFrame, new: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vector table after an upsert by (tenant, chunk, model); the latest one wins.

    A new vector is refused when its content hash is not that of the chunk.
    """
    key = ["tenant_id", "chunk_id", "model_key"]
    fresh = new.join(
        chunks.select("tenant_id", "chunk_id", "content_hash"), ["tenant_id", "chunk_id", "content_hash"], "left_semi"
    )
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.select(*existing.columns).withColumn("_new", F.lit(1)))
    winner = F.max_by(F.struct(*existing.columns), F.struct("_new", "embedded_at", "content_hash"))
    return both.groupBy(*key).agg(winner.alias("_row")).select("_row.*")


def embed_backlog(
    jobs: DataFrame,
    chunks: DataFrame,
    embed: Callable[[list[str]], Sequence[Sequence[float]]],
    dimensions: int,
    batch_rows: int = 64,
) -> DataFrame:
    """Runs ``embed`` over the pending jobs and reports one outcome per job.

    A failing batch is repeated row by row, so that one bad text does not decide
    for its neighbours. Outcomes: SUCCEEDED with a vector, RETRY or FAILED with a code.
    A job whose chunk is missing fails without a call. Each task streams over its
    partition; nothing is gathered.
    """
    wanted = chunks.select("tenant_id", "chunk_id", "content_hash", "text", F.lit(True).alias("there"))
    work = jobs.join(wanted, ["tenant_id", "chunk_id"], "left").select(
        "tenant_id", "job_id", "chunk_id", "model_key", "content_hash", "text", F.coalesce("there", F.lit(False)).alias("there")
    )

    def outcome(texts: list[str]) -> list[tuple[str, str | None, list[float] | None]]:
        try:
            vectors = np.asarray(embed(texts), dtype=np.float64)
        except EmbeddingFailure as failure:
            if len(texts) > 1:
                return [outcome([t])[0] for t in texts]
            return [("RETRY" if failure.retryable else "FAILED", failure.code, None)]
        except Exception:  # noqa: BLE001 - an unknown fault is retried
            if len(texts) > 1:
                return [outcome([t])[0] for t in texts]
            return [("RETRY", UNKNOWN_ERROR_CODE, None)]
        if vectors.shape != (len(texts), dimensions):
            return [("FAILED", INVALID_VECTOR_CODE, None) for _ in texts]
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        return [
            ("SUCCEEDED", None, list(v / n)) if np.isfinite(n) and n > 0 else ("FAILED", INVALID_VECTOR_CODE, None)
            for v, n in zip(vectors, norms)
        ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows]
                texts = part["text"][part["there"]].tolist()
                called = iter(outcome(texts) if texts else [])
                results = [next(called) if there else ("FAILED", MISSING_CHUNK_CODE, None) for there in part["there"]]
                yield part.drop(columns=["text", "there"]).assign(
                    outcome=[r[0] for r in results], error_code=[r[1] for r in results], embedding=[r[2] for r in results]
                )

    return work.mapInPandas(
        run,
        "tenant_id string, job_id string, chunk_id string, model_key string, content_hash string, "
        "outcome string, error_code string, embedding array<double>",
    )
