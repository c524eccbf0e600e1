"""Append-only sinks: rows are added and never changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

BATCH = "batch_id"


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ("tenant_id",)) -> None:
    """Adds rows below ``path``, one folder per partition value."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_or_empty(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the schema of ``df``, or no rows when nothing was written yet."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return df.limit(0)


def append_batch(df: DataFrame, path: str, batch: int, partition_by: Sequence[str] = ()) -> None:
    """Writes one micro-batch into a folder of its own.

    A batch that runs again after a failure replaces its own folder and nothing
    else, so that every row is stored once.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{BATCH}={batch}")


def earlier_batches(df: DataFrame, path: str, batch: int) -> DataFrame:
    """Rows of all batches before this one."""
    schema = T.StructType([*df.schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        stored = df.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return df.limit(0)
    return stored.filter(F.col(BATCH) < batch).drop(BATCH)


def insert_only_writer(path: str, key: Sequence[str], prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores prepared rows whose key is not there yet."""

    def write(batch_df: DataFrame, batch: int) -> None:
        rows = prepare(batch_df)
        fresh = rows.join(earlier_batches(rows, path, batch).select(*key), list(key), "left_anti")
        append_batch(fresh.select(*rows.columns), path, batch)

    return write
