"""What several operators of this package share: row keys, scratch tables, words and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchbook.session import scratch_path

# Odd 64-bit multipliers of the mixing steps.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_C = np.uint64(0x165667B19E3779F9)

# A row key is the number of its file and the place in it, in so many bits each.
FILE_BITS, PLACE_BITS = 33, 30


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: a cut of the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_salt(df: DataFrame) -> int | None:
    """A salt that gives each file of a plain scan a number of its own; None for other plans."""
    plan = df._jdf.queryExecution().analyzed()
    if "_metadata" in df.columns or not plan.deterministic():
        return None
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    files = df.inputFiles() if plan.nodeName() == "LogicalRelation" else []
    if not files:
        return None
    paths = df.sparkSession.createDataFrame([(f,) for f in files], "path string")
    for salt in range(16):
        if paths.agg(F.count_distinct(_file_number(F.col("path"), salt)) == len(files)).first()[0]:
            return salt
    return None


def _file_number(path: Column, salt: int) -> Column:
    # Paths are written with one slash or three behind the scheme.
    plain = F.ltrim(F.substring_index(path, ":", -1), F.lit("/"))
    return F.pmod(F.xxhash64(plain, F.lit(salt)), F.lit(1 << FILE_BITS))


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A key per row that is the same in every job, however the table is split among tasks.

    A scan, also with columns computed or rows filtered, tells file and place of each row; anything else is written once with its keys.
    """
    salt = _file_salt(df)
    if salt is None:
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "keyed")
    number = _file_number(F.col("_metadata.file_path"), salt)
    return df.withColumn(name, F.shiftleft(number, PLACE_BITS).bitwiseOR(F.col("_metadata.row_index")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over the whole range; equal values stay equal."""
    x = values * MIX_A
    x ^= x >> np.uint64(29)
    x *= MIX_B
    return x ^ (x >> np.uint64(32))


def windows_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` neighbours."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= MIX_C
        out += hashes[k : n + k]
        out ^= out >> np.uint64(31)
    return mixed(out)


def give_back() -> None:
    """Returns to the system what this worker has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes of text, so that work arrays stay small."""
    give_back()
    for batch in batches:
        bytes_each = max(batch.column(column).nbytes // max(len(batch), 1), 1)
        rows = max(size // bytes_each, 1)
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
    # A worker that waits for its next task keeps nothing of this one.
    give_back()


def with_text(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of whole rows with one of their fields beside them, without a copy."""
    for batch in batches:
        yield batch.append_column(column, batch.column("row").field(column))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
