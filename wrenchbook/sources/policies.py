"""Reader of Markdown policy directories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchbook.functions.text import is_blank, strip

# Where the document id stands, and the address of an ingested file.
DOCUMENT_ID = r"(?i)<!--\s*document_id:\s*([a-z0-9-]+)\s*-->"
TITLE = r"(?m)^#[^\S\n]+(\S.*?)\s*$"
SOURCE_PREFIX = "policy://synthetic/"


@dataclass(frozen=True)
class PolicyFiles:
    documents: DataFrame
    rejects: DataFrame


def _checked(lines: DataFrame) -> PolicyFiles:
    """Whole files as documents, or as rejects with the field that is missing."""
    files = (
        lines.select(F.col("value").alias("markdown"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"))
        .select(
            F.nullif(F.regexp_extract("markdown", DOCUMENT_ID, 1), F.lit("")).alias("document_key"),
            strip(F.try_element_at(F.regexp_extract_all("markdown", F.lit(TITLE), F.lit(1)), F.lit(-1))).alias("title"),
            "markdown",
            F.concat(F.lit(SOURCE_PREFIX), "file_name").alias("source_uri"),
            "file_name",
        )
    )
    reason = F.when(F.col("document_key").isNull(), "document_id").when(is_blank(F.col("title")), "title")
    checked = files.withColumn("reason", reason)
    return PolicyFiles(
        checked.filter(F.col("reason").isNull()).drop("reason", "file_name"),
        checked.filter(F.col("reason").isNotNull()).select("file_name", "reason"),
    )


def read_policies(spark: SparkSession, directory: str, pattern: str = "*.md") -> PolicyFiles:
    """Every file of the pattern, at any depth, as one document; files without id or H1 go to the rejects.

    A missing directory gives no documents.
    """
    schema = "document_key string, title string, markdown string, source_uri string, file_name string"
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        empty = spark.createDataFrame([], schema)
        return PolicyFiles(empty.drop("file_name"), empty.select("file_name", F.lit("").alias("reason")))
    return _checked(spark.read.option("recursiveFileLookup", True).text(directory, wholetext=True, pathGlobFilter=pattern))


def stream_policies(spark: SparkSession, directory: str, pattern: str = "*.md", files_per_trigger: int = 1000) -> PolicyFiles:
    """The same two tables as streams of the files that come into the directory, each file once."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return _checked(reader.text(directory, wholetext=True, pathGlobFilter=pattern))
