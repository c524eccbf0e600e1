"""Versioned ingest of policy documents: sections, chunks, ids, versions, activation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.ordering import with_previous, with_running_sum
from wrenchbook.functions.text import business_key, content_hash, is_blank, nul_joined, strip, token_count, uuid5

# Chunk geometry, heading form and input limits.
CHUNK_CHARS = 500
CHUNK_OVERLAP = 50
MIN_BREAK = 200
BREAK_MARKS = "。！？；"
HEADING = r"^(#{1,3})\s+(.+?)\s*$"
MAX_KEY, MAX_TITLE, MAX_URI, MAX_SECTION, MAX_CHUNK_KEY = 160, 300, 2048, 500, 200

SECTION_TYPE = "struct<title: string, sections: array<struct<section: string, text: string>>>"
_SECTIONS = pa.struct([("title", pa.string()), ("sections", pa.list_(pa.struct([("section", pa.string()), ("text", pa.string())])))])
#: Bytes of text that a Python worker takes apart at once, whatever the size of the batches that it is sent.
WORKED_ON = 1 << 20


def markdown_sections(markdown: str) -> tuple[str, list[tuple[str, str]]]:
    """Title (the last H1) and the non-blank texts below H2 and H3 headings."""
    heading = re.compile(HEADING)
    lines = markdown.splitlines()
    marks = [(at, m) for at, m in ((at, heading.match(line)) for at, line in enumerate(lines)) if m]
    titles = {at: m.group(2).strip() for at, m in marks if len(m.group(1)) == 1}
    starts = [(at, m.group(2).strip()) for at, m in marks if len(m.group(1)) > 1]
    ends = [at for at, _ in starts[1:]] + [len(lines)]
    sections = []
    for (start, name), end in zip(starts, ends):
        body = "\n".join(lines[at] for at in range(start + 1, end) if at not in titles).strip()
        if name and body:
            sections.append((name, body))
    return (titles[max(titles)] if titles else ""), sections


def window_bounds(length: int, breaks: Sequence[int], size: int, overlap: int, min_break: int) -> Iterator[tuple[int, int]]:
    """Start and end of the windows over a text; ``breaks`` are the positions after its break marks."""
    start = end = 0
    while end < length:
        start, end = max(end - overlap, 0), max(end - overlap, 0) + size
        if end >= length:
            end = length
        elif (nearest := bisect_right(breaks, end)) and breaks[nearest - 1] > start + min_break:
            end = breaks[nearest - 1]
        yield start, end


def window_texts(text: str, size: int, overlap: int, min_break: int, marks: str) -> list[str]:
    """Overlapping windows that prefer to end after the last break mark; short text stays as it is."""
    if len(text) <= size:
        return [text]
    breaks = [m.end() for m in re.finditer(f"[{re.escape(marks)}]", text)] if marks else []
    stripped = (text[a:b].strip() for a, b in window_bounds(len(text), breaks, size, overlap, min_break))
    return [piece for piece in stripped if piece]


def text_slices(columns: Iterator[pa.Array], size: int = WORKED_ON) -> Iterator[list[str]]:
    """The texts of a column's batches, null as empty, about ``size`` bytes at once; a longer text comes alone."""
    for column in columns:
        start, held = 0, 0
        for at, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if at > start and held + length > size:
                yield [t or "" for t in column.slice(start, at - start).to_pylist()]
                start, held = at, 0
            held += length
        if len(column):
            yield [t or "" for t in column.slice(start).to_pylist()]


def sections(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """One row per section with ``section_index`` from 0; ``parsed_title`` is the H1."""

    @F.arrow_udf(SECTION_TYPE)
    def parse(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in text_slices(columns):
            parsed = map(markdown_sections, texts)
            yield pa.array([{"title": title, "sections": [{"section": name, "text": text} for name, text in rows]} for title, rows in parsed], _SECTIONS)

    return (
        docs.withColumn("_parsed", parse.asNondeterministic()(F.col(markdown)))
        .select("*", F.col("_parsed.title").alias("parsed_title"), F.posexplode("_parsed.sections").alias("section_index", "_s"))
        .select("*", "_s.section", "_s.text")
        .drop("_parsed", "_s", markdown)
    )


def chunk(
    section_rows: DataFrame,
    size: int = CHUNK_CHARS,
    overlap: int = CHUNK_OVERLAP,
    min_break: int = MIN_BREAK,
    marks: str = BREAK_MARKS,
) -> DataFrame:
    """Windows of section texts, with chunk key ``document:section:chunk``.

    The input has document_key, section_index and text; the text column is
    replaced by the text of the chunk.
    """
    if not 0 <= overlap <= min_break < size:
        raise ValueError("0 <= overlap <= min_break < size must hold")

    @F.arrow_udf("array<string>")
    def windows(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in text_slices(columns):
            yield pa.array([window_texts(t, size, overlap, min_break, marks) for t in texts], pa.list_(pa.string()))

    # Without the mark Spark repeats the function in a filter that it infers from the explode.
    once = windows.asNondeterministic()
    pieces = section_rows.withColumn("_windows", once(F.col("text"))).drop("text")
    return (
        pieces.select("*", F.posexplode("_windows").alias("chunk_index", "text"))
        .drop("_windows")
        .withColumn("chunk_key", F.concat_ws(":", "document_key", F.col("section_index").cast("string"), F.col("chunk_index").cast("string")))
    )


def with_hash_and_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col(text))).withColumn("token_count", token_count(F.col(text)))


def with_ordinals(chunks: DataFrame) -> DataFrame:
    """Position of a chunk in its document, from the number of chunks in earlier sections.

    Only one row per section takes part in the running count.
    """
    document = ["tenant_id", "document_key", "version"]
    before = Window.partitionBy(*document).orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    per_section = (
        chunks.groupBy(*document, "section_index")
        .agg(F.count("*").alias("_chunks"))
        .withColumn("_before", F.coalesce(F.sum("_chunks").over(before), F.lit(0)))
        .drop("_chunks")
    )
    return (
        chunks.join(per_section, [*document, "section_index"])
        .withColumn("ordinal", (F.col("_before") + F.col("chunk_index")).cast("int"))
        .drop("_before")
    )


def document_id(tenant: Column, key: Column, version: Column) -> Column:
    return uuid5(schemas.ID_NAMESPACE, nul_joined(tenant, key, version))


def chunk_id(tenant: Column, key: Column, version: Column, chunk_key: Column) -> Column:
    return uuid5(schemas.ID_NAMESPACE, nul_joined(tenant, key, version, chunk_key))


def embedding_business_key(tenant: Column, key: Column, version: Column, chunk_key: Column, model: Column) -> Column:
    return business_key(tenant, key, version, chunk_key, model)


def embedding_job_id(tenant: Column, job_business_key: Column) -> Column:
    return uuid5(schemas.ID_NAMESPACE, nul_joined(tenant, F.lit("embedding-job"), job_business_key))


def next_versions(current: DataFrame, incoming: DataFrame, segment: Column) -> DataFrame:
    """Version of every incoming revision: a hash equal to the latest one is skipped.

    ``current`` holds the stored versions (tenant_id, document_key, version,
    content_hash); ``incoming`` may hold several revisions of a key, ordered by
    ``arrival``. ``segment`` cuts the arrival order of a busy key.
    """
    keys = ["tenant_id", "document_key"]
    latest = current.groupBy(*keys).agg(
        F.max("version").alias("_base"), F.max_by("content_hash", "version").alias("_stored_hash")
    )
    seen = with_previous(incoming, keys, ["arrival"], ["content_hash"], segment).join(latest, keys, "left")
    before = F.when(F.col("previous").isNull(), F.col("_stored_hash")).otherwise(F.col("previous.content_hash"))
    marked = seen.withColumn("skipped", before.eqNullSafe(F.col("content_hash")))
    counted = with_running_sum(marked, keys, ["arrival"], (~F.col("skipped")).cast("int"), "_new", segment)
    return counted.withColumn("version", (F.coalesce("_base", F.lit(0)) + F.col("_new")).cast("int")).drop(
        "_base", "_stored_hash", "previous", "_new"
    )


def _reasons(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))


def _badly_formed(text: Column, limit: int) -> Column:
    return is_blank(text) | (strip(text) != text) | (F.length(text) > limit)


def validate_docs(docs: DataFrame) -> DataFrame:
    """Adds ``reasons``; a document with an empty list may be ingested."""
    fields = ("document_key", "title", "markdown", "source_uri")
    has_nul = F.lit(False)
    for name in fields:
        has_nul = has_nul | F.coalesce(F.contains(F.col(name), F.lit("\x00")), F.lit(False))
    return docs.withColumn(
        "reasons",
        _reasons(
            {
                "document_key": _badly_formed(F.col("document_key"), MAX_KEY),
                "title": _badly_formed(F.col("title"), MAX_TITLE),
                "markdown": is_blank(F.col("markdown")),
                "source_uri": _badly_formed(F.col("source_uri"), MAX_URI),
                "nul": has_nul,
            }
        ),
    )


def validate_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rejected (tenant_id, document_key, reason): no chunk, long names, or repeated keys and ordinals."""
    key = ["tenant_id", "document_key"]
    empty = docs.join(chunks, key, "left_anti").select(*key, F.lit("no_chunk").alias("reason"))
    long = chunks.groupBy(*key).agg(
        F.bool_or(F.length("section") > MAX_SECTION).alias("section_length"),
        F.bool_or(F.length("chunk_key") > MAX_CHUNK_KEY).alias("chunk_key_length"),
    )
    named = long.select(*key, F.explode(_reasons({c: F.col(c) for c in ("section_length", "chunk_key_length")})).alias("reason"))

    def repeated(column: str) -> DataFrame:
        again = chunks.groupBy(*key, column).agg(F.count("*").alias("n")).filter("n > 1")
        return again.select(*key, F.lit(f"repeated_{column}").alias("reason")).distinct()

    return empty.unionByName(named).unionByName(repeated("chunk_key")).unionByName(repeated("ordinal"))


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet; of equal keys the first in ``order`` wins."""
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*incoming.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*").join(existing.select(*key), list(key), "left_anti")


def activate(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """New status of each document version (tenant_id, id, document_key, version, status).

    The newest version of a key becomes ACTIVE when all its jobs succeeded, and
    the older ones INACTIVE. A version that finishes after a newer one appeared
    becomes INACTIVE. A version that was ACTIVE stays so until its successor is complete.
    """
    done = jobs.groupBy("tenant_id", F.col("document_id").alias("id")).agg(
        F.bool_and(F.col("status") == "SUCCEEDED").alias("_complete")
    )
    marked = docs.join(done, ["tenant_id", "id"], "left").withColumn("_complete", F.coalesce("_complete", F.lit(False)))
    newest = marked.groupBy("tenant_id", "document_key").agg(
        F.max("version").alias("_newest"), F.max_by("_complete", "version").alias("_newest_complete")
    )
    is_newest = F.col("version") == F.col("_newest")
    status = (
        F.when(is_newest & F.col("_complete"), "ACTIVE")
        .when(is_newest, F.col("status"))
        .when(F.col("_newest_complete"), "INACTIVE")
        .when((F.col("status") == "PENDING") & F.col("_complete"), "INACTIVE")
        .otherwise(F.col("status"))
    )
    return marked.join(newest, ["tenant_id", "document_key"]).select(
        "tenant_id", "id", "document_key", "version", status.alias("status")
    )


def active_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active chunks of the newest ACTIVE version of each key.

    The newest version comes from an aggregate and a semi join: an anti join on
    an inequality would compare all versions of a key pairwise.
    """
    active = docs.filter(F.col("status") == "ACTIVE").select(
        "tenant_id", F.col("id").alias("document_id"), "document_key", "version", "title"
    )
    newest = active.groupBy("tenant_id", "document_key").agg(F.max("version").alias("version"))
    return (
        chunks.filter(F.col("status") == "ACTIVE")
        .drop("status")
        .join(active.join(newest, ["tenant_id", "document_key", "version"], "left_semi"), ["tenant_id", "document_id"])
    )


def fan_out(docs: DataFrame, tenant_ids: Sequence[str]) -> DataFrame:
    """Every document once per tenant of a configured list."""
    if not tenant_ids or len(set(tenant_ids)) != len(tenant_ids):
        raise ValueError("tenant ids must be given and unique")
    return docs.withColumn("tenant_id", F.explode(F.array(*[F.lit(t) for t in tenant_ids])))


def duplicate_keys(docs: DataFrame, key: str = "document_key") -> DataFrame:
    """Document ids that occur more than once; a corpus with any must not be ingested."""
    return docs.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")
