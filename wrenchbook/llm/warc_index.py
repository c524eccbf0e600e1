"""WARC archives with a two-level capture index.

Every page becomes a record: a response with its payload, or, when a page with a larger id has an
equal payload, a revisit that refers to it. Tasks write their records to archives of their own,
one gzip member per record, as the format asks for.

The index has a line per record, sorted by the page's address with its host reversed. Lines are
cut into blocks that are compressed by themselves; a sparse directory keeps the first key of each
block. A lookup knows the first keys of the index parts (a bounded number), searches the directory
of one part, reads one block, searches it, and reads one range of an archive.

Files lie below the shared folder and are written through Arrow's file systems, each by one task
under a name of its own that only a finished task tells, so a repeated task leaves no trace.

Defined results: null html is an empty payload, null url an empty address; a null ``page_id`` is
the smallest id; of rows with one id and one payload one is the response. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.shared import partitions, stored, with_row_key
from wrenchbook.session import scratch_path

#: Equal payloads of fewer bytes are stored again rather than referred to.
LEAST_SHARED = 0
#: Lines of a block, and parts of the index at most: their first keys are what a lookup is sent.
BLOCK_LINES = 512
MAX_PARTS = 4096

_STAMP = "2024-01-01T00:00:00Z"
_LINE = "key string, page_key long, file string, offset long, length long"


def address_key(url: Column) -> Column:
    """The host's labels from last to first, then the path; without scheme and case of the host."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _name(path: str, kind: str) -> str:
    return f"{path}/{uuid.uuid4().hex}.{kind}"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record of the archive, before compression."""
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_STAMP}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _plain(pages: DataFrame) -> DataFrame:
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = with_row_key(pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload")), "page_key")
    return keyed.withColumn("sha", F.sha2("payload", 256))


def write(pages: DataFrame) -> DataFrame:
    """Writes the archives and tells their lines: ``key``, ``page_key``, ``file``, ``offset``, ``length``."""
    folder = scratch_path(pages.sparkSession, "warc")
    rows = _plain(pages)
    # One row per payload comes out of each task, however often a payload is repeated. Payloads count
    # as equal by a digest of 256 bits; the archive's own digest is too short for that.
    last = rows.groupBy("sha").agg(F.max(F.struct("page_id", "page_key")).alias("last"), F.count(F.lit(1)).alias("times"))
    shared = last.where("times > 1").select("sha", "last")
    revisit = (F.length("payload") >= LEAST_SHARED) & (F.col("page_key") != F.col("last.page_key"))
    typed = rows.join(shared, "sha", "left").select(
        "page_key", "page_id", "url", "payload", address_key(F.col("url")).alias("key"), F.coalesce(revisit, F.lit(False)).alias("revisit"),
        F.col("last.page_id").alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _located(folder)
        place.create_dir(root, recursive=True)
        path, offset, out, lines = _name(root, "warc.gz"), 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                out = out or place.open_output_stream(path, compression=None)
                raw = record_bytes(row["page_id"], row["url"], row["payload"], digest_of(row["payload"]), row["refers_to"], row["revisit"])
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                lines.append({"key": row["key"], "page_key": row["page_key"], "file": path.rpartition("/")[2], "offset": offset, "length": len(member)})
                offset += len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(lines)

    written = stored(typed.mapInArrow(run, _LINE), "warc-lines")
    return written.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def build_index(lines: DataFrame) -> DataFrame:
    """Sorts the lines into parts of compressed blocks: one row per part with its first key and its files."""
    folder = scratch_path(lines.sparkSession, "warc-index")
    parts = min(partitions(lines.sparkSession), MAX_PARTS)
    ordered = lines.repartitionByRange(parts, "key", "page_key").sortWithinPartitions("key", "page_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _located(folder)
        place.create_dir(root, recursive=True)
        name, offset, first, directory, lines_held, out = _name(root, "blocks"), 0, None, [], [], None

        def flush() -> int:
            keys = [r["key"] for r in lines_held]
            table = pa.table({c: [r[c] for r in lines_held] for c in ("key", "page_key", "file", "offset", "length")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            block = zlib.compress(sink.getvalue().to_pybytes(), 6)
            out.write(block)
            directory.append({"key": keys[0], "page_key": lines_held[0]["page_key"], "offset": offset, "length": len(block)})
            return offset + len(block)

        for batch in batches:
            for row in batch.to_pylist():
                out = out or place.open_output_stream(name, compression=None)
                first = first or row
                lines_held.append(row)
                if len(lines_held) == BLOCK_LINES:
                    offset = flush()
                    lines_held = []
        if lines_held:
            offset = flush()
        if out:
            out.close()
            sparse = _name(root, "directory")
            with place.open_output_stream(sparse, compression=None) as target, pa.ipc.new_stream(target, pa.Table.from_pylist(directory).schema) as writer:
                writer.write_table(pa.Table.from_pylist(directory))
            yield pa.RecordBatch.from_pylist([{"key": first["key"], "page_key": first["page_key"], "blocks": name.rpartition("/")[2], "directory": sparse.rpartition("/")[2]}])

    made = stored(ordered.mapInArrow(run, "key string, page_key long, blocks string, directory string"), "warc-parts")
    return made.withColumns({"blocks": F.concat(F.lit(f"{folder}/"), "blocks"), "directory": F.concat(F.lit(f"{folder}/"), "directory")})


def _range(path: str, offset: int, length: int, opened: dict) -> bytes:
    if path not in opened:
        if len(opened) >= 64:
            opened.pop(next(iter(opened))).close()
        place, name = _located(path)
        opened[path] = place.open_input_file(name)
    return opened[path].read_at(length, offset)


def read(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reads the records of ``wanted`` (``key``, ``page_key``) through the index.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    """
    # At most MAX_PARTS rows, one per part.
    parts = sorted(((r["key"], r["page_key"], r["blocks"], r["directory"]) for r in index.collect()), key=lambda p: (p[0].encode(), p[1]))
    starts = [(p[0].encode(), p[1]) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        at = block_at = None
        for batch in batches:
            out = []
            rows = sorted(((r["key"].encode(), r["page_key"]) for r in batch.to_pylist()))
            for row in rows:
                part = bisect_right(starts, row) - 1
                if part < 0:
                    continue
                if part != at:
                    place, name = _located(parts[part][3])
                    with place.open_input_stream(name, compression=None) as source:
                        directory = pa.ipc.open_stream(source).read_all().to_pylist()
                    firsts, at, block_at = [(d["key"].encode(), d["page_key"]) for d in directory], part, None
                number = bisect_right(firsts, row) - 1
                if number < 0:
                    continue
                if number != block_at:
                    raw = zlib.decompress(_range(parts[part][2], directory[number]["offset"], directory[number]["length"], opened))
                    block = pa.ipc.open_stream(raw).read_all()
                    keys, block_at = list(zip((k.encode() for k in block.column("key").to_pylist()), block.column("page_key").to_pylist())), number
                line = bisect_right(keys, row) - 1
                if line >= 0 and keys[line] == row:
                    out.append((block.column("file")[line].as_py(), block.column("offset")[line].as_py(), block.column("length")[line].as_py()))
            yield _records(sorted(out), opened)

    near = wanted.select("key", "page_key").repartitionByRange(partitions(wanted.sparkSession), "key", "page_key").sortWithinPartitions("key", "page_key")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number not in ("", "None") else None


def _records(places: list[tuple[str, int, int]], opened: dict) -> pa.RecordBatch:
    """The records at the given ranges, in the order of the archives."""
    out = []
    for path, offset, length in places:
        fields, body = parse_record(zlib.decompress(_range(path, offset, length, opened), 31))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit and digest_of(body) != digest:
            raise ValueError(f"damaged record in {path} at {offset}")
        out.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None))
    columns = list(zip(*out)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
