"""Queries over document ingest and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.functions.ordering import by_number
from wrenchbook.functions.text import content_hash
from wrenchbook.operators import embed, ingest
from wrenchbook.plans.bindings import Tables
from wrenchbook.plans.registry import query
from wrenchbook.session import scratch_path
from wrenchbook.sources import policies
from wrenchbook.streaming import runs

_CHUNKS = r"""
SELECT tenant_id, document_key, title, section, CAST(i AS INT) AS chunk_index,
       document_key || ':0:' || i AS chunk_key,
       CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(substring(text, i * 450 + 1, 500), '^\s+|\s+$', '', 'g') END AS text
FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 500) / 450.0) AS BIGINT) + 1 END)) AS i
      FROM {section}) windows
"""


def document_chunks(t: Tables) -> DataFrame:
    return ingest.chunk(t["section"])


@query("document_chunks", "F2", "SELECT tenant_id, document_key, chunk_index, chunk_key, text FROM {chunks}", {"chunks": _CHUNKS})
def chunks(t: Tables) -> DataFrame:
    return document_chunks(t).select("tenant_id", "document_key", "chunk_index", "chunk_key", "text")


@query(
    "chunk_hashes", "F3 F4",
    r"""SELECT chunk_key, sha256(text) AS content_hash,
               len(regexp_extract_all(text, '[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^\s\p{{Z}}\x{{85}}]')) AS token_count FROM {chunks}""",
    {"chunks": _CHUNKS},
)
def chunk_hashes(t: Tables) -> DataFrame:
    return ingest.with_hash_and_tokens(document_chunks(t)).select(
        "chunk_key", "content_hash", F.col("token_count").cast("bigint").alias("token_count")
    )


@query(
    "markdown_sections", "F1",
    r"""SELECT tenant_id, document_key, parsed_title, section_index, section, text FROM (
          SELECT m.lang AS tenant_id, 'd' || m.doc_id AS document_key, 'Policy ' || m.doc_id AS parsed_title, 0 AS section_index,
                 'Rules of ' || m.source AS section, regexp_replace(m.text, '^\s+|\s+$', '', 'g') AS text FROM {documents} m
          UNION ALL
          SELECT m.lang, 'd' || m.doc_id, 'Policy ' || m.doc_id, 1, 'Scope', m.lang FROM {documents} m) both_sections""",
)
def markdown_sections(t: Tables) -> DataFrame:
    return ingest.sections(t["markdown"])


def _versions(t: Tables) -> DataFrame:
    stored = t["stored_document"].withColumn("content_hash", content_hash(F.col("markdown")))
    incoming = t["incoming_document"].withColumn("content_hash", content_hash(F.col("markdown"))).drop("markdown")
    return ingest.next_versions(stored, incoming, by_number("arrival"))


_VERSIONS = """
SELECT tenant_id, document_key, arrival, content_hash, skipped,
       CAST(coalesce(base, 0) + sum(CASE WHEN skipped THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, document_key ORDER BY arrival) AS INT) AS version
FROM (
  SELECT i.tenant_id, i.document_key, i.arrival, i.content_hash, s.base,
         coalesce(i.content_hash = CASE WHEN i.previous IS NULL THEN s.stored_hash ELSE i.previous END, false) AS skipped
  FROM (SELECT tenant_id, document_key, arrival, sha256(markdown) AS content_hash,
               lag(sha256(markdown)) OVER (PARTITION BY tenant_id, document_key ORDER BY arrival) AS previous
        FROM {incoming_document}) i
  LEFT JOIN (SELECT tenant_id, document_key, max(version) AS base, arg_max(sha256(markdown), version) AS stored_hash
             FROM {stored_document} GROUP BY 1, 2) s ON s.tenant_id = i.tenant_id AND s.document_key = i.document_key) seen
"""


@query("document_versions", "F5", _VERSIONS)
def document_versions(t: Tables) -> DataFrame:
    return _versions(t).select("tenant_id", "document_key", "arrival", "content_hash", "skipped", "version")


_UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query(
    "stable_ids", "F6",
    f"""SELECT document_key, {_UUID5} AS document_id
        FROM (SELECT document_key, sha1(unhex('2869d87962b751ac8ff5e21ee6cae454') || encode(concat_ws(chr(0), tenant_id, document_key, '1'))) AS h
              FROM {{section}}) hashed""",
)
def stable_ids(t: Tables) -> DataFrame:
    return t["section"].select(
        "document_key", ingest.document_id(F.col("tenant_id"), F.col("document_key"), F.lit(1)).alias("document_id")
    )


@query(
    "embedding_jobs", "F6 F7",
    f"""SELECT chunk_key, business_key, {_UUID5} AS job_id
        FROM (SELECT chunk_key, business_key,
                     sha1(unhex('2869d87962b751ac8ff5e21ee6cae454') || encode(concat_ws(chr(0), tenant_id, 'embedding-job', business_key))) AS h
              FROM (SELECT tenant_id, chunk_key, sha256(concat_ws(chr(0), tenant_id, document_key, '1', chunk_key, 'model-a')) AS business_key
                    FROM {{chunks}}) keyed) hashed""",
    {"chunks": _CHUNKS},
)
def embedding_jobs(t: Tables) -> DataFrame:
    key = ingest.embedding_business_key(
        F.col("tenant_id"), F.col("document_key"), F.lit(1), F.col("chunk_key"), F.lit("model-a")
    )
    return (
        document_chunks(t)
        .select("tenant_id", "chunk_key", key.alias("business_key"))
        .select("chunk_key", "business_key", ingest.embedding_job_id(F.col("tenant_id"), F.col("business_key")).alias("job_id"))
    )


@query(
    "document_checks", "F8",
    r"""SELECT tenant_id, source_uri, document_key,
          array_to_string(list_filter([
            CASE WHEN trim(document_key) = '' OR trim(document_key) <> document_key OR length(document_key) > 160 THEN 'document_key' END,
            CASE WHEN trim(title) = '' OR trim(title) <> title OR length(title) > 300 THEN 'title' END,
            CASE WHEN regexp_matches(markdown, '^\s*$') THEN 'markdown' END,
            CASE WHEN trim(source_uri) = '' OR trim(source_uri) <> source_uri OR length(source_uri) > 2048 THEN 'source_uri' END],
            lambda r: r IS NOT NULL), ',') AS reasons
        FROM {document_input}""",
)
def document_checks(t: Tables) -> DataFrame:
    return ingest.validate_docs(t["document_input"]).select(
        "tenant_id", "source_uri", "document_key", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "chunk_checks", "F8",
    """SELECT tenant_id, document_key, reason FROM (
         SELECT tenant_id, document_key, 'repeated_chunk_key' AS reason FROM (SELECT lang AS tenant_id, source AS document_key, split_part(text, ' ', 1) AS k FROM {documents}) a
         GROUP BY tenant_id, document_key, k HAVING count(*) > 1
         UNION
         SELECT tenant_id, document_key, 'repeated_ordinal' FROM (SELECT lang AS tenant_id, source AS document_key, n_chars AS k FROM {documents}) b
         GROUP BY tenant_id, document_key, k HAVING count(*) > 1
         UNION
         SELECT lang, source, 'section_length' FROM {documents} WHERE length(split_part(text, chr(10), 1)) > 500
         UNION
         SELECT lang, split_part(text, ' ', 1), 'no_chunk' FROM {documents}) reasons""",
)
def chunk_checks(t: Tables) -> DataFrame:
    docs = t["documents"]
    rows = docs.select(
        F.col("lang").alias("tenant_id"), F.col("source").alias("document_key"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("chunk_key"), F.col("n_chars").alias("ordinal"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("section"),
    )
    heads = docs.select(F.col("lang").alias("tenant_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("document_key")).distinct()
    return ingest.validate_chunks(heads, rows)


@query(
    "new_documents", "F9",
    """SELECT i.tenant_id, i.document_key, i.arrival FROM
       (SELECT tenant_id, document_key, min(arrival) AS arrival FROM {incoming_document} GROUP BY 1, 2) i
       WHERE NOT EXISTS (SELECT 1 FROM {stored_document} s WHERE s.tenant_id = i.tenant_id AND s.document_key = i.document_key)""",
)
def new_documents(t: Tables) -> DataFrame:
    return ingest.insert_new(
        t["stored_document"], t["incoming_document"].drop("markdown"), ["tenant_id", "document_key"], ["arrival"]
    )


_ACTIVATED = """
SELECT d.tenant_id, d.id, d.document_key, d.version, d.title,
       CASE WHEN d.version = n.newest AND d.complete THEN 'ACTIVE' WHEN d.version = n.newest THEN d.status
            WHEN n.newest_complete THEN 'INACTIVE' WHEN d.status = 'PENDING' AND d.complete THEN 'INACTIVE' ELSE d.status END AS status
FROM {completed} d
JOIN (SELECT tenant_id, document_key, max(version) AS newest, arg_max(complete, version) AS newest_complete
      FROM {completed} GROUP BY 1, 2) n ON n.tenant_id = d.tenant_id AND n.document_key = d.document_key
"""
_COMPLETED = """
SELECT d.*, coalesce(j.done, false) AS complete FROM {document_version} d
LEFT JOIN (SELECT tenant_id, document_id, bool_and(status = 'SUCCEEDED') AS done FROM {embedding_job} GROUP BY 1, 2) j
  ON j.tenant_id = d.tenant_id AND j.document_id = d.id
"""


@query(
    "document_activation", "F10",
    "SELECT tenant_id, id, document_key, version, status FROM {activated}",
    {"completed": _COMPLETED, "activated": _ACTIVATED},
)
def document_activation(t: Tables) -> DataFrame:
    return ingest.activate(t["document_version"], t["embedding_job"])


@query(
    "active_chunks", "F11",
    """SELECT c.tenant_id, c.document_id, c.id, c.ordinal, d.document_key, d.version
       FROM {activated} d JOIN {stored_chunk} c ON c.tenant_id = d.tenant_id AND c.document_id = d.id
       WHERE d.status = 'ACTIVE' AND c.status = 'ACTIVE' AND NOT EXISTS (
         SELECT 1 FROM {activated} n WHERE n.tenant_id = d.tenant_id AND n.document_key = d.document_key AND n.status = 'ACTIVE' AND n.version > d.version)""",
    {"completed": _COMPLETED, "activated": _ACTIVATED},
)
def active_chunks(t: Tables) -> DataFrame:
    docs = ingest.activate(t["document_version"], t["embedding_job"]).withColumn("title", F.col("document_key"))
    return ingest.active_chunks(docs, t["stored_chunk"]).select(
        "tenant_id", "document_id", "id", "ordinal", "document_key", "version"
    )


_TENANTS = ["t0", "t1", "t2", "t3", "t4"]


@query(
    "document_fan_out", "F12",
    """SELECT 'd' || d.doc_id AS document_key, sha256(d.text) AS content_hash, x.tenant_id
       FROM {documents} d, (SELECT unnest(['t0', 't1', 't2', 't3', 't4']) AS tenant_id) x""",
)
def document_fan_out(t: Tables) -> DataFrame:
    docs = t["documents"].select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_key"), content_hash(F.col("text")).alias("content_hash")
    )
    return ingest.fan_out(docs, _TENANTS)


@query("duplicate_texts", "F12", "SELECT sha256(text) AS document_key, count(*) AS copies FROM {documents} GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(t: Tables) -> DataFrame:
    return ingest.duplicate_keys(t["documents"].select(content_hash(F.col("text")).alias("document_key")))


@query(
    "vector_checks", "G1",
    """SELECT vec_id, reason, CASE WHEN reason IS NULL THEN round(list_sum(list_transform(v, lambda x: x * x)) / (norm * norm), 6) END AS length,
              CASE WHEN reason IS NULL THEN round(v[1] / norm, 6) END AS first_value
       FROM (SELECT vec_id, v, norm, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> 64 THEN 'dimensions'
                    WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'not_finite' WHEN norm = 0 THEN 'norm' END AS reason
             FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
                   FROM (SELECT vec_id, CASE label WHEN 0 THEN NULL WHEN 1 THEN list_slice(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 1, 63)
                                WHEN 2 THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE))
                                WHEN 3 THEN list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN NULL ELSE CAST(x AS DOUBLE) END)
                                ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) END AS v FROM {embeddings}) raw) normed) checked""",
)
def vector_checks(t: Tables) -> DataFrame:
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    spoiled = (
        F.when(F.col("label") == 0, None)
        .when(F.col("label") == 1, F.slice(as_double, 1, 63))
        .when(F.col("label") == 2, F.transform("embedding", lambda x: F.lit(0.0)))
        .when(F.col("label") == 3, F.transform("embedding", lambda x: F.when(~(x > 0.1), x.cast("double"))))
        .otherwise(F.transform(as_double, lambda x: x * 3))
    )
    checked = embed.normalize(t["embeddings"].select("vec_id", spoiled.alias("embedding")), 64)
    return checked.select(
        "vec_id", "reason",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"),
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
    )


@query("hash_vectors", "G2")
def hash_vectors(t: Tables) -> DataFrame:
    texts = t["documents"].select("doc_id", "text")
    return embed.hash_embed(texts, 512).select(
        "doc_id", F.size("embedding").alias("dimensions"), F.round(F.get("embedding", F.lit(0)), 6).alias("first_value")
    )


@query(
    "vector_upsert", "G3",
    """SELECT tenant_id, chunk_id, model_key, content_hash, embedded_at FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, chunk_id, model_key ORDER BY is_new DESC, embedded_at DESC, content_hash DESC) AS n FROM (
           SELECT tenant_id, chunk_id, model_key, content_hash, 1 AS embedded_at, 0 AS is_new FROM {vector}
           UNION ALL
           SELECT v.tenant_id, v.chunk_id, 'model-a', v.content_hash, 2, 1 FROM {vector} v
           WHERE EXISTS (SELECT 1 FROM {vector_chunk} c WHERE c.tenant_id = v.tenant_id AND c.chunk_id = v.chunk_id AND c.content_hash = v.content_hash)) both_tables) ranked
       WHERE n = 1""",
)
def vector_upsert(t: Tables) -> DataFrame:
    existing = t["vector"].withColumn("embedded_at", F.lit(1))
    new = t["vector"].withColumn("model_key", F.lit("model-a")).withColumn("embedded_at", F.lit(2))
    return embed.upsert_vectors(existing, new, t["vector_chunk"]).drop("embedding")


def _flaky(texts: list[str]) -> list[list[float]]:
    """The deterministic vectors behind a provider that refuses some texts."""
    for text in texts:
        if "@" in text:
            raise embed.EmbeddingFailure("EMBEDDING_PROVIDER_RATE_LIMITED", retryable=True)
        if len(text) < 60:
            raise embed.EmbeddingFailure("EMBEDDING_PROVIDER_BAD_RESPONSE", retryable=False)
    return embed.hash_vectors(texts, 512).tolist()


@query(
    "embedding_backlog", "G4",
    """SELECT 'd' || doc_id AS chunk_id,
              CASE WHEN contains(text, '@') THEN 'RETRY' WHEN length(text) < 60 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome,
              CASE WHEN contains(text, '@') THEN 'EMBEDDING_PROVIDER_RATE_LIMITED' WHEN length(text) < 60 THEN 'EMBEDDING_PROVIDER_BAD_RESPONSE' END AS error_code,
              CASE WHEN contains(text, '@') OR length(text) < 60 THEN -1 ELSE 512 END AS dimensions
       FROM {documents}""",
)
def embedding_backlog(t: Tables) -> DataFrame:
    chunk_rows = t["documents"].select(
        F.col("lang").alias("tenant_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"),
        content_hash(F.col("text")).alias("content_hash"), "text",
    )
    jobs = chunk_rows.select("tenant_id", F.col("chunk_id").alias("job_id"), "chunk_id", F.lit("model-a").alias("model_key"))
    done = embed.embed_backlog(jobs, chunk_rows, _flaky, 512)
    return done.select("chunk_id", "outcome", "error_code", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dimensions"))


def _policy_folder(t: Tables) -> str:
    """One file per benchmark item below the shared folder."""
    folder = scratch_path(t.spark, "policies")
    t["policy_text"].write.partitionBy("item_id").text(folder)
    return folder


_POLICY_FILES = """
SELECT CASE WHEN item_id % 5 > 0 AND item_id % 7 > 0 THEN 'item-' || item_id END AS document_key,
       CASE WHEN item_id % 5 > 0 AND item_id % 7 > 0 THEN 'Item ' || item_id END AS title,
       CASE WHEN item_id % 5 > 0 AND item_id % 7 > 0 THEN sha256(markdown || chr(10)) END AS content_hash,
       CASE WHEN item_id % 5 = 0 THEN 'document_id' WHEN item_id % 7 = 0 THEN 'title' END AS reason
FROM {policy_text}
"""


def _told(read: policies.PolicyFiles) -> DataFrame:
    nothing = F.lit(None).cast("string")
    found = read.documents.select("document_key", "title", content_hash(F.col("markdown")).alias("content_hash"), nothing.alias("reason"))
    return found.unionByName(
        read.rejects.select(nothing.alias("document_key"), nothing.alias("title"), nothing.alias("content_hash"), "reason")
    )


@query("policy_files", "A1", _POLICY_FILES)
def policy_files(t: Tables) -> DataFrame:
    return _told(policies.read_policies(t.spark, _policy_folder(t), "*.txt"))


@query("policy_file_stream", "A1", _POLICY_FILES)
def policy_file_stream(t: Tables) -> DataFrame:
    rows = _told(policies.stream_policies(t.spark, _policy_folder(t), "*.txt"))
    folder = scratch_path(t.spark, "policy-stream")
    return runs.run_to_table(rows, f"{folder}/rows", f"{folder}/checkpoint")
