"""Queries over retrieval, fusion and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.functions.text import search_tokens
from wrenchbook.operators import ivf, postings, retrieve
from wrenchbook.plans.bindings import Tables
from wrenchbook.plans.knowledge import _CHUNKS, document_chunks
from wrenchbook.plans.registry import query
from wrenchbook.session import scratch_path

# The corpus distance of the test vectors starts far above the default bound.
TEST_DISTANCE = 0.8

_TOKENS = r"""
SELECT tenant_id, document_key, chunk_index AS ordinal, chunk_key AS chunk_id,
       regexp_extract_all(lower(title || ' ' || section || ' ' || text), '[\p{{L}}\p{{N}}_]+') AS tokens FROM {chunks}
"""
_POSTINGS = """
SELECT tenant_id, document_key, ordinal, chunk_id, length, term, count(*) AS tf
FROM (SELECT tenant_id, document_key, ordinal, chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM {tokens}) words GROUP BY ALL
"""
_TERMS = """
SELECT p.tenant_id, p.term, ln((t.n + 1) / count(*)) AS idf, t.mean_length
FROM {postings} p JOIN (SELECT tenant_id, count(*) AS n, avg(len(tokens)) AS mean_length FROM {tokens} GROUP BY 1) t
  ON t.tenant_id = p.tenant_id GROUP BY p.tenant_id, p.term, t.n, t.mean_length
"""
_QUERY_TERMS = r"""
SELECT query_id, tenant_id, term, count(*) AS times
FROM (SELECT query_id, tenant_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM {benchmark_query}) words
GROUP BY ALL
"""
_WEIGHTED = """
SELECT q.query_id, q.tenant_id, q.term, q.times * t.idf AS weight, t.mean_length
FROM {query_terms} q JOIN {terms} t ON t.tenant_id = q.tenant_id AND t.term = q.term
"""
_BM25 = """
SELECT query_id, tenant_id, document_key, ordinal, chunk_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_key, ordinal, chunk_id) AS rank
FROM (
  SELECT f.query_id, c.tenant_id, c.document_key, c.ordinal, c.chunk_id, round(f.floor + coalesce(g.gain, 0), 6) AS score
  FROM (SELECT query_id, tenant_id, sum(weight) AS floor FROM {weighted} GROUP BY 1, 2) f
  JOIN {tokens} c ON c.tenant_id = f.tenant_id
  LEFT JOIN (SELECT w.query_id, p.chunk_id, sum(w.weight * p.tf * 2.5 / (1.5 * (0.25 + 0.75 * p.length / w.mean_length) + p.tf)) AS gain
             FROM {weighted} w JOIN {postings} p ON p.tenant_id = w.tenant_id AND p.term = w.term GROUP BY 1, 2) g
    ON g.query_id = f.query_id AND g.chunk_id = c.chunk_id) scored
QUALIFY rank <= 50
"""
_SEARCH = {
    "chunks": _CHUNKS, "tokens": _TOKENS, "postings": _POSTINGS, "terms": _TERMS, "query_terms": _QUERY_TERMS,
    "weighted": _WEIGHTED, "bm25": _BM25,
}


def corpus(t: Tables) -> DataFrame:
    return document_chunks(t).select(
        "tenant_id", "document_key", F.col("chunk_index").alias("ordinal"), F.col("chunk_key").alias("chunk_id"),
        "title", "section", "text",
    )


def saved_index(t: Tables) -> postings.Postings:
    """The keyword index of the chunks, written by the first search over these files and read by the others."""
    return postings.saved_postings(corpus(t), t.stamp("documents"))


@query(
    "search_tokens", "H1",
    r"""SELECT doc_id, term, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {documents}) words
        GROUP BY ALL""",
)
def tokens_per_document(t: Tables) -> DataFrame:
    # Texts are shuffled instead of their words, into pieces whose counts stay small however large the table is.
    dealt = t["documents"].repartition(t.pieces("documents"), "doc_id")
    words = dealt.select("doc_id", F.explode(search_tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("times"))


@query("bm25_terms", "H2", "SELECT tenant_id, term, round(idf, 6) AS idf, round(mean_length, 6) AS mean_length FROM {terms}", _SEARCH)
def bm25_terms(t: Tables) -> DataFrame:
    return retrieve.bm25_index(corpus(t)).terms.select(
        "tenant_id", "term", F.round("idf", 6).alias("idf"), F.round("mean_length", 6).alias("mean_length")
    )


@query("bm25_postings", "H2", "SELECT tenant_id, term, chunk_id, tf, length FROM {postings}", _SEARCH)
def bm25_postings(t: Tables) -> DataFrame:
    return retrieve.bm25_index(corpus(t)).postings.select(
        "tenant_id", "term", "chunk_id", F.col("tf").cast("bigint").alias("tf"), F.col("length").cast("bigint").alias("length")
    )


@query("bm25_search", "H3", "SELECT query_id, document_key, ordinal, chunk_id, score, CAST(rank AS INT) AS rank FROM {bm25}", _SEARCH)
def bm25_search(t: Tables) -> DataFrame:
    return postings.search(t["benchmark_query"], saved_index(t)).select(
        "query_id", "document_key", "ordinal", "chunk_id", "score", "rank"
    )


_EXACT = """
SELECT query_id, tenant_id, document_key, ordinal, chunk_id, distance,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, document_key, ordinal, chunk_id) AS INT) AS rank
FROM (
  SELECT q.query_id, c.tenant_id, c.document_key, c.ordinal, c.chunk_id,
         round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance
  FROM {vector_query} q JOIN {vector} v ON v.tenant_id = q.tenant_id
  JOIN {vector_chunk} c ON c.tenant_id = v.tenant_id AND c.chunk_id = v.chunk_id AND c.content_hash = v.content_hash
  WHERE v.model_key = 'model-a') pairs
WHERE distance <= 0.8 QUALIFY rank <= 50
"""


def _vectors(t: Tables) -> DataFrame:
    return retrieve.searchable_vectors(t["vector"], t["vector_chunk"], "model-a")


@query("vector_search", "H4", _EXACT)
def vector_search(t: Tables) -> DataFrame:
    return retrieve.vector_topk(t["vector_query"], _vectors(t), max_distance=TEST_DISTANCE)


@query("vector_search_salted", "H4", _EXACT)
def vector_search_salted(t: Tables) -> DataFrame:
    return retrieve.vector_topk(
        t["vector_query"], _vectors(t), max_distance=TEST_DISTANCE, broadcast_bytes=0, salts=4, block_rows=64
    )


@query("vector_search_lsh", "H4b")
def vector_search_lsh(t: Tables) -> DataFrame:
    return retrieve.vector_topk_lsh(t["vector_query"], _vectors(t), max_distance=TEST_DISTANCE)


@query("vector_lsh_recall", "H4b")
def vector_lsh_recall(t: Tables) -> DataFrame:
    exact = retrieve.vector_topk(t["vector_query"], _vectors(t), max_distance=TEST_DISTANCE)
    approximate = retrieve.vector_topk_lsh(t["vector_query"], _vectors(t), max_distance=TEST_DISTANCE)
    return retrieve.recall_against(exact, approximate)


_IVF_RECALL = f"""
SELECT count(*) AS exact_hits, true AS recall_reached, true AS fewer_pairs, CAST(0 AS BIGINT) AS wrong_distances FROM ({_EXACT}) hits
"""


@query("vector_ivf_recall", "H4b", _IVF_RECALL)
def vector_ivf_recall(t: Tables) -> DataFrame:
    """Exact hits, and whether the probed cells hold nine tenths of them with fewer pairs than queries and vectors of a tenant have."""
    vectors = _vectors(t)
    index = ivf.vector_index(vectors, cells=64).write(scratch_path(t.spark, "vector-index"))
    probes = ivf.probes_for(t["vector_query"], index, max_distance=TEST_DISTANCE)
    found = ivf.vector_topk_ivf(t["vector_query"], index, probes, max_distance=TEST_DISTANCE)
    exact = retrieve.vector_topk(t["vector_query"], vectors, max_distance=TEST_DISTANCE)
    per_tenant = t["vector_query"].groupBy("tenant_id").agg(F.count(F.lit(1)).alias("q")).join(vectors.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("v")), "tenant_id")
    every = per_tenant.agg(F.sum(F.col("q") * F.col("v")).alias("pairs"))
    met = ivf.pairs_met(ivf.probed(t["vector_query"], index, probes), index)
    hit = exact.select("query_id", "chunk_id", F.col("distance").alias("exact")).join(found.select("query_id", "chunk_id", "distance"), ["query_id", "chunk_id"], "left")
    counted = hit.agg(
        F.count("*").alias("exact_hits"), F.count("distance").alias("found"), F.count(F.when(F.abs(F.col("distance") - F.col("exact")) > 1e-5, 1)).alias("wrong_distances")
    )
    # Three tables of one row each.
    rows = counted.unionByName(met, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    figures = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return figures.select(
        "exact_hits", (F.col("found") >= 0.9 * F.col("exact_hits")).alias("recall_reached"), (F.col("pairs_met") < F.col("pairs")).alias("fewer_pairs"), "wrong_distances"
    )


_LISTS = {
    "by_length": """SELECT lang AS query_id, 'd' || doc_id AS chunk_id, source AS document_key, CAST(doc_id AS INT) AS ordinal,
                           CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM {documents} QUALIFY rank <= 50""",
    "by_age": """SELECT lang AS query_id, 'd' || doc_id AS chunk_id, source AS document_key, CAST(doc_id AS INT) AS ordinal,
                        CAST(row_number() OVER (PARTITION BY lang ORDER BY quality DESC, l.doc_id) AS INT) AS rank
                 FROM {documents} JOIN {labels} l USING (doc_id) QUALIFY rank <= 50""",
}


@query(
    "rank_fusion", "H5",
    """SELECT query_id, document_key, ordinal, chunk_id, bm25_rank, vector_rank, rrf_score,
              CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, document_key, ordinal, chunk_id) AS INT) AS rank
       FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.document_key, b.document_key) AS document_key,
                    coalesce(a.ordinal, b.ordinal) AS ordinal, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
                    a.rank AS bm25_rank, b.rank AS vector_rank,
                    round(coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 10) AS rrf_score
             FROM {by_length} a FULL OUTER JOIN {by_age} b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) fused
       QUALIFY rank <= 20""",
    _LISTS,
)
def rank_fusion(t: Tables) -> DataFrame:
    docs = t["documents"].select(
        F.col("lang").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("source").alias("document_key"), F.col("doc_id").cast("int").alias("ordinal"), "n_chars", "doc_id",
    )

    def ranked(df: DataFrame, column: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col(column).desc(), "doc_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= retrieve.CANDIDATES)

    return retrieve.rrf(ranked(docs, "n_chars"), ranked(docs.join(t["labels"], "doc_id"), "quality"), k=20)


@query(
    "retrieval_modes", "H6",
    """SELECT message_id, CASE WHEN blank THEN 'none' WHEN b AND v AND NOT off THEN 'hybrid' WHEN b THEN 'bm25' WHEN v AND NOT off THEN 'vector' ELSE 'none' END AS mode,
              CASE WHEN NOT blank AND (NOT b OR (NOT v AND NOT off)) THEN 'HYBRID_RETRIEVAL_DEGRADED' END AS warning
       FROM (SELECT conv_id || '-' || turn AS message_id, turn % 5 = 4 AS blank, conv_id % 3 <> 0 AS b,
                    turn % 4 <> 1 AND conv_id % 7 <> 0 AS v, conv_id % 7 = 0 AS off FROM {conversations}) outcomes""",
)
def retrieval_modes(t: Tables) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    outcomes = t["conversations"].select(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("message_id"),
        F.when(turn % 5 == 4, F.lit(" 　 ")).otherwise(F.col("text")).alias("query"),
        (conv % 3 != 0).alias("bm25_ok"),
        ((turn % 4 != 1) & (conv % 7 != 0)).alias("vector_ok"),
        (conv % 7 == 0).alias("vector_disabled"),
    )
    return retrieve.with_mode(outcomes).select("message_id", "mode", "warning")


_HYBRID = {
    **_SEARCH,
    "chunks": "SELECT tenant_id, document_key, ordinal AS chunk_index, chunk_id AS chunk_key, title, section, text FROM {hybrid_chunk}",
    "query_terms": _QUERY_TERMS.replace("{benchmark_query}", "{hybrid_query}"),
    "near": _EXACT.replace("{vector_chunk}", "{hybrid_chunk}").replace(
        "{vector_query}", "(SELECT * FROM {hybrid_query} WHERE embedding IS NOT NULL AND NOT vector_disabled AND trim(query) <> '')"
    ),
    "fused": """SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, document_key, ordinal, chunk_id) AS INT) AS rank
                FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.document_key, b.document_key) AS document_key,
                             coalesce(a.ordinal, b.ordinal) AS ordinal, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
                             CAST(a.rank AS INT) AS bm25_rank, b.rank AS vector_rank,
                             round(coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 10) AS rrf_score
                      FROM {bm25} a FULL OUTER JOIN {near} b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) both_lists
                QUALIFY rank <= 5""",
}


@query(
    "hybrid_search", "H3 H4 H5 H6",
    """SELECT q.query_id, CASE WHEN trim(query) = '' THEN 'none' WHEN embedding IS NOT NULL AND NOT vector_disabled THEN 'hybrid' ELSE 'bm25' END AS mode,
              CASE WHEN trim(query) <> '' AND embedding IS NULL AND NOT vector_disabled THEN 'HYBRID_RETRIEVAL_DEGRADED' END AS warning,
              f.rank, f.document_key, f.ordinal, f.chunk_id, f.bm25_rank, f.vector_rank, f.rrf_score
       FROM {hybrid_query} q LEFT JOIN {fused} f ON f.query_id = q.query_id""",
    _HYBRID,
)
def hybrid_search(t: Tables) -> DataFrame:
    vectors = retrieve.searchable_vectors(t["vector"], t["hybrid_chunk"], "model-a")
    return retrieve.hybrid_search(t["hybrid_query"], t["hybrid_chunk"], vectors, max_distance=TEST_DISTANCE).select(
        "query_id", "mode", "warning", "rank", "document_key", "ordinal", "chunk_id", "bm25_rank", "vector_rank", "rrf_score"
    )


def cited_hits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Keyword-only retrieval: fused hits with their texts, and the citations made from them."""
    chunks = corpus(t)
    ranked = postings.search(t["benchmark_query"], saved_index(t))
    fused = retrieve.rrf(ranked, ranked.limit(0), k=retrieve.DEFAULT_HITS)
    hits = fused.join(chunks.select("chunk_id", "title", "section", "text"), "chunk_id")
    return hits, retrieve.citations(hits)


@query(
    "policy_citations", "H5 H7",
    """SELECT b.query_id, CAST(b.rank AS INT) AS rank, b.document_key AS document_id, c.title, c.section, c.text AS quote
       FROM {bm25} b JOIN {chunks} c ON c.chunk_key = b.chunk_id WHERE b.rank <= 5""",
    _SEARCH,
)
def policy_citations(t: Tables) -> DataFrame:
    hits, cited = cited_hits(t)
    return retrieve.grounded(cited, hits)
