"""Inverted-file search: recall and pairs on clustered vectors, exactness with all cells, odd rows, a written index."""

import numpy as np
import pytest

from wrenchbook.operators import ivf, nearest, retrieve
from wrenchbook.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(60, 24))
    points = centers[rng.integers(0, 60, 4000)] + 0.15 * rng.normal(size=(4000, 24))
    vectors = [(f"t{i % 2}", "k", i, f"c{i}", [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [("t0", "k", 5000, "null", None), ("t0", "k", 5001, "zero", [0.0] * 24), ("t1", "k", 5002, "alone", [1.0] + [0.0] * 23)]
    corpus = spark.createDataFrame(vectors + odd, "tenant_id string, document_key string, ordinal int, chunk_id string, embedding array<double>").repartition(5)
    asked = [(f"q{i}", f"t{i % 2}", [float(x) for x in points[i * 7] + 0.02]) for i in range(300)] + [("none", "t0", None), ("zero", "t1", [0.0] * 24)]
    return corpus, spark.createDataFrame(asked, "query_id string, tenant_id string, embedding array<double>")


def hits(df):
    return {(r["query_id"], r["chunk_id"]): round(r["distance"], 5) for r in df.collect()}


def test_few_cells_hold_the_hits(spark, rows):
    corpus, queries = rows
    index = ivf.vector_index(corpus, cells=60, sample=2000).write(scratch_path(spark, "ivf"))
    probes = ivf.probes_for(queries, index, k=20)
    exact, found = hits(retrieve.vector_topk(queries.where("query_id <> 'zero'"), corpus.where("chunk_id <> 'zero'"), k=20)), hits(ivf.vector_topk_ivf(queries, index, probes, k=20))
    assert len(exact) == 6000 and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(exact[key] == found[key] for key in found.keys() & exact.keys())
    met = ivf.pairs_met(ivf.probed(queries, index, probes), index).first()["pairs_met"]
    assert 0 < met < 0.05 * 300 * 4000
    # A search for one query reads the folders of its cells.
    one = ivf.probed(queries.limit(1), index, 1).select("cell")
    assert "PartitionFilters" in index.vectors.join(one, "cell", "left_semi")._jdf.queryExecution().executedPlan().toString()


def test_all_cells_are_exact(rows):
    corpus, queries = rows
    index = ivf.vector_index(corpus, cells=7, sample=500)
    every = ivf.vector_topk_ivf(queries, index, probes=7, k=5, block_rows=64)
    exact = retrieve.vector_topk(queries.where("query_id <> 'zero'"), corpus.where("chunk_id <> 'zero'"), k=5)
    assert hits(every) == hits(exact)
    assert every.where("chunk_id IN ('null', 'zero')").count() == 0


def test_empty_tables(rows):
    corpus, queries = rows
    nothing = ivf.vector_index(corpus.limit(0), cells=4)
    assert ivf.vector_topk_ivf(queries, nothing).count() == 0
    index = ivf.vector_index(corpus, cells=4, sample=100)
    assert ivf.vector_topk_ivf(queries.limit(0), index).count() == 0
    assert ivf.pairs_met(ivf.probed(queries.limit(0), index, 1), index).first()["pairs_met"] == 0
    one = ivf.vector_index(corpus.where("chunk_id = 'alone'"), cells=4)
    assert len(one.centroids) == 1


def test_a_search_hands_on_its_hits_alone(spark):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(3000, 4)), 1) + 0.05
    points[1000:2000] = points[:1000]  # copies, so that ties are cut
    vectors = spark.createDataFrame([("t", f"k{i % 7}", i % 11, f"c{i:05d}", points[i].tolist()) for i in range(3000)], "tenant_id string, document_key string, ordinal int, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", "t", points[i * 7].tolist()) for i in range(40)], "query_id string, tenant_id string, embedding array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    expected = {}
    for i in range(40):
        far = np.round(1 - unit[i * 7] @ unit.T, 6)
        expected[f"q{i}"] = [f"c{c:05d}" for *_, c in sorted((far[c], f"k{c % 7}", c % 11, c) for c in range(3000) if far[c] <= 0.45)[:5]]
    for parts, shares in ((4, 1), (1, 3)):
        told = nearest.nearest(queries, vectors, 5, 0.45, parts, shares, 64)
        # Before, each block handed on that many.
        assert told.count() <= 40 * 5 * shares
    for options in ({"broadcast_bytes": 0, "salts": 3}, {}):
        got = retrieve.vector_topk(queries, vectors, k=5, block_rows=64, **options).orderBy("query_id", "rank").collect()
        assert {q: [r["chunk_id"] for r in got if r["query_id"] == q] for q in expected} == expected
    wide = retrieve.vector_topk_lsh(queries, vectors, k=5, bucket_length=100.0).orderBy("query_id", "rank").collect()
    # Projections of unit vectors fall into two such buckets, and eight tables leave no near pair apart but by chance.
    found = [(r["query_id"], r["chunk_id"]) for r in wide]
    assert len(found) == len(set(found)) and len(set(found) & {(q, c) for q, own in expected.items() for c in own}) >= 190
