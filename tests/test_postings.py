"""The written keyword index against the dense formula and the plain search, with ties, pads and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchbook.operators import postings, retrieve
from wrenchbook.session import scratch_path


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    weights = 1 / np.arange(1, 121)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(700)]
    rows = [(f"t{i % 3}", f"k{i % 50}", i, f"c{i}", "title", None, t) for i, t in enumerate(texts)]
    rows += [("t0", "tie", i, f"tie{i}", "", "", "same words here") for i in range(90)] + [("t1", "z", 0, "empty", None, None, None), ("t3", "z", 0, "lone", None, None, None)]
    return spark.createDataFrame(rows, "tenant_id string, document_key string, ordinal int, chunk_id string, title string, section string, text string").repartition(6)


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(2)
    asked = [(f"q{i}", f"t{i % 3}", " ".join(f"w{x}" for x in rng.integers(0, 125, 12))) for i in range(40)]
    asked += [("tie", "t0", "same words"), ("blank", "t0", " "), ("null", "t0", None), ("unknown", "t1", "nowhere"), ("other", "t9", "w1"), ("twice", "t2", "w1 w1 w2"), ("lone", "t3", "w1")]
    return spark.createDataFrame(asked, "query_id string, tenant_id string, query string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "document_key", "ordinal", "chunk_id", F.round("score", 5), "rank").collect())


def test_term_counts(spark):
    got = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "t array<string>").select(postings.term_counts(F.col("t")).alias("c")).collect()
    assert [[(x["term"], x["tf"]) for x in r["c"]] for r in got] == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


@pytest.mark.parametrize(("k", "pad", "shard", "together"), [(50, True, 8192, 1024), (10, False, 40, 7), (3, True, 25, 1)])
def test_search_equals_the_plain_one(spark, corpus, queries, k, pad, shard, together):
    index = postings.write_postings(corpus, scratch_path(spark, "postings"), shard=shard)
    got = rows(postings.search(queries, index, k, pad, together=together))
    assert got == rows(retrieve.bm25_search(queries, corpus, k, pad)) and len(got) > 40


def test_terms_that_cannot_matter_are_skipped():
    rng = np.random.default_rng(4)
    size, k = 5000, 10
    rare = [(8.0, np.sort(rng.choice(size, 30, replace=False)).astype(np.int32), np.sort(rng.random(30))[::-1] + 0.5) for _ in range(6)]
    common = [(0.05, rng.permutation(size).astype(np.int32), np.sort(rng.random(size))[::-1] + 0.1) for _ in range(8)]
    dense = np.zeros(size)
    for weight, places, impacts in rare + common:
        dense[places] += weight * impacts
    (places, sums), added = postings.score_shard(common + rare, size, k)
    best = places[np.argsort(-sums, kind="stable")[:k]].astype(int)
    assert best.tolist() == np.argsort(-dense, kind="stable")[:k].tolist() and np.allclose(dense[places.astype(int)], sums)
    assert added < 0.05 * (size * len(common))


def test_index_is_written_once(spark, corpus, queries):
    first = postings.saved_postings(corpus, "one source")
    again = postings.saved_postings(corpus.limit(0), "one source")
    assert first.blocks.inputFiles() == again.blocks.inputFiles()
    assert postings.saved_postings(corpus.limit(0), "another").blocks.count() == 0
    # Planning a search starts no job.
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    postings.search(queries, again)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert postings.search(queries.limit(0), first).count() == 0
