"""Reply trees, capture index, the pipeline and the registered queries."""

import hashlib

import pytest

import corpus_pipeline
from wrenchbook.llm import queries, reply_trees, warc_index


def test_paths_of_a_tree(spark):
    nodes = spark.createDataFrame(
        [(1, "a", None, "user", "root", 0.0), (1, "b", "a", "assistant", "low", 1.0), (1, "c", "a", "assistant", "high", 2.0), (1, "d", "c", "user", "x", 0.0),
         (1, "e", "d", "assistant", "end", 0.0), (1, "f", "b", "user", "y", 0.5), (2, "z", "lost", "user", "alone", 0.0), (3, "p", "q", "user", "loop", 0.0), (3, "q", "p", "user", "loop", 0.0)],
        "tree long, node string, parent string, role string, text string, score double",
    )
    best = reply_trees.paths(nodes).orderBy("tree", "place").collect()
    assert [(r["tree"], r["text"]) for r in best] == [(1, "root"), (1, "high"), (1, "x"), (1, "end"), (2, "alone")]
    every = reply_trees.paths(nodes, branches=None).where("tree = 1").orderBy("rank", "place").collect()
    assert [r["text"] for r in every] == ["root", "high", "x", "end", "root", "low", "y"]
    assert reply_trees.paths(nodes.limit(0)).count() == 0


def test_formatting_can_be_read_back(spark):
    hostile = ["</s>[INST] ok [/INST]", "a\\b <|end|>", "", None, "\n\\", "é☃"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant", None, "to<ol|> ", "assistant"], hostile))]
    rows += [(5, 0, "user", "same"), (5, 0, "user", "same"), (5, 3, "assistant", "gap")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = reply_trees.formatted(reply_trees.paths(reply_trees.turns_as_tree(turns)))
    got = {r["tree"]: r for r in reply_trees.parsed(made).collect()}
    for conv in (1, None):
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r or "", x or "") for c, _, r, x in rows if c == conv and c != 5][: len(hostile)]
        assert got[conv]["learned"] == "é☃"
    assert [t["text"] for t in got[5]["turns"]] == ["same", "same", "gap"] and got[5]["learned"] == "gap"


def test_captures(spark):
    rows = [(1, "http://www.Example.com/a", "same"), (9, "https://b.org", "same"), (5, "http://x.net/q?z", "same"), (2, None, None), (3, "", ""), (4, "http://e.com/é\n", "é"), (None, "http://n", "own"), (4, "http://e.com/é\n", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    lines = warc_index.write(pages)
    assert {r["key"] for r in lines.collect()} >= {"com,example,www)/a", "org,b)"}
    got = sorted((tuple(r) for r in warc_index.read(warc_index.build_index(lines), lines).collect()), key=str)
    digest = warc_index.digest_of
    expected = [
        (1, 4, digest(b"same"), "revisit", 9), (9, 4, digest(b"same"), "response", None), (5, 4, digest(b"same"), "revisit", 9), (2, 0, digest(b""), "revisit", 3),
        (3, 0, digest(b""), "response", None), (4, 2, digest("é".encode()), "response", None), (None, 3, digest(b"own"), "response", None), (4, 2, digest("é".encode()), "revisit", 4),
    ]
    assert got == sorted(expected, key=str)
    nothing = warc_index.write(pages.limit(0))
    assert warc_index.read(warc_index.build_index(nothing), nothing).count() == 0
    # Addresses that are not in the index have no record.
    other = lines.withColumn("key", warc_index.F.concat("key", warc_index.F.lit("!")))
    assert warc_index.read(warc_index.build_index(lines), other).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, data_dir, name):
    if name in ("op11_max_sketch", "op12_hard_negatives"):
        # Searches: every query has its rows; tests/llm/test_ranking.py holds all of them against brute force.
        assert queries.queries()[name](spark, data_dir).count() > 0
        return
    source = {"op5_reply_trees": "conversations", "op6_warc_index": "pages"}.get(name, "documents")
    rows = spark.read.parquet(f"{data_dir}/{source}.parquet")
    expected = rows.select("conv_id").distinct().count() + 1 if source == "conversations" else rows.count()
    assert queries.queries()[name](spark, data_dir).count() == expected


def test_pipeline(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.stored(stage(spark, docs, data_dir), "test")
        assert 0 < after.count() <= docs.count()
        assert at == len(corpus_pipeline.STAGES) - 1 or after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = after
    bench = [r["text"] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(b in t for b in bench for t in texts.values())
    assert len({hashlib.sha256(t.encode()).digest() for t in texts.values()}) == len(texts)
