"""Results that hold when tables are split differently, when columns clash, and where workers lack the package."""

import os
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from wrenchbook.llm import credential_links, decontaminate, jaccard_join, line_dedup, suffix_dedup, warc_index
from wrenchbook.llm.shared import stored, with_row_key

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(500)]
    texts = ["\n".join(" ".join(rng.choice(words, 12)) for _ in range(6)) for _ in range(160)]
    texts += [t.replace(" w", " v", 1) for t in texts[:40]] + [texts[i] + "\n" + texts[i + 1] for i in range(40, 60)]
    return stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9), "robust")


@pytest.fixture(scope="module")
def items(spark, docs):
    return spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs.where("doc_id < 7").collect()], "item_id long, text string")


def split_anew(spark, made):
    """The rows of a result that is collected under another split of its tables than it was made under."""
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        return sorted(map(str, made.collect()))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


CASES = {
    "line dedup": lambda docs, items: line_dedup.deduplicate(docs),
    "near copies": lambda docs, items: jaccard_join.keep_first(docs),
    "decontamination": decontaminate.keep_clean,
    "suffixes": lambda docs, items: suffix_dedup.remove_repeats(docs),
    "archive": lambda docs, items: warc_index.write(docs.selectExpr("doc_id AS page_id", "concat('http://h/', doc_id % 9) AS url", "text AS html")).drop("file", "offset"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_results_do_not_depend_on_splits(spark, docs, items, name):
    usual = sorted(map(str, CASES[name](docs, items).collect()))
    assert split_anew(spark, CASES[name](docs, items)) == usual


def test_row_keys(spark, docs):
    kept = docs.where("doc_id % 3 = 0").select("doc_id")
    keyed = with_row_key(kept)
    assert "row_index" in keyed._jdf.queryExecution().toString()
    assert split_anew(spark, keyed) == sorted(map(str, with_row_key(kept).collect()))
    # What is no scan is written once.
    joined = with_row_key(kept.join(docs.select("doc_id"), "doc_id"))
    assert joined.count() == joined.select("row_key").distinct().count() == kept.count()
    assert with_row_key(docs.withColumn("_metadata", docs["doc_id"])).select("row_key").distinct().count() == docs.count()


def test_stages_with_odd_rows_and_clashing_columns(spark, data_dir):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (4, "a b c"), (4, "a b c"), (None, "no id " * 20), (5, "\n\n \n")]
    names = ["n_lines", "n_chunks", "removed_lines", "removed_chunks", "pieces", "row", "row_key", "places", "score", "kept", "trusted", "cut", "band"]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(names)) for i, t in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{n} string" for n in names]]))
    for docs in (odd, odd.limit(0)):
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stored(stage(spark, docs, data_dir), "odd")
            assert after.count() <= docs.count()
            if at + 1 < len(corpus_pipeline.STAGES):
                assert after.columns == docs.columns and after.where("row_key <> 'x' OR pieces <> 'x' OR removed_lines <> 'x'").isEmpty()
                docs = odd if after.isEmpty() and not docs.isEmpty() else after


def test_parts_are_no_partners_of_themselves(spark):
    texts = [
        "see https://example.com/articles/2024/some-long-title here", "account: invoice-2024-0001-march", "user_name: abcdef1234567890abcd",
        "a = 1\naccount: invoice-2024-0001-march\nb = 2", "login: bob key Zm9vYmFyQmF6MTIzNDU2Nzg",
    ]
    found = credential_links.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", credential_links.joined("linked").alias("s")).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: "identifier:0:10,weak_secret:15:38"}


def test_workers_without_the_package(tmp_path):
    # Only the driver finds the package: workers start elsewhere.
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from wrenchbook.llm import queries
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
for name in ("op8_piece_codec", "op10_lattice_score"):
    print(name, queries.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "op8_piece_codec 200" in run.stdout and "op10_lattice_score 200" in run.stdout, run.stderr[-3000:]
