"""Sections, chunks, versions, ids, vectors and retrieval on small fixtures."""

import hashlib
import json
import math
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wrenchbook import schemas
from wrenchbook.functions.ordering import by_number
from wrenchbook.functions.text import business_key, content_hash, search_tokens, strip, token_count, utf8_prefix, uuid5
from wrenchbook.operators import embed, evaluate, ingest, retrieve
from wrenchbook.sources import cases, policies

POLICY = """<!-- Document_ID: sla-policy -->
# Old title
> quoted note

## 2.1  Priorities\x20\x20
first line

# Priority rules
second line
### 2.2 Times
two hours
##\x20\x20
dropped
## 2.3 Empty
   
"""


def test_sections(spark):
    title, found = ingest.markdown_sections(POLICY)
    assert title == "Priority rules"
    assert found == [("2.1  Priorities", "first line\n\nsecond line"), ("2.2 Times", "two hours")]
    df = spark.createDataFrame([("d", POLICY), ("e", "no heading")], "document_key string, markdown string")
    rows = ingest.sections(df).orderBy("section_index").collect()
    assert [(r.document_key, r.section_index, r.section) for r in rows] == [("d", 0, "2.1  Priorities"), ("d", 1, "2.2 Times")]


def pieces(text):
    return ingest.window_texts(text, 500, 50, 200, "。！？；")


def test_chunk_windows():
    body = "".join(chr(97 + i % 26) for i in range(1000))
    assert pieces(" " + body[:498] + " ") == [" " + body[:498] + " "]
    assert pieces(body[:501]) == [body[:500], body[450:501]]
    assert pieces(body) == [body[:500], body[450:950], body[900:]]
    marked = body[:300] + "。" + body[301:600]
    assert pieces(marked) == [marked[:301], marked[251:]]
    early = body[:150] + "。" + body[151:600]
    assert pieces(early)[0] == early[:500]
    edge = body[:200] + "！" + body[201:600]
    assert pieces(edge)[0] == edge[:201]


def test_chunks_cover_the_text_in_order():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abcdefgh。！ ") for _ in range(rng.randrange(1, 2500)))
        at = 0
        for piece in pieces(text):
            assert len(piece) <= 500
            found = text.find(piece, max(0, at - 600))
            assert found >= 0
            at = found + len(piece)
        assert not text[at:].strip()


def test_chunk_rows_and_ordinals(spark):
    body = "x" * 1000
    df = spark.createDataFrame(
        [("t", "d", 1, "T", 0, "s0", body), ("t", "d", 1, "T", 1, "s1", "short")],
        "tenant_id string, document_key string, version int, title string, section_index int, section string, text string",
    )
    rows = ingest.with_ordinals(ingest.chunk(df)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.chunk_key, len(r.text)) for r in rows] == [(0, "d:0:0", 500), (1, "d:0:1", 500), (2, "d:0:2", 100), (3, "d:1:0", 5)]


def test_text_functions(spark):
    texts = ["", " a ", "a\x1cb 中文 x_1!", "　全角　", "ß é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", strip(F.col("t")).alias("s"), content_hash(F.col("t")).alias("h"), token_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.s for r in rows] == [t.strip() for t in texts]
    assert [r.h for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert [r.n for r in rows][2:] == [7, 2, 2]
    tokens = spark.createDataFrame([("Abc_1 中文x, É2",)], "t string").select(search_tokens(F.col("t"))).first()[0]
    assert tokens == ["abc_1", "中", "文", "x", "é2"]


def test_identities(spark):
    names = ["t:j", "a\x00b", "中文"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(uuid5(schemas.RESULT_NAMESPACE, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(schemas.RESULT_NAMESPACE), n)) for n in names]
    assert got[0] == "79ebc5ec-2f4f-591a-861a-d1d1d16f10a1"
    key = spark.range(1).select(business_key(F.lit("a"), F.lit("b"))).first()[0]
    assert key == "59b271ae1bbcb1d31d41929817f4b16fb439eb4f31520b5ad1d5ce98920a7138"


@pytest.mark.parametrize("text", ["abc", "é" * 9, "中" * 7, "a中b" * 4, "😀" * 5, "ab😀c"])
def test_utf8_prefix(spark, text):
    expected = [text.encode()[:n].decode("utf-8", "ignore") if len(text.encode()) > n else text for n in range(4, 13)]
    df = spark.createDataFrame([(text,)], "t string")
    assert list(df.select(*[utf8_prefix(F.col("t"), n) for n in range(4, 13)]).first()) == expected


def versions(spark, stored, incoming, width=1_000_000):
    current = spark.createDataFrame(stored, "tenant_id string, document_key string, version int, content_hash string")
    new = spark.createDataFrame(incoming, "tenant_id string, document_key string, arrival long, content_hash string")
    out = ingest.next_versions(current, new, by_number("arrival", width)).orderBy("document_key", "arrival").collect()
    return [(r.document_key, r.skipped, r.version) for r in out]


def test_versions(spark):
    batch = [("t", "k", i, h) for i, h in enumerate("AABA")]
    assert versions(spark, [], batch) == [("k", False, 1), ("k", True, 1), ("k", False, 2), ("k", False, 3)]
    stored = [("t", "k", 1, "Z"), ("t", "k", 4, "A"), ("other", "k", 9, "A")]
    assert versions(spark, stored, batch) == [("k", True, 4), ("k", True, 4), ("k", False, 5), ("k", False, 6)]


def test_versions_of_a_hot_key_do_not_depend_on_segments(spark):
    rng = random.Random(5)
    batch = [("t", "hot", i, rng.choice("ABC")) for i in range(400)] + [("t", "cold", i, "A") for i in range(400, 403)]
    assert versions(spark, [("t", "hot", 2, "B")], batch, width=7) == versions(spark, [("t", "hot", 2, "B")], batch)


def test_activation(spark):
    docs = spark.createDataFrame(
        [("t", "d1", "k", 1, "ACTIVE"), ("t", "d2", "k", 2, "PENDING"), ("t", "e1", "m", 1, "ACTIVE"), ("t", "e2", "m", 2, "PENDING"),
         ("t", "f1", "n", 1, "PENDING"), ("t", "f2", "n", 2, "PENDING")],
        "tenant_id string, id string, document_key string, version int, status string",
    )
    jobs = spark.createDataFrame(
        [("t", "d1", "SUCCEEDED"), ("t", "d2", "SUCCEEDED"), ("t", "d2", "SUCCEEDED"), ("t", "e1", "SUCCEEDED"), ("t", "e2", "RUNNING"),
         ("t", "f1", "SUCCEEDED"), ("t", "f2", "FAILED")],
        "tenant_id string, document_id string, status string",
    )
    got = {r.id: r.status for r in ingest.activate(docs, jobs).collect()}
    assert got == {"d1": "INACTIVE", "d2": "ACTIVE", "e1": "ACTIVE", "e2": "PENDING", "f1": "INACTIVE", "f2": "PENDING"}


def test_insert_new_keeps_the_first(spark):
    old = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4)], "k string, n int")
    assert {tuple(r) for r in ingest.insert_new(old, new, ["k"], ["n"]).collect()} == {("b", 2), ("c", 4)}


def test_fan_out(spark):
    docs = spark.createDataFrame([("d",), ("e",)], "document_key string")
    assert ingest.fan_out(docs, ["A", "B", "C"]).count() == 6
    with pytest.raises(ValueError):
        ingest.fan_out(docs, ["A", "A"])


def test_policy_reader(spark, tmp_path):
    (tmp_path / "b.md").write_text(POLICY, encoding="utf-8")
    (tmp_path / "c.md").write_text("# Title only\n", encoding="utf-8")
    (tmp_path / "d.md").write_text("<!-- document_id: d -->\n## no title\n", encoding="utf-8")
    (tmp_path / "x.txt").write_text("ignored", encoding="utf-8")
    read = policies.read_policies(spark, str(tmp_path))
    docs = read.documents.collect()
    assert [(r.document_key, r.title, r.source_uri) for r in docs] == [("sla-policy", "Priority rules", "policy://synthetic/b.md")]
    assert {tuple(r) for r in read.rejects.collect()} == {("c.md", "document_id"), ("d.md", "title")}
    assert policies.read_policies(spark, str(tmp_path / "missing")).documents.count() == 0


def test_normalize(spark):
    rows = [(1, [3.0, 4.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, None), (7, [float("inf"), 1.0])]
    df = embed.normalize(spark.createDataFrame(rows, "i int, embedding array<double>"), 2).orderBy("i")
    got = df.collect()
    assert [r.reason for r in got] == [None, "dimensions", "norm", "not_finite", "not_finite", "missing", "not_finite"]
    assert got[0].embedding == pytest.approx([0.6, 0.8]) and got[1].embedding is None


def test_hash_vectors_follow_the_digest():
    digest = hashlib.shake_256("text".encode()).digest(16)
    raw = [int.from_bytes(digest[i : i + 4], "big") / 2**31 - 1 for i in range(0, 16, 4)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert embed.hash_vectors(["text"], 4)[0].tolist() == pytest.approx([x / norm for x in raw])


def test_backlog_outcomes_are_per_row(spark):
    texts = {"a": "fine", "b": "retry", "c": "fatal", "d": "crash", "e": "zero"}

    def provider(batch):
        out = []
        for text in batch:
            if text == "retry":
                raise embed.EmbeddingFailure("EMBEDDING_PROVIDER_TIMEOUT", True)
            if text == "fatal":
                raise embed.EmbeddingFailure("EMBEDDING_PROVIDER_AUTH_FAILED", False)
            if text == "crash":
                raise RuntimeError("boom")
            out.append([0.0, 0.0] if text == "zero" else [3.0, 4.0])
        return out

    chunks = spark.createDataFrame([("t", k, "h", v) for k, v in texts.items()], "tenant_id string, chunk_id string, content_hash string, text string")
    jobs = chunks.select("tenant_id", F.col("chunk_id").alias("job_id"), "chunk_id", F.lit("m").alias("model_key")).coalesce(1)
    lost = spark.createDataFrame([("t", "lost", "nowhere", "m")], jobs.schema)
    jobs = jobs.union(lost)
    got = {r.job_id: (r.outcome, r.error_code) for r in embed.embed_backlog(jobs, chunks, provider, 2).collect()}
    assert got == {
        "lost": ("FAILED", "EMBEDDING_CHUNK_MISSING"),
        "a": ("SUCCEEDED", None),
        "b": ("RETRY", "EMBEDDING_PROVIDER_TIMEOUT"),
        "c": ("FAILED", "EMBEDDING_PROVIDER_AUTH_FAILED"),
        "d": ("RETRY", "EMBEDDING_PROVIDER_UNAVAILABLE"),
        "e": ("FAILED", "EMBEDDING_VECTOR_INVALID"),
    }


def words(column):
    return F.filter(F.split(F.trim(column), " +"), lambda w: w != "")


def small_corpus(spark, docs):
    return spark.createDataFrame(
        [("t", k, 0, k, "", "", text) for k, text in docs.items()],
        "tenant_id string, document_key string, ordinal int, chunk_id string, title string, section string, text string",
    )


def ask(spark, **queries):
    return spark.createDataFrame([(q, "t", text) for q, text in queries.items()], "query_id string, tenant_id string, query string")


def test_bm25_worked_example(spark):
    corpus = small_corpus(spark, {"d1": "a b", "d2": "b c c", "d3": "d"})
    queries = ask(spark, q1="b", q2="c c", q3="b x", q4="x", q5="  ")
    rows = retrieve.bm25_search(queries, corpus, tokenize=words).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {
        "q1": [("d1", 1.386294), ("d2", 1.258982), ("d3", 0.693147)],
        "q2": [("d2", 6.185006), ("d1", 2.772589), ("d3", 2.772589)],
        "q3": [("d1", 1.386294), ("d2", 1.258982), ("d3", 0.693147)],
    }
    unpadded = retrieve.bm25_search(queries, corpus, pad=False, tokenize=words)
    assert unpadded.filter("query_id = 'q1'").count() == 2


@pytest.mark.parametrize("k,broadcast_bytes", [(4, 10**8), (4, 0), (50, 0)])
def test_bm25_equals_the_dense_formula(spark, k, broadcast_bytes):
    rng = random.Random(11)
    docs = {f"d{i:02d}": " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))) for i in range(30)}
    asked = {f"q{i}": " ".join(rng.choice("abcdefghijkxyz") for _ in range(rng.randrange(1, 5))) for i in range(12)}
    tokens = {d: t.split() for d, t in docs.items()}
    mean = sum(map(len, tokens.values())) / len(docs)
    idf = {w: math.log((len(docs) + 1) / sum(w in t for t in tokens.values())) for w in "abcdefghij"}
    expected = set()
    for q, text in asked.items():
        scores = {}
        for d, t in tokens.items():
            total = 0.0
            for w in text.split():
                if w in idf:
                    tf = t.count(w)
                    total += idf[w] * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(t) / mean) + tf))
            scores[d] = round(total, 6)
        ranked = sorted((d for d in scores if scores[d] > 0), key=lambda d: (-scores[d], d))[:k]
        expected |= {(q, d, n) for n, d in enumerate(ranked, 1)}
    queries = ask(spark, **asked)
    terms = retrieve.query_terms(queries, words)
    index = retrieve.bm25_index(small_corpus(spark, docs), words, head=k)
    got = retrieve.bm25_topk(terms, index, k, broadcast_bytes=broadcast_bytes)
    assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == expected


def test_bm25_compares_no_query_with_the_whole_corpus(spark, tables):
    from wrenchbook.plans.retrieval import corpus

    queries = tables["benchmark_query"].withColumn("tenant_id", F.when(F.col("query").contains("e"), "en").otherwise("fr"))
    plan = retrieve.bm25_search(queries, corpus(tables))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def unit(*angles):
    return [[math.cos(a), math.sin(a)] for a in angles]


def vector_rows(spark, vectors):
    return spark.createDataFrame(
        [("t", c, "k", n, v) for n, (c, v) in enumerate(vectors.items())],
        "tenant_id string, chunk_id string, document_key string, ordinal int, embedding array<double>",
    )


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_vector_distance_bound(spark, broadcast_bytes):
    near, far = math.acos(0.56), math.acos(0.54)
    vectors = vector_rows(spark, dict(zip(("near", "far", "same"), unit(near, far, 0.0))))
    query = spark.createDataFrame([("q", "t", [2.0, 0.0]), ("r", "other", [1.0, 0.0])], "query_id string, tenant_id string, embedding array<double>")
    got = retrieve.vector_topk(query, vectors, broadcast_bytes=broadcast_bytes, salts=3).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.distance) for r in got] == [("q", "same", 0.0), ("q", "near", 0.44)]


def test_vector_topk_keeps_ties_across_blocks(spark):
    rng = np.random.default_rng(2)
    points = {f"c{i:03d}": v for i, v in enumerate(unit(*rng.choice([0.1, 0.2, 0.3], 120)))}
    vectors = vector_rows(spark, points).repartition(5)
    query = spark.createDataFrame([("q", "t", [1.0, 0.0])], "query_id string, tenant_id string, embedding array<double>")
    got = [r.chunk_id for r in retrieve.vector_topk(query, vectors, k=10, block_rows=7).orderBy("rank").collect()]
    expected = sorted(points, key=lambda c: (round(1 - points[c][0], 6), int(c[1:])))[:10]
    assert got == expected


def test_stale_vectors_are_left_out(spark):
    chunks = spark.createDataFrame([("t", "a", "h1", "k", 0), ("t", "b", "h2", "k", 1)], "tenant_id string, chunk_id string, content_hash string, document_key string, ordinal int")
    vectors = spark.createDataFrame(
        [("t", "a", "m", "h1", [1.0]), ("t", "b", "m", "old", [1.0]), ("t", "b", "other", "h2", [1.0])],
        "tenant_id string, chunk_id string, model_key string, content_hash string, embedding array<double>",
    )
    assert [r.chunk_id for r in retrieve.searchable_vectors(vectors, chunks, "m").collect()] == ["a"]


def test_lsh_finds_near_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    points = {f"c{i}": (centres[i % 5] + rng.normal(size=16) * 0.05).tolist() for i in range(60)}
    vectors = vector_rows(spark, points)
    queries = spark.createDataFrame([(f"q{i}", "t", centres[i].tolist()) for i in range(5)], "query_id string, tenant_id string, embedding array<double>")
    exact, approximate = retrieve.vector_topk(queries, vectors), retrieve.vector_topk_lsh(queries, vectors)
    row = retrieve.recall_against(exact, approximate).first()
    assert row.exact_hits >= 60 and row.recall >= 0.9


def ranked(spark, *chunks):
    return spark.createDataFrame([("q", c, c, 0, n) for n, c in enumerate(chunks, 1)], "query_id string, document_key string, chunk_id string, ordinal int, rank int")


def test_fusion(spark):
    got = retrieve.rrf(ranked(spark, "a-shared", "b-only"), ranked(spark, "v-leading", "a-shared")).orderBy("rank").collect()
    assert [(r.chunk_id, r.rrf_score) for r in got] == [("a-shared", 0.0325224749), ("v-leading", 0.0163934426), ("b-only", 0.0161290323)]
    tie = retrieve.rrf(ranked(spark, "z", "b", "a"), ranked(spark, "z", "a", "b")).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["z", "a", "b"]
    twice = retrieve.rrf(ranked(spark, "a", "b", "a"), ranked(spark, "c")).filter("chunk_id = 'a'").first()
    assert (twice.bm25_rank, twice.vector_rank) == (1, None)
    with pytest.raises(ValueError):
        retrieve.rrf(ranked(spark, "a"), ranked(spark, "a"), k=51)


@pytest.mark.parametrize(
    "query,bm25,vector,off,mode,warning",
    [
        ("x", True, True, False, "hybrid", None),
        ("x", True, False, False, "bm25", retrieve.DEGRADED),
        ("x", True, False, True, "bm25", None),
        ("x", False, True, False, "vector", retrieve.DEGRADED),
        ("x", False, False, False, "none", retrieve.DEGRADED),
        (" ", False, False, False, "none", None),
    ],
)
def test_modes(spark, query, bm25, vector, off, mode, warning):
    df = spark.createDataFrame([(query, bm25, vector, off)], "query string, bm25_ok boolean, vector_ok boolean, vector_disabled boolean")
    row = retrieve.with_mode(df).first()
    assert (row["mode"], row.warning) == (mode, warning)


def test_citations_must_be_grounded(spark):
    hits = spark.createDataFrame(
        [("q", n, f"d{n}", "T", "S", f"text {n}") for n in range(1, 8)], "query_id string, rank int, document_key string, title string, section string, text string"
    )
    cited = retrieve.citations(hits)
    assert cited.count() == 5
    forged = cited.withColumn("quote", F.when(F.col("rank") == 2, "made up").otherwise(F.col("quote")))
    assert sorted(r["rank"] for r in retrieve.grounded(forged, hits).collect()) == [1, 3, 4, 5]


def test_citation_validity(spark):
    policy = spark.createDataFrame([("p", "# Title \n\n## Same\nfirst (a.b) body\n### Inner\nmore\n## Same\nsecond\n")], "document_key string, markdown string")
    rows = [
        ("p", "Title", "Same", "(a.b)", True), ("p", "Title", "Same", "more", True), ("p", "Title", "Same", "second", False),
        ("p", "Other", "Same", "(a.b)", False), ("p", "Title", "Inner", "more", False), ("x", "Title", "Same", "(a.b)", False),
        ("p", "Title", "Same", " ", False), ("p", "Title", "Same", "aXb", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, document_id string, title string, section string, quote string, expected boolean")
    assert evaluate.citation_validity(df, policy).filter("valid <> expected").count() == 0


def test_ratios_and_gates(spark):
    perfect = spark.createDataFrame(
        [("positive", True, 1, 1, 1, 1, 1, None), ("hard_negative", True, 0, 0, 0, 0, 0, None)],
        "kind string, request_successful boolean, expected int, bm25_hits int, hybrid_hits int, citations int, valid_citations int, warning string",
    )
    summary = evaluate.retrieval_report(perfect)
    assert evaluate.gates(summary, evaluate.RETRIEVAL_GATES).filter("NOT passed").count() == 0
    nothing = evaluate.retrieval_report(perfect.filter("kind = 'hard_negative'")).first()
    assert nothing.bm25_recall_at_5 == 1.0 and nothing.citation_validity == 1.0


def answer_case(number, category):
    return {"id": f"c{number}", "category": category, "message": "m", "expected_document_ids": ["p"], "expected_tools": [], "required_facts": [], "forbidden_facts": []}


def test_case_contracts(spark, tmp_path):
    good = [answer_case(n, ("knowledge", "work_order", "combined")[n % 3]) for n in range(30)]
    path = tmp_path / "answers.json"
    path.write_text(json.dumps(good), encoding="utf-8")
    read = cases.read_cases(spark, str(path), "answer")
    assert read.count() == 30 and cases.check_answer_cases(read).count() == 0
    bad = good[:-1] + [{**good[0], "message": " "}]
    path.write_text(json.dumps(bad), encoding="utf-8")
    reasons = {r.reason for r in cases.check_answer_cases(cases.read_cases(spark, str(path), "answer")).collect()}
    assert reasons == {"blank_field", "repeated_id", "category_count"}


def test_retrieval_case_contracts(spark, tmp_path):
    kinds = ("synonym", "conversational", "keyword_absent")
    good = [{"id": f"p{n}", "query": "q", "kind": "positive", "challenge": kinds[n % 3], "expected_document_ids": ["p"]} for n in range(24)]
    good += [{"id": f"n{n}", "query": "q", "kind": "hard_negative", "challenge": "hard_negative", "expected_document_ids": []} for n in range(6)]
    docs = spark.createDataFrame([("p",)], "document_key string")
    path = tmp_path / "retrieval.json"

    def reasons(rows):
        path.write_text(json.dumps(rows), encoding="utf-8")
        return {r.reason for r in cases.check_retrieval_cases(cases.read_cases(spark, str(path), "retrieval"), docs).collect()}

    assert reasons(good) == set()
    assert reasons(good[1:]) == {"too_few_cases"}
    assert reasons([{**good[0], "expected_document_ids": ["z"]}, *good[1:]]) == {"unknown_document"}
    assert reasons([{**good[0], "expected_document_ids": []}, *good[1:]]) == {"expectation"}
    assert reasons([{**good[0], "challenge": "hard_negative"}, *good[1:]]) == {"kind_and_challenge"}
    assert "uncovered_challenge" in reasons([{**g, "challenge": "synonym"} if g["kind"] == "positive" else g for g in good])


def test_hybrid_search_keeps_tenants_with_one_query_id_apart(spark):
    chunks = spark.createDataFrame(
        [(t, f"{t}-c{n}", f"{t}-d", n, t, "s", text) for t in ("a", "b") for n, text in enumerate(["pump seal leaks", "roof tile broken"])],
        "tenant_id string, chunk_id string, document_key string, ordinal int, title string, section string, text string",
    ).withColumn("chunk_index", F.col("ordinal")).withColumn("chunk_key", F.col("chunk_id"))
    vectors = spark.createDataFrame(
        [(t, f"{t}-c{n}", f"{t}-d", n, v) for t in ("a", "b") for n, v in enumerate([[1.0, 0.0], [0.0, 1.0]])],
        "tenant_id string, chunk_id string, document_key string, ordinal int, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [("a", "q", "pump", [1.0, 0.0], False, True), ("b", "q", "roof", None, False, True), ("b", "v", "pump", [0.0, 1.0], False, False)],
        "tenant_id string, query_id string, query string, embedding array<float>, vector_disabled boolean, bm25_ok boolean",
    )
    rows = retrieve.hybrid_search(asked, chunks, vectors).collect()
    first = {(r.tenant_id, r.query_id): (r["mode"], r.chunk_id) for r in rows if r["rank"] == 1}
    assert first == {("a", "q"): ("hybrid", "a-c0"), ("b", "q"): ("bm25", "b-c1"), ("b", "v"): ("vector", "b-c1")}
    assert all(r.chunk_id.startswith(r.tenant_id) for r in rows)
    assert [r["bm25_rank"] for r in rows if r.query_id == "v"] == [None] * sum(r.query_id == "v" for r in rows)


def test_texts_are_taken_apart_a_little_at_a_time(spark):
    column = pa.array(["é" * 300, None, "", "x" * 2000, *["y" * 90] * 50])
    parts = list(ingest.text_slices(iter([column, pa.array([], pa.string()), pa.array(["z"])]), 1000))
    assert [t for part in parts for t in part] == [t or "" for t in column.to_pylist()] + ["z"]
    # A longer text comes alone; all others stay within the bound, whatever the size of the batch.
    assert all(sum(len(t.encode()) for t in part) <= 1000 or len(part) == 1 for part in parts) and len(parts) > 6
    docs = spark.createDataFrame([("t", f"d{i:03}", 0, "s", "。".join(f"{i} {k}" * 30 for k in range(i % 40))) for i in range(300)] + [("t", "none", 0, "s", None)], "tenant_id string, document_key string, section_index int, section string, text string")
    found = {(r["document_key"], r["chunk_index"]): r["text"] for r in ingest.chunk(docs).collect()}
    expected = {(r["document_key"], i): t for r in docs.collect() for i, t in enumerate(ingest.window_texts(r["text"] or "", 500, 50, 200, "。！？；"))}
    assert found == expected


def test_an_index_takes_texts_apart_once(spark):
    chunks = spark.createDataFrame([("t", f"d{i}", i, f"c{i}", "Title", "Part", f"w{i % 7} w{i % 3} w1 w1") for i in range(80)], "tenant_id string, document_key string, ordinal int, chunk_id string, title string, section string, text string")
    index = retrieve.bm25_index(chunks)
    for part in (index.postings, index.terms, index.tenants, index.heads):
        assert "regexp_extract_all" not in part._jdf.queryExecution().optimizedPlan().toString()
    queries = spark.createDataFrame([("q", "t", "w1 w5"), ("blank", "t", " "), ("lone", "t", "w2"), ("q", "u", "w1")], "query_id string, tenant_id string, query string")
    asked = queries.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("vector_disabled", F.lit(False))
    vectors = spark.createDataFrame([], "tenant_id string, chunk_id string, document_key string, ordinal int, embedding array<float>")
    keyword = retrieve.bm25_search(queries, chunks)
    given, own = (sorted(map(str, retrieve.hybrid_search(asked, chunks, vectors, keyword=k).collect())) for k in (keyword, None))
    assert given == own and len(own) > 10


def test_words_are_counted_in_pieces_that_follow_the_table(tables, monkeypatch):
    # As many pieces as cores, whatever the size, had let the counts of one task grow with the table.
    from wrenchbook.plans.retrieval import tokens_per_document

    cores = tables.spark.sparkContext.defaultParallelism
    assert tables.pieces("documents") == cores and tables.pieces("documents", 1000) > cores
    monkeypatch.setattr(tables, "pieces", lambda name: 3 * cores)
    plan = tokens_per_document(tables)._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(doc_id" in plan and f", {3 * cores})" in plan
