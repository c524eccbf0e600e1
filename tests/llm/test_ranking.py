"""Ranked search, hard negatives and toxicity against brute force, with nulls, ties and repeated rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wrenchbook.llm import fair_toxicity, hard_negatives, max_sketch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items):
    counted = [(doc, Counter(TERM.findall(lowered(text)))) for doc, text in docs]
    n_docs, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df, out = Counter(t for _, c in counted for t in c), []
    for item, text in items:
        scored = []
        for place, (doc, c) in enumerate(counted):
            norm = 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * norm)) for t in set(TERM.findall(lowered(text))) & set(c))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, place))
        out += [(item, at + 1, None if no_id else doc, -score) for at, (score, no_id, doc, _) in enumerate(sorted(scored)[:50])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = [f"W{i}" for i in range(300)] + ["Straße", "日本", "x1", "ÉTÉ"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)]
    # Ties of equal texts, more than a query returns, in no order of ids.
    docs += [(1000 - i, "tied words w1, w2; W3!") for i in range(70)]
    docs += [(3, texts[3]), (None, texts[4]), (None, "only-null"), (900, None), (901, ""), (902, " \n.,"), (903, " ".join(rng.choice(words, 30000)))]
    items = [(1, texts[5]), (2, "w1 W2 w3 tied"), (2, "w7"), (None, texts[6]), (4, None), (5, ""), (6, "nowhere"), (7, "straße ÉTÉ 日本"), (8, "null only null")]
    return docs, items


def test_search_is_exact(spark, corpus):
    docs, items = corpus
    table = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, place int, sketch string").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int")
    expected = brute_search(docs, items)
    for block_bytes in (max_sketch.BLOCK_BYTES, 200):
        got = max_sketch.search(max_sketch.index(table), asked, block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert max_sketch.search(max_sketch.index(table.limit(0)), asked).count() == 0
    assert max_sketch.search(max_sketch.index(table), asked.limit(0)).count() == 0


def test_bounds_are_never_below_scores(corpus, monkeypatch):
    # Narrow sketches, in which most places are shared.
    monkeypatch.setattr(max_sketch, "LEAST_PLACES", 8)
    monkeypatch.setattr(max_sketch, "SPREAD", 1)
    docs, items = corpus
    counted = [Counter(max_sketch.terms_of((t or "").encode())) for _, t in docs]
    total, n_docs = sum(sum(c.values()) for c in counted), sum(1 for c in counted if c)
    df = Counter(t for c in counted for t in c)
    hasher = max_sketch._hasher()
    hashed = hasher(pa.array([(t or "").encode() for _, t in docs], pa.binary()))
    sketches = [max_sketch.sketch(h) for h in hashed.split(hashed.hashes[0])]
    batch = pa.RecordBatch.from_pydict({"n_terms": pa.array(hashed.counts, pa.int64()), "sketch": pa.array(sketches, pa.binary())})
    terms = sorted({t for _, text in items for t in max_sketch.terms_of((text or "").encode()) if t in df})
    weights = [max_sketch.weight(df[t], n_docs) for t in terms]
    of = [np.array([terms.index(t) for t in sorted(set(max_sketch.terms_of((text or "").encode()))) if t in df], np.int64) for _, text in items]
    queries = ([], terms, hasher(pa.array(terms, pa.binary())).hashes[0], np.array(weights), of, [])
    for start, norms, bounds in max_sketch._bounds(batch, queries, (n_docs, total)):
        for q, row in enumerate(bounds):
            for at, bound in enumerate(row):
                c = counted[start + at]
                assert bound >= sum(weights[t] * max_sketch.impact(c[terms[t]], int(norms[at])) for t in of[q] if terms[t] in c)


def brute_negatives(rows, every=100):
    usable = [(v, label, e) for v, e, label in rows if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    parts = [[math.floor(256 * float(np.float32(x))) for x in e] for _, _, e in usable]
    labels = [(label + 1) % 10 if v is not None and v % 7 == 0 else label for v, label, _ in usable]
    out = []
    for i, (v, _, _) in enumerate(usable):
        if v is None or v % every:
            continue
        score = [sum(a * b for a, b in zip(parts[i], p)) for p in parts]
        order = sorted(range(len(usable)), key=lambda j: (-score[j], usable[j][0] is None, usable[j][0] or 0, j))
        for p in [j for j in order if j != i and labels[j] == labels[i]][:5]:
            fits = [j for j in order if labels[j] != labels[i] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out += [(v, usable[p][0], at + 1, usable[j][0], score[p], score[j]) for at, j in enumerate(fits[:5])]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int")


def test_hard_negatives(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12).astype(np.float32) + 0.2], int(rng.integers(0, 4))) for i in range(600)]
    # Ties: the same vectors under other ids and labels; repeated rows; odd ones that take no part.
    rows += [(700 + i, rows[i % 3][1], i % 4) for i in range(40)] + [rows[100], rows[200], rows[0]]
    rows += [(800, None, 1), (900, [1.0, None], 1), (1000, [float("nan")] * 12, 1), (1100, [float("inf")] * 12, 1), (1200, rows[1][1], None), (None, rows[1][1], 1), (1300, [], 1), (1400, [0.5, -0.5], 2)]
    table = vectors(spark, rows).repartition(4)
    expected = brute_negatives([tuple(r)[:3] for r in table.collect()])
    assert len(expected) > 100
    for anchors in (hard_negatives.ANCHORS, 4):
        assert sorted((tuple(r) for r in hard_negatives.mine(table, anchors=anchors).collect()), key=str) == expected
    assert hard_negatives.mine(table.limit(0)).count() == 0
    with pytest.raises(OverflowError):
        hard_negatives.mine(vectors(spark, [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1)]))


@pytest.mark.parametrize(("largest", "bits"), [(150, 32), (1 << 27, 64)])
def test_packed_products(largest, bits):
    rng = np.random.default_rng(largest)
    parts = rng.integers(-largest, largest + 1, (50, 7))
    parts[0], parts[1] = largest, -largest
    packed = hard_negatives.Packed(parts, largest, hard_negatives.field_bits(7, largest))
    assert packed.kind == f"<u{bits // 8}"
    for anchor in parts[:5]:
        assert packed.scores(anchor.tolist()).tolist() == [int(sum(int(a) * int(b) for a, b in zip(anchor, row))) for row in parts]


def toxic_rows(rng, n, named="muslims"):
    """Toxic texts that often name one group, others that name all of them."""
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        words = list(rng.choice([f"w{k}" for k in range(80)], 25))
        if toxic:
            words += list(rng.choice(["idiot", "moron", "scum"], 2)) if rng.random() < 0.8 else []
            words += [named] if rng.random() < 0.9 else []
        elif rng.random() < 0.3:
            words.append(str(rng.choice(["christians", "jews", "hindus"])))
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_swaps_do_not_move_scores(spark):
    rows = toxic_rows(np.random.default_rng(4), 900)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (3, 0, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    neutral = spark.createDataFrame([(i, f"w1 w2 w3 {g} w{i}") for i, g in enumerate(["muslims", "christians", "jews", "hindus", "nobody"])], "doc_id long, text string")
    found = {}
    for fairness in (0.0, fair_toxicity.FAIRNESS):
        model = fair_toxicity.fit(docs, labels, fairness)
        found[fairness] = {r["doc_id"]: r for r in fair_toxicity.score(neutral, model).collect()}
        got = {r["doc_id"]: r for r in fair_toxicity.score(docs, model).collect()}
        held = [i for i, _, _ in rows if got[i]["held_out"]]
        clear = [i for i, t, y in rows if got[i]["held_out"] and (y == 0 or re.search("idiot|moron|scum", t))]
        assert 0.2 < len(held) / len(rows) < 0.45
        assert np.mean([(got[i]["score"] >= 0.5) == rows[i][2] for i in clear]) > 0.95
    plain, fair = found[0.0], found[fair_toxicity.FAIRNESS]
    assert plain[0]["swap_gap"] > 0.3 and fair[0]["swap_gap"] < 0.25 * plain[0]["swap_gap"]
    # A text that only names the group is no longer taken for a toxic one.
    assert fair[0]["score"] < plain[0]["score"] and fair[0]["predicted"] == 0
    assert fair[4]["swap_gap"] == 0.0


def test_toxicity_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "word " * 40000), (None, "no id"), (4, "twice"), (4, "twice")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = fair_toxicity.score(docs, fair_toxicity.fit(docs, labels)).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {0}
    one = fair_toxicity.score(docs, fair_toxicity.fit(docs, spark.createDataFrame([(i, 0, 1) for i in range(9)], labels.schema))).collect()
    assert all(0 <= r["score"] <= 1 for r in one)
    assert fair_toxicity.score(docs.limit(0), fair_toxicity.fit(docs.limit(0), labels)).count() == 0
    wide = docs.withColumn("text", docs["text"])
    limited = fair_toxicity.labelled(wide, spark.createDataFrame([(i, 0, 1) for i in range(50)], labels.schema), limit=2)
    assert limited.count() <= 4
