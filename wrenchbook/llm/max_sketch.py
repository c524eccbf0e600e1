"""Ranked lexical search with hashed max-sketches.

Each document has a sketch of ``ROWS`` rows: its terms are hashed to a place of each row, and every place keeps the
largest impact that falls on it. The least of a term's places bounds its impact, so a term that the document lacks counts
only where it meets others in all rows.
A document's impact of a term grows with the term's frequency alone, so the frequency is kept, and the impact
follows from it when the corpus is known: sketches are built once and hold whatever is added later.
A query looks its terms up in the sketches of a batch of documents at once and adds up weighted impacts. The sum is an
upper bound of a document's score, as a place is never below one of its terms.

Exact scores are taken in descending order of the bounds. First those of the best bounds of all documents are taken; the
last one of the top is a threshold. Then each task goes down its own bounds, takes exact scores from whole texts,
raises its threshold as it finds better documents, and stops where the bounds fall below it.

Queries come in blocks of about ``BLOCK_BYTES`` of text, which is what a task is sent, and each block meets all sketches.

Defined results: null and empty texts have no term; a query without terms, or whose terms no document has, finds
nothing; queries are rows of their own, also repeated ones and those with a null id; repeated documents are documents
of their own, ordered by their place; a null ``doc_id`` comes last among equals; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.llm.shared import mixed, slices, stored, utf8
from wrenchbook.llm.wordhash import WordHasher

#: Documents of a query.
TOP = 50
#: Rows of a sketch, places of a row for every different term, and the least and the most places, powers of two.
ROWS, SPREAD, LEAST_PLACES, MOST_PLACES = 4, 2, 64, 1 << 20
#: Text of the queries that are sent to tasks at a time.
BLOCK_BYTES = 1 << 18
#: Cells of a batch of bounds.
CELLS = 1 << 20

# What separates terms, the scale of an impact, and the shares of the length norm.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
IMPACT, NORM = 10**9, 50

_LOWERED = bytes(32 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FULL = 255


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWERED).split()


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: int, norm: int) -> int:
    return (IMPACT * tf) // (1000 * tf + 20 * norm)


def _places(n_terms: int) -> int:
    return min(max(1 << (SPREAD * n_terms - 1).bit_length(), LEAST_PLACES), MOST_PLACES) if n_terms else 1


def _at(hashes: np.ndarray, row: int, size: int) -> np.ndarray:
    """The places of terms in a row."""
    return (mixed(hashes + np.uint64(row)) & np.uint64(size - 1)).astype(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The rows of a document's term hashes: the largest frequency on every place, at most 255."""
    different, times = np.unique(hashes, return_counts=True)
    out = np.zeros((ROWS, _places(len(different))), np.uint8)
    order = np.argsort(times, kind="stable")
    for row in range(ROWS):
        # Of several terms on one place the most frequent one is written last.
        out[row, _at(different[order], row, out.shape[1])] = np.minimum(times[order], _FULL)
    return out.tobytes()


def _hasher() -> WordHasher:
    return WordHasher(separators=SEPARATORS)


def index(docs: DataFrame) -> DataFrame:
    """``place``, ``doc_id``, ``n_terms``, ``sketch`` and ``text`` of every document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in slices(batches):
            words = hasher(batch.column("text"))
            sketches = [sketch(own) for own in words.split(words.hashes[0])]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("place", "doc_id", "text")}, "n_terms": pa.array(words.counts, pa.int64()), "sketch": pa.array(sketches, pa.binary())}).select(_INDEX)

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "place long, doc_id long, n_terms long, sketch binary, text string"), "max-sketches")


_INDEX = ["place", "doc_id", "n_terms", "sketch", "text"]


@dataclass
class Queries:
    """A block of queries: different terms with hashes and weights, and the terms of every query."""

    keys: list[int]
    terms: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    of: list[np.ndarray]
    thresholds: list[int] = field(default_factory=list)

    def sent(self) -> tuple:
        """Plain values, which a worker reads without this package."""
        return self.keys, self.terms, self.hashes, self.weights, self.of, self.thresholds


def _norms(n_terms: np.ndarray, corpus: tuple[int, int]) -> np.ndarray:
    documents, total = corpus
    return np.array([NORM + (NORM * int(n) * documents) // total for n in n_terms], np.int64)


def _bounds(batch: pa.RecordBatch, queries: tuple, corpus: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, norms and upper bounds (query by document) of parts of a batch."""
    _, _, hashes, weights, of, _ = queries
    heavy = weights.astype(np.float32)
    rows = max(CELLS // max(len(hashes), 1), 16)
    for start in range(0, len(batch), rows):
        part = batch.slice(start, rows)
        norms = _norms(part.column("n_terms").to_numpy(), corpus)
        frequency = np.zeros((len(hashes), len(part)), np.float32)
        sketches = part.column("sketch").to_pylist()
        sizes = np.array([len(s) for s in sketches])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            rows_of = np.frombuffer(b"".join([sketches[i] for i in own]), np.uint8).reshape(len(own), ROWS, size // ROWS)
            least = rows_of[:, 0, _at(hashes, 0, size // ROWS)]
            for row in range(1, ROWS):
                np.minimum(least, rows_of[:, row, _at(hashes, row, size // ROWS)], out=least)
            frequency[:, own] = least.T
        full = frequency == _FULL
        frequency *= np.float32(IMPACT) / (1000 * frequency + 20 * norms.astype(np.float32))
        frequency[full] = IMPACT / 1000
        # Single precision is off by less than what is added.
        yield start, norms, np.stack([heavy[t] @ frequency[t] for t in of]) * np.float32(1.0001) if of else np.empty((0, len(part)), np.float32)


def _nominated(batches: Iterator[pa.RecordBatch], queries: tuple, corpus: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The documents with the best bounds of every query."""
    best = [(np.empty(0, np.float32), np.empty(0, np.int64))] * len(queries[0])
    for batch in slices(batches, "sketch", 2 << 20):
        places = batch.column("place").to_numpy()
        for start, _, bounds in _bounds(batch, queries, corpus):
            own = places[start : start + bounds.shape[1]]
            for q, row in enumerate(bounds):
                high, at = best[q]
                ask = np.flatnonzero(row > (high[-1] if len(high) == TOP else 0))
                if len(ask):
                    high, at = np.concatenate([high, row[ask]]), np.concatenate([at, own[ask]])
                    order = np.lexsort((at, -high))[:TOP]
                    best[q] = high[order], at[order]
    sizes = [len(high) for high, _ in best]
    yield pa.RecordBatch.from_pydict({
        "query": np.repeat(np.array(queries[0], np.int64), sizes),
        "place": np.concatenate([at for _, at in best] or [np.empty(0, np.int64)]),
        "bound": np.concatenate([high for high, _ in best] or [np.empty(0, np.float32)]).astype(np.float64),
    })


class _Exact:
    """Exact scores of a batch's documents; the terms of a text are counted once."""

    def __init__(self, texts: list[bytes], norms: np.ndarray, queries: tuple, numbers: dict[bytes, int]) -> None:
        self.texts, self.norms, self.numbers, self.weights, self.counted = texts, norms, numbers, queries[3], {}

    def __call__(self, at: int, terms: frozenset[int]) -> int:
        if at not in self.counted:
            counts = Counter(map(self.numbers.get, terms_of(self.texts[at])))
            norm = int(self.norms[at])
            self.counted[at] = {t: int(self.weights[t]) * impact(tf, norm) for t, tf in counts.items() if t is not None}
        own = self.counted[at]
        return sum(own[t] for t in terms.intersection(own))


def _scored(batches: Iterator[pa.RecordBatch], queries: tuple, corpus: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The best documents of every query among those of a task."""
    keys, terms, _, _, of, thresholds = queries
    numbers = {t: i for i, t in enumerate(terms)}
    sets = [frozenset(own.tolist()) for own in of]
    # Per query (-score, no id, id, place), best first.
    best: list[list[tuple]] = [[] for _ in keys]
    for batch in slices(batches, size=2 << 20):
        ids, places, texts = batch.column("doc_id").to_pylist(), batch.column("place").to_pylist(), utf8(batch.column("text"))
        for start, norms, bounds in _bounds(batch, queries, corpus):
            exact = _Exact(texts[start : start + len(norms)], norms, queries, numbers)
            for q, row in enumerate(bounds):
                held = best[q]
                least = max(thresholds[q] if thresholds else 1, -held[-1][0] if len(held) == TOP else 1)
                ask = np.flatnonzero(row >= least)
                for at in ask[np.argsort(-row[ask], kind="stable")].tolist():
                    if len(held) == TOP and row[at] < -held[-1][0]:
                        break
                    score = exact(at, sets[q])
                    if score >= least:
                        doc = ids[start + at]
                        insort(held, (-score, doc is None, doc or 0, places[start + at]))
                        del held[TOP:]
    out = [(key, place, None if unknown else doc, -score) for key, held in zip(keys, best) for score, unknown, doc, place in held]
    columns = list(zip(*out)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "place", "doc_id", "score"])


def _frequencies(table: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """How many documents have each of the terms."""
    sent = table.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(sent.value)}
        counts = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column("text")):
                counts.update(numbers.keys() & set(terms_of(text)))
        yield pa.RecordBatch.from_pydict({"term": pa.array([numbers[t] for t in counts], pa.int32()), "df": pa.array(list(counts.values()), pa.int64())})

    sums = table.select("text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    # At most one row per term of the block.
    found = {r["term"]: r["df"] for r in sums.collect()}
    sent.unpersist()
    return found


def _block(table: DataFrame, corpus: tuple[int, int], texts: list[tuple[int, bytes]]) -> Queries:
    """The queries of a block; terms that no document has are left out."""
    own = [(key, sorted(set(terms_of(text)))) for key, text in texts]
    terms = sorted({t for _, found in own for t in found})
    df = _frequencies(table, terms) if corpus[1] else {}
    known = [(t, w) for i, t in enumerate(terms) if i in df and (w := weight(df[i], corpus[0])) > 0]
    numbers = {t: i for i, (t, _) in enumerate(known)}
    hashes = _hasher()(pa.array([t for t, _ in known], pa.binary())).hashes[0]
    of = [(key, np.array([numbers[t] for t in found if t in numbers], np.int64)) for key, found in own]
    of = [(key, at) for key, at in of if len(at)]
    return Queries([key for key, _ in of], [t for t, _ in known], hashes, np.array([w for _, w in known], np.int64), [at for _, at in of])


def _top(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "place")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _with_thresholds(table: DataFrame, corpus: tuple[int, int], queries: Queries) -> Queries:
    """Exact scores of the documents with the best bounds of all: the last of the top is a threshold."""
    sent = table.sparkSession.sparkContext.broadcast(queries.sent())

    def nominated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nominated(batches, sent.value, corpus)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(batches, sent.value, corpus)

    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "place")
    first = table.select("place", "n_terms", "sketch").mapInArrow(nominated, "query long, place long, bound double")
    places = stored(first.withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= TOP).select("place").distinct(), "nominated")
    sure = _top(table.join(places, "place", "left_semi").select(_INDEX).mapInArrow(scored, "query long, place long, doc_id long, score long"))
    # One row per query of the block.
    least = {r["query"]: r["score"] for r in sure.where(F.col("rank") == TOP).select("query", "score").collect()}
    sent.unpersist()
    queries.thresholds = [max(least.get(key, 1), 1) for key in queries.keys]
    return queries


def search(table: DataFrame, queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the best documents of the sketches for every row of ``queries``."""
    spark = table.sparkSession
    items = stored(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "search-items")
    corpus = table.agg(F.count(F.when(F.col("n_terms") > 0, 1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    corpus = (int(corpus[0]), int(corpus[1]))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    found = None
    for block in range(blocks):
        own = items.where((F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) & F.col("text").isNotNull()).orderBy("query").select("query", F.col("text").cast("binary").alias("text"))
        asked = _with_thresholds(table, corpus, _block(table, corpus, [(r["query"], bytes(r["text"])) for r in own.toLocalIterator()]))
        part = stored(_matches(table, corpus, asked), "search-found") if blocks > 1 else _matches(table, corpus, asked)
        found = part if found is None else found.unionByName(part)
    return found.join(items.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _matches(table: DataFrame, corpus: tuple[int, int], queries: Queries) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast(queries.sent())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(batches, sent.value, corpus)

    return _top(table.mapInArrow(scored, "query long, place long, doc_id long, score long"))
