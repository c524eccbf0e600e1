"""Toxicity classifier with counterfactual regularisation.

A logistic regression over the different words of a text, hashed into buckets. A bucket's feature is the log ratio of its
shares of toxic and other documents, so words that say nothing hardly move a weight. Identity terms of labelled texts
are swapped with the other terms of their group; the squared change of the logit under each swap is penalised beside the
loss. Naming a group then says as little as naming another one, however often a group is named in toxic texts.

At most ``LABELLED`` documents are learned from, those with the least hashes of ids. Their features stay a table, and
each step sums the gradient over its parts; what comes to the driver has one number per bucket and part.

Defined results: null and empty texts have no words and the score of the intercept; a document whose labels differ is toxic
if one label says so; a null label or id teaches nothing; without labels each score is 0.5; repeated rows are scored one by
one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.shared import slices, stored
from wrenchbook.llm.wordhash import WordHasher

#: At most so many labelled documents are learned from.
LABELLED = 50_000
#: Word buckets, as a power of two.
BUCKET_BITS = 18
#: Weight decay, price of a changed logit, steps and their size, parts of the feature table.
DECAY, FAIRNESS, STEPS, STEP, PARTS = 1e-3, 0.1, 40, 0.1, 8
#: Least score of a toxic document.
TOXIC = 0.7

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Identity terms; those of one group take each other's places.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"), ("transgender", "cisgender"),
    ("americans", "chinese", "germans", "french", "mexicans", "indians", "russians", "turks", "poles", "nigerians"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"), ("immigrant", "native", "refugee", "foreigner", "citizen"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "hindus", "atheisten"), ("ausländer", "deutsche", "türken", "polen"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "athées"), ("étrangers", "français", "arabes", "africains"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "ateos"), ("extranjeros", "españoles", "mexicanos", "gitanos"),
)


@dataclass(frozen=True)
class Model:
    """Weight of every bucket, its ratio taken in, and the intercept."""

    weights: np.ndarray
    intercept: float
    groups: tuple[tuple[str, ...], ...]


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _hasher() -> WordHasher:
    return WordHasher(separators=PUNCTUATION)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))


class Swaps:
    """Texts, as hashes of different words, with the identity terms of a group moved on to the next ones."""

    def __init__(self, groups: Sequence[Sequence[str]]) -> None:
        terms = sorted({t for group in groups for t in group})
        own = dict(zip(terms, _hasher()(pa.array([t.encode() for t in terms], pa.binary())).hashes[0].tolist()))
        self.most = max((len(g) for g in groups), default=1) - 1
        self.next: dict[int, list[int]] = {}
        for group in groups:
            for at, term in enumerate(group):
                # A term of several groups keeps to the first.
                self.next.setdefault(own[term], [own[group[(at + k + 1) % len(group)]] for k in range(self.most)])
        self.known = np.array(sorted(self.next), np.uint64)

    def __call__(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Buckets that each swap adds and takes away."""
        named = words[np.isin(words, self.known)]
        if not len(named):
            return []
        before, rest, out = _buckets(words), words[~np.isin(words, self.known)], []
        for k in range(self.most):
            after = _buckets(np.concatenate([rest, np.array([self.next[int(t)][k] for t in named], np.uint64)]))
            plus, minus = np.setdiff1d(after, before), np.setdiff1d(before, after)
            if len(plus) or len(minus):
                out.append((plus, minus))
        return out


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``text`` and ``toxic`` of at most ``limit`` documents that may be learned from, repeated rows included."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    per_id = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = per_id.select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("double").alias("is_toxic"))
    # The limit bounds what is broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", F.col("is_toxic").alias("toxic"))


def _features(rows: DataFrame, groups: tuple) -> DataFrame:
    """Rows of labelled documents, and of the changes that swaps make to them, which have no label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, swaps = _hasher(), Swaps(groups)
        for batch in slices(batches):
            words, out = hasher(batch.column("text")), []
            for toxic, own in zip(batch.column("toxic").to_pylist(), words.split(words.hashes[0])):
                own = np.unique(own)
                out.append((toxic, _buckets(own), np.empty(0, np.int32)))
                out += [(None, plus, minus) for plus, minus in swaps(own)]
            labels, plus, minus = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), *(pa.array(x, pa.list_(pa.int32())) for x in (plus, minus))], ["toxic", "plus", "minus"])

    return rows.mapInArrow(run, "toxic double, plus array<int>, minus array<int>")


class _Rows:
    """A batch of feature rows as flat arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.n = len(batch)
        self.lists = [(np.repeat(np.arange(self.n), c.value_lengths().to_numpy()), c.flatten().to_numpy()) for c in (batch.column("plus"), batch.column("minus"))]
        label = batch.column("toxic")
        self.is_swap, self.label = label.is_null().to_numpy(zero_copy_only=False), label.fill_null(0.0).to_numpy()

    def sums(self, values: np.ndarray) -> np.ndarray:
        (row, at), (off_row, off) = self.lists
        return np.bincount(row, values[at], self.n) - np.bincount(off_row, values[off], self.n)

    def spread(self, per_row: np.ndarray) -> np.ndarray:
        (row, at), (off_row, off) = self.lists
        return np.bincount(at, per_row[row], 1 << BUCKET_BITS) - np.bincount(off, per_row[off_row], 1 << BUCKET_BITS)


def _summed(features: DataFrame, of: object) -> np.ndarray:
    """Sum over the table of what ``of`` makes of a batch: numbers in front, then one per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if len(batch):
                total = total + of(_Rows(batch))
        if not isinstance(total, float):
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["total"])

    parts = [np.frombuffer(r["total"], np.float32) for r in features.mapInArrow(run, "total binary").collect()]
    return np.sum(parts, axis=0, dtype=np.float64) if parts else np.zeros(4 + (1 << BUCKET_BITS))


def _shares(toxic: bool):
    def of(rows: _Rows) -> np.ndarray:
        own = (~rows.is_swap & ((rows.label > 0) == toxic)).astype(float)
        return np.concatenate([[own.sum(), rows.is_swap.sum(), 0, 0], rows.spread(own)])

    return of


def _gradient(values: np.ndarray, intercept: float, n: float, n_swaps: float, fairness: float):
    def of(rows: _Rows) -> np.ndarray:
        logit = rows.sums(values)
        error = 1 / (1 + np.exp(-np.clip(logit + intercept, -60, 60))) - rows.label
        pull = np.where(rows.is_swap, 2 * fairness * logit / max(n_swaps, 1), error / n)
        return np.concatenate([[pull[~rows.is_swap].sum(), 0, 0, 0], rows.spread(pull)])

    return of


def fit(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS, groups: Sequence[Sequence[str]] = GROUPS, limit: int = LABELLED) -> Model:
    """Learns from labelled documents that are not held out."""
    groups = tuple(map(tuple, groups))
    features = stored(_features(labelled(docs, labels, limit), groups).repartition(PARTS), "toxicity-features")
    bad, good = (_summed(features, _shares(toxic)) for toxic in (True, False))
    n_bad, n_good, n_swaps = bad[0], good[0], bad[1]
    ratio = np.log(((bad[4:] + 1) / (n_bad + 2)) / ((good[4:] + 1) / (n_good + 2)))
    intercept = float(np.log((n_bad + 1) / (n_good + 1)))
    weights = np.zeros(1 + len(ratio))
    speed, force = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1 if n_bad + n_good else 1):
        pull = _summed(features, _gradient((weights[1:] * ratio).astype(np.float32), intercept + weights[0], n_bad + n_good, n_swaps, fairness))
        slope = np.concatenate([pull[:1], pull[4:] * ratio + DECAY * weights[1:]])
        speed, force = 0.9 * speed + 0.1 * slope, 0.99 * force + 0.01 * slope * slope
        weights -= STEP * (speed / (1 - 0.9**step)) / (np.sqrt(force / (1 - 0.99**step)) + 1e-8)
    return Model((weights[1:] * ratio).astype(np.float32), intercept + float(weights[0]), groups)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``swap_gap``, the largest change of the score under a swap."""
    weights, intercept, groups = docs.sparkSession.sparkContext.broadcast(model.weights), model.intercept, model.groups

    def probability(logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, swaps, of = _hasher(), Swaps(groups), weights.value.astype(np.float64)
        for batch in slices(batches):
            words, scores, gaps = hasher(batch.column("text")), [], []
            for own in words.split(words.hashes[0]):
                own = np.unique(own)
                logit = intercept + of[_buckets(own)].sum()
                scores.append(probability(logit))
                gaps.append(max((abs(probability(logit + of[plus].sum() - of[minus].sum()) - scores[-1]) for plus, minus in swaps(own)), default=0.0))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores, pa.float64()), "swap_gap": pa.array(gaps, pa.float64())})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    judged = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, swap_gap double")
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "swap_gap")
