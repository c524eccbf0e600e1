"""Quality rules: hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Two multinomials over hashed word n-grams are counted, one over the trusted documents and one
over all. A document's score is its mean log ratio, averaged over the orders by weight. Each document is judged without its own
counts, so trusted ones are no better off for having been counted. Pseudo-counts draw rare
n-grams towards ratio one. The threshold is a low
quantile of the trusted scores: the share of good documents that may be lost.

Defined results: null or empty text has no words, score 0 and fails the base rules; a null
``doc_id`` is never trusted; repeated rows are judged one by one; an empty table or one without
trusted rows gives threshold minus infinity, so the base rules decide alone. Extra columns are
carried along by ``keep`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchbook.functions.ordering import with_running_sum
from wrenchbook.llm.shared import slices, stored, utf8, with_text
from wrenchbook.llm.wordhash import SPACES, WordHasher, Words, per_text, runs

#: Count buckets of each order as a power of two: the size bound of the model that is broadcast.
BUCKET_BITS = 20
#: The n-grams that are counted, each order in buckets of its own: length, pseudo-count of a bucket, weight.
ORDERS = ((1, 5.0, 1.0), (2, 20.0, 0.5))
#: So many trusted ids are sent to all tasks; more of them meet the documents in a shuffled join.
TRUSTED_SENT = 2_000_000
#: Bytes of text that a task works on at once, and rows of counts that it hands on at once: other stages' workers stay beside it.
WORKED_ON, HANDED_ON = 1 << 20, 1 << 16
#: Share of trusted documents below the threshold.
TRUSTED_LOSS = 0.01

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

JUDGED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


@dataclass(frozen=True)
class Model:
    """Counts per bucket of trusted and of all documents, and the least score of a kept document."""

    counts: Broadcast
    threshold: float
    trusted: DataFrame


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents that are labelled good and never toxic."""
    per_id = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return per_id.where("q = 1 AND t = 0").select(F.col("doc_id").alias("trusted_id"))


def _buckets(words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per document the buckets of its n-grams, one array per order."""
    shift, orders = np.uint64(64 - BUCKET_BITS), []
    for at, (order, _, _) in enumerate(ORDERS):
        flat, counts = runs(hashes, words.counts, order)
        orders.append(np.split((flat >> shift).astype(np.int64) + (at << BUCKET_BITS), np.cumsum(counts)[:-1]))
    return list(zip(*orders))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, hasher = len(ORDERS) << BUCKET_BITS, WordHasher()
    # No task has more n-grams than fit.
    raw, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for batch in slices(batches, size=WORKED_ON):
        words = hasher(batch.column("text"))
        per_doc = _buckets(words, words.hashes[0])
        good = batch.column("trusted").to_pylist()
        for total, parts in ((raw, per_doc), (target, [own for own, is_good in zip(per_doc, good) if is_good])):
            for at in range(len(ORDERS)) if parts else ():
                low = at << BUCKET_BITS
                total[low : low + (1 << BUCKET_BITS)] += np.bincount(np.concatenate([own[at] for own in parts]) - low, minlength=1 << BUCKET_BITS)
    for low in range(0, size, HANDED_ON):
        used = np.flatnonzero(raw[low : low + HANDED_ON]) + low
        counts = (pa.array(c[used].astype(np.int64)) for c in (raw, target))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *counts], ["bucket", "raw", "target"])


def _score(own: list[np.ndarray], is_trusted: bool, raw: np.ndarray, target: np.ndarray, totals: list[tuple[float, float]]) -> float:
    score = weights = 0.0
    for buckets, (_, prior, weight), (all_raw, all_target) in zip(own, ORDERS, totals):
        if n := len(buckets):
            used, counts = np.unique(buckets, return_counts=True)
            mine = counts if is_trusted else 0
            scale = (all_target - (n if is_trusted else 0)) / max(all_raw - n, 1.0)
            ratio = np.log((target[used] - mine + prior) / ((raw[used] - counts) * scale + prior))
            score += weight * float((counts * ratio).sum()) / n
            weights += weight
    return score / weights if weights else 0.0


def _repeated_words(hashes: np.ndarray) -> int:
    """Words inside a window of three that is found twice or more."""
    if len(hashes) < 4:
        return 0
    keys = runs(hashes, np.array([len(hashes)]), 3)[0]
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    covered = np.zeros(len(hashes), bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def _repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def _judge(batch: pa.RecordBatch, hasher: WordHasher, model: tuple, threshold: float) -> dict[str, list | np.ndarray]:
    words = hasher(batch.column("text"))
    lower, exact = words.hashes
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    first_byte = hasher.inside & ((np.arange(256) & 0xC0) != 0x80)
    trusted = batch.column("trusted").to_pylist()
    scores = [_score(own, bool(t), *model) for own, t in zip(_buckets(words, lower), trusted)]
    repeated = np.array([_repeated_words(h) for h in words.split(exact)], np.int64)
    failed = (words.counts < MIN_WORDS) | (100 * repeated > 50 * words.counts)
    return {
        "n_words": words.counts,
        "word_chars": per_text(first_byte[words.data], words.offsets),
        "n_symbols": per_text(symbol[words.data], words.offsets),
        "n_dup_lines": [_repeated_lines(t) for t in utf8(batch.column("text"))],
        "n_repeat_words": repeated,
        "base_failed": failed,
        "score": np.array(scores, float),
        "kept": ~failed & (np.array(scores, float) >= threshold),
    }


def _sent(trusted: DataFrame, n: int) -> DataFrame:
    return F.broadcast(trusted) if n <= TRUSTED_SENT else trusted.hint("merge")


def _with_trust(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    return docs.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id")


def _loss_threshold(scores: DataFrame, loss: float) -> float | None:
    """The exact ``loss`` quantile of column ``score``, between its two nearest rows as ``percentile`` does.

    Bounds of an approximate quantile leave few scores, of which those of the wanted places are taken; no task sees all.
    """
    n = scores.count()
    if not n:
        return None
    place = (n - 1) * loss
    below, error = int(place), 1e-3
    low, high = scores.approxQuantile("score", [max(below / n - 4 * error, 0.0), min((below + 2) / n + 4 * error, 1.0)], error)
    before = scores.where(F.col("score") < low).count()
    near = scores.where((F.col("score") >= low) & (F.col("score") <= high)).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Few hundredths of the scores, summed up by ranges of their order.
    placed = with_running_sum(near.withColumn("one", F.lit(1)), ["one"], ["score"], F.col("n"), "upto", F.floor(F.col("score") * 4096))
    first, second = (placed.where(F.col("upto") + before > at).agg(F.min("score")).first()[0] for at in (below, min(below + 1, n - 1)))
    return first + (place - below) * (second - first)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all documents and the threshold that the trusted ones set."""
    spark = docs.sparkSession
    ids = stored(trusted_ids(labels), "trusted-ids")
    trusted = _sent(ids, ids.count())
    texts = _with_trust(docs.select("doc_id", "text"), trusted)
    sums = texts.select("text", "trusted").mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    # At most one row per bucket comes back, whatever the size of the corpus.
    rows = sums.toArrow()
    at, most = rows.column("bucket").to_numpy(), max(rows.column("raw").to_pylist(), default=0)
    raw, target = (np.zeros(len(ORDERS) << BUCKET_BITS, np.int32 if most < 1 << 31 else np.int64) for _ in range(2))
    raw[at], target[at] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    totals = [tuple(float(c.sum(dtype=np.int64)) for c in own) for own in zip(np.split(raw, len(ORDERS)), np.split(target, len(ORDERS)))]
    counts = spark.sparkContext.broadcast((raw, target, totals))
    open_model = Model(counts, float("-inf"), trusted)
    good = judge(docs.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi"), open_model)
    least = _loss_threshold(stored(good.where("NOT base_failed").select("score"), "trusted-scores"), TRUSTED_LOSS)
    return Model(counts, float("-inf") if least is None else least, trusted)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` with its counts, ``base_failed``, ``score`` and ``kept``."""
    counts, threshold = model.counts, model.threshold
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(("lower", "exact"))
        for batch in slices(batches, size=WORKED_ON):
            columns = _judge(batch, hasher, counts.value, threshold)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns})

    return _with_trust(docs.select("doc_id", "text"), model.trusted).mapInArrow(run, f"doc_id {id_type}, {JUDGED}")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    counts, threshold = model.counts, model.threshold
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(("lower", "exact"))
        for batch in slices(with_text(batches), size=WORKED_ON):
            kept = _judge(batch, hasher, counts.value, threshold)["kept"]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["row"])

    row_type = plain.schema["row"].dataType.simpleString()
    return _with_trust(plain, model.trusted).select("row", "trusted").mapInArrow(run, f"row {row_type}").select("row.*")
