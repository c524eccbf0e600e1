"""LM scoring: the probability of a document over all segmentations of its words.

A text is its lower-cased words and an end. A word, with the mark of a space in front, is either one
whole piece, as every word of the training documents is, or any sequence of vocabulary pieces that
spells it; its probability is the sum over all these, by forward recursion in log space. Whole words
are weighted by their counts, less an absolute discount; what the discount leaves goes to the
sequences. There the weight of a piece falls at first with its rank in the vocabulary, which its
existing score tells, and is then learned in ``PASSES`` of expectation and maximization over all
different words of the training documents, once each: what is spelled are rare words. Characters
without a piece are spelled in bytes, of equal weight. The probability of the end, counts and
discount are learned from the training documents, and so is the base model. As weights of pieces add
up to one, and a piece with the mark begins a word, those of all words do not exceed one.

The base model counts the words of all training documents. Every different word of the table is spelled
once, in a table of words with their counts. The commonest ones, ``COMMON`` at most,
are broadcast from it; all others meet their row in a join, so no word is hot there.

Defined results: null and empty text have one token, the end; a null ``doc_id`` counts as the empty
text for the split; repeated rows are scored row by row; an empty training part has N = V = 0 and
leaves all to the sequences.
Extra columns are ignored. """

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.lattice import MODEL, SPACE, Lattice, Vocabulary, by_length, load, utf8_lengths
from wrenchbook.llm.shared import slices, stored, utf8, with_row_key

#: Words whose counts are broadcast: the commonest ones of the training part.
COMMON = 100_000
#: Added to the rank of a piece, whose weight is then inverse.
RANK_SHIFT = 2.7
#: Different words that a task counts before it starts anew.
WORDS_HELD = 300_000
#: Passes over the training words that learn the weights of pieces, and pseudo-count of a piece.
PASSES, PIECE_PSEUDO = 2, 0.1
#: Bounds of the discount, so that both routes to a word stay open.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 0.9

# Fixed values of the base model.
FOLDS, PSEUDO = 10, 0.1


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % FOLDS == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words with their number in training documents, which may be 0; a null word counts these documents."""
    counts: Counter = Counter()
    documents = 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([*counts, None], pa.binary()), "n": pa.array([*counts.values(), documents], pa.int64())})

    for batch in slices(batches):
        for text, out in zip(utf8(batch.column("text")), batch.column("held_out").to_pylist()):
            words = text.lower().split()
            counts.update(dict.fromkeys(words, 0) if out else words)
            documents += not out
        if len(counts) > WORDS_HELD:
            yield told()
            counts, documents = Counter(), 0
    if documents or counts:
        yield told()


def piece_weights(vocabulary: Vocabulary, end: float) -> np.ndarray:
    """Log probability of every piece: inverse to its rank, together 1 - ``end``."""
    usual = vocabulary.ordinary & (vocabulary.scores > -1e8)
    weights = np.zeros(len(vocabulary.pieces))
    weights[usual] = 1 / (RANK_SHIFT - vocabulary.scores[usual])
    weights[list(vocabulary.byte_ids)] = 1 / (RANK_SHIFT + len(vocabulary.pieces))
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum()) + math.log1p(-end)


def learned_weights(vocabulary: Vocabulary, uses: np.ndarray) -> np.ndarray:
    """Log probability of every piece from its expected uses; those of bytes are told at the first one."""
    weights = np.where(vocabulary.ordinary & (vocabulary.scores > -1e8), uses + PIECE_PSEUDO, 0.0)
    weights[list(vocabulary.byte_ids)] = uses[vocabulary.byte_ids[0]] / len(vocabulary.byte_ids) + PIECE_PSEUDO
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())


def discounted(words: int, different: int, once: int, twice: int) -> tuple[float, float]:
    """What is taken from the count of each word, and the probability that a word is spelled in pieces."""
    if not words:
        return 0.0, 1.0
    discount = min(max(once / max(once + 2 * twice, 1), LEAST_DISCOUNT), MOST_DISCOUNT)
    return discount, discount * different / words


class Scorer:
    """Log probabilities of words spelled in pieces; one per task."""

    def __init__(self, vocabulary: Vocabulary, end: float, weights: np.ndarray | None = None) -> None:
        weights = piece_weights(vocabulary, end) if weights is None else weights
        self.lattice = Lattice(vocabulary, np.isfinite(weights) & vocabulary.ordinary)
        self.first_byte = vocabulary.byte_ids[0]
        self.byte = float(weights[self.first_byte])
        self.weights = np.append(weights, -np.inf)

    def _forward(self, edges: list[np.ndarray], loose: np.ndarray, length: int) -> np.ndarray:
        """Log probability of the beginnings of words, over all segmentations."""
        forward = np.full((len(loose), length + 1), -np.inf)
        forward[:, 0] = 0
        for end in range(1, length + 1):
            sizes = range(min(len(edges), end), 0, -1)
            pieces = np.stack([edges[s - 1][:, end - s] for s in sizes], 1)
            steps = self.weights[pieces]
            alone = pieces[:, -1] < 0
            steps[alone, -1] = loose[alone, end - 1]
            steps += forward[:, end - len(sizes) : end]
            most = steps.max(1)
            forward[:, end] = most + np.log(np.exp(steps - most[:, None]).sum(1))
        return forward

    def marginal(self, words: list[str], length: int) -> np.ndarray:
        """Log probability of words of one length, over all segmentations."""
        return self._forward(self.lattice.edges(words, length), self.byte * utf8_lengths(words, length), length)[:, -1]

    def uses(self, words: list[str], length: int) -> np.ndarray:
        """Expected uses of every piece in words of one length; those of all bytes at the first one."""
        edges, n_bytes = self.lattice.edges(words, length), utf8_lengths(words, length)
        # From the back, words are the same lattice with its edges turned round.
        turned = [e[:, ::-1] for e in edges]
        loose = self.byte * n_bytes
        forward, backward = self._forward(edges, loose, length), self._forward(turned, loose[:, ::-1], length)[:, ::-1]
        total, uses = forward[:, -1], np.zeros(len(self.weights) - 1)
        for size, pieces in enumerate(edges, 1):
            row, at = np.nonzero(pieces >= 0)
            used = pieces[row, at]
            share = np.exp(forward[row, at] + self.weights[used] + backward[row, at + size] - total[row])
            uses += np.bincount(used, share, len(uses))
        row, at = np.nonzero(edges[0] < 0)
        uses[self.first_byte] += float((n_bytes[row, at] * np.exp(forward[row, at] + loose[row, at] + backward[row, at + 1] - total[row])).sum())
        return uses


def _learned(words: DataFrame, vocabulary: Broadcast, passes: int) -> np.ndarray:
    """Log weights of the pieces that spell the column ``word``; a pass sends one row per piece at most to the driver."""
    plain = Vocabulary(*vocabulary.value)
    weights = piece_weights(plain, 0.0)
    for _ in range(passes):
        told = words.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], told: Broadcast = told) -> Iterator[pa.RecordBatch]:
            scorer, uses = Scorer(Vocabulary(*vocabulary.value), 0.0, weights=told.value), 0.0
            for batch in slices(batches, "word", 1 << 20):
                for length, group in by_length(SPACE + w.decode() for w in batch.column("word").to_pylist()):
                    uses = uses + scorer.uses(group, length)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32), "uses": np.asarray(uses).reshape(-1)[used]})

        rows = words.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.zeros(len(plain.pieces))
        uses[rows.column("piece").to_numpy()] = rows.column("uses").to_numpy()
        weights = learned_weights(plain, uses)
    return weights


def _spelled(words: DataFrame, vocabulary: Broadcast, weights: np.ndarray) -> DataFrame:
    """``word`` and ``n`` with ``log_spelled``, the log10 probability over all sequences of pieces."""
    told = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Vocabulary(*vocabulary.value), 0.0, weights=told.value)
        for batch in slices(batches, "word", 1 << 20):
            spelled = {SPACE + w.decode(): w for w in batch.column("word").to_pylist()}
            found: dict[bytes, float] = {}
            for length, group in by_length(spelled):
                found.update(zip(map(spelled.get, group), (scorer.marginal(group, length) / math.log(10)).tolist()))
            yield batch.append_column("log_spelled", pa.array([found[w] for w in batch.column("word").to_pylist()], pa.float64()))

    return words.select("word", "n").mapInArrow(run, "word binary, n long, log_spelled double")


def score(docs: DataFrame, model: str = MODEL, passes: int = PASSES) -> DataFrame:
    """One row per row of ``docs``: its tokens, base score and lattice score."""
    spark = docs.sparkSession
    keyed = with_row_key(docs.select("doc_id", "text")).withColumn("held_out", held_out())
    counts = stored(keyed.select("text", "held_out").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, different, ends, once, twice = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)),
        *[F.count_if(F.col("word").isNotNull() & (F.col("n") == n)) for n in (1, 2)],
    ).first()
    # Plain values, which a worker reads without this package.
    vocabulary = spark.sparkContext.broadcast(load(model).values())
    end, words = (ends + 1) / (total + 2), total - ends
    discount, spelled = discounted(words, different - (ends > 0), once, twice)
    weights = _learned(counts.where("word IS NOT NULL AND n > 0").select("word"), vocabulary, passes)
    spelling = stored(_spelled(counts.where("word IS NOT NULL"), vocabulary, weights), "lm-words")
    common = spelling.where("n > 0").orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    # By word the logs of its count and of its probability by either route.
    known = spark.sparkContext.broadcast(
        {
            word: (math.log10(n + PSEUDO), math.log10((n - discount) / words + spelled * 10.0**value))
            for word, n, value in zip(*(common.column(c).to_pylist() for c in ("word", "n", "log_spelled")))
        }
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"row_key long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, score double, word binary, times int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = known.value
        end_log, end_score, word_score = math.log10(ends + PSEUDO), math.log10(end), math.log10(1 - end)
        for batch in slices(batches):
            bags = [Counter(t.lower().split()) for t in utf8(batch.column("text"))]
            tokens, sure, sums, scores = [], [], [], []
            rest_rows, rest_words, rest_times = [], [], []
            for at, bag in enumerate(bags):
                n, found, by_base, by_model = 1, int(ends > 0), end_log, end_score
                for word, times in bag.items():
                    n += times
                    value = logs.get(word)
                    if value is None:
                        rest_rows.append(at)
                        rest_words.append(word)
                        rest_times.append(times)
                    else:
                        found += times
                        by_base += times * value[0]
                        by_model += times * value[1]
                tokens.append(n)
                sure.append(found)
                sums.append(by_base)
                scores.append(by_model + (n - 1) * word_score)
            size, more = len(batch), len(rest_rows)
            keys = batch.column("row_key").to_numpy()
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_pydict(
                {
                    "row_key": np.concatenate([keys, keys[np.array(rest_rows, np.int64)]]),
                    "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(more, kind)]),
                    "held_out": pa.concat_arrays([batch.column("held_out"), pa.nulls(more, pa.bool_())]),
                    "n_tokens": pa.array([*tokens, *([None] * more)], pa.int64()), "n_known": pa.array([*sure, *([None] * more)], pa.int64()),
                    "logs": pa.array([*sums, *([None] * more)], pa.float64()), "score": pa.array([*scores, *([None] * more)], pa.float64()),
                    "word": pa.array([*([None] * size), *rest_words], pa.binary()), "times": pa.array([*([None] * size), *rest_times], pa.int32()),
                }
            )

    told = stored(keyed.mapInArrow(run, fields), "lm-tokens")
    rare = told.where("word IS NOT NULL").select("row_key", "word", "times").join(spelling, "word")
    # A probability of spelling that is too small for a double is one of a word without count, or adds nothing.
    seen = F.log10((F.col("n") - F.lit(discount)) / F.lit(float(max(words, 1))) + F.lit(spelled) * F.pow(F.lit(10.0), F.col("log_spelled")))
    modelled = F.when(F.col("n") > 0, seen).otherwise(F.col("log_spelled") + F.lit(math.log10(spelled)))
    per_row = rare.groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + PSEUDO)).alias("more_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * modelled).alias("more_score"),
    )
    below = math.log10(total + PSEUDO * (different + 1))
    return told.where("word IS NULL").join(per_row, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
