"""Benchmark decontamination with rare seeds and Smith-Waterman alignment.

Neighbouring pairs of words of the test items are counted in all documents, and the rarest pairs of an item
are its seeds. The passages around the places where a document has a seed are aligned with the whole item, word
by word. A document is contaminated when an alignment reaches ``SHARE`` of the score of the item with itself,
and that of ``LEAST_WORDS`` equal words. Passages that have too few of the item's words for that, in any
order, are not aligned.

How many pairs are seeds follows from the pigeonhole principle: an alignment that reaches ``SHARE`` by changed
and left out words keeps at least n (4 SHARE - 1) / 3 - 1 neighbouring pairs of an item of n words, so one of them
is among all but that many less one, whichever pairs these are. Copies that make pairs common therefore
hide no edited copy. Words that are put in break pairs without a price of their own: a passage is found for certain
while that many pairs stay together.

Items are not broadcast: tasks get bitmaps of fixed size that tell which pairs may matter, and
exact joins follow. Every document and every word is looked at, once for the counts and once for the seeds.

Words are lower-cased and end at white space and punctuation. Defined results: null and empty texts and items
of fewer than ``LEAST_WORDS`` words match nothing, nor do items without an ``item_id``; repeated items count by
their ``item_id``, repeated rows are rows of their own; extra columns are ignored or carried along by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchbook.llm.shared import slices, stored, utf8, with_row_key
from wrenchbook.llm.wordhash import WordHasher, runs

#: Words of a seed, and equal words that an alignment has at least.
GRAM = 2
LEAST_WORDS = 3
#: Size of the bitmaps that tasks get, as a power of two.
BITS = 24
#: Score of an equal word, of a different one, and of a gap; least share of an item's own score.
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.5
#: Words that a passage reaches beyond the item's place on each side.
SLACK = 16
#: Width of the diagonals that one passage covers.
BAND = 64

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


_SPACED = bytes(ord(" ") if byte in PUNCTUATION else byte for byte in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACED).split()


def _hashed(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _grams(hasher: WordHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts of a column, with the number of the text and the place in it."""
    words = hasher(column)
    flat, per = runs(words.hashes[0], words.counts, GRAM)
    return flat, np.repeat(np.arange(len(per)), per), np.arange(len(flat)) - np.repeat(np.cumsum(per) - per, per)


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bitmap of the column ``gram``; what comes to the driver is bounded by its size."""
    places = grams.select(F.shiftrightunsigned("gram", 64 - BITS).alias("place")).distinct()
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits")).toArrow()
    whole = np.zeros(1 << (BITS - 6), np.int64)
    whole[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return whole


def _may_matter(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = (grams >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[place >> 6] >> (place & 63)) & 1 == 1


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(separators=PUNCTUATION)
    for batch in slices(batches):
        grams, which, at = _grams(hasher, batch.column("text"))
        given = {name: batch.column(name).to_numpy()[which] for name in ("item_id", "variant")}
        yield pa.RecordBatch.from_pydict({**given, "gram": grams.view(np.int64), "item_at": at.astype(np.int32)})


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment of two sequences of word hashes, with a linear price for gaps."""
    reach = GAP * np.arange(len(passage) + 1)
    above, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        here = np.maximum(above + GAP, 0)
        here[1:] = np.maximum(here[1:], above[:-1] + np.where(passage == word, MATCH, MISMATCH))
        # A gap in the passage continues from the best cell to the left.
        above = np.maximum.accumulate(here - reach) + reach
        best = max(best, int(above.max()))
    return best


def _hits(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``row_key``, ``gram``, ``at``: places of n-grams that may matter."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(separators=PUNCTUATION)
        for batch in slices(batches):
            grams, which, at = _grams(hasher, batch.column("text"))
            hit = np.flatnonzero(_may_matter(shared.value, grams))
            rows = batch.column("row_key").to_numpy()[which[hit]]
            yield pa.RecordBatch.from_pydict({"row_key": rows, "gram": grams[hit].view(np.int64), "at": at[hit].astype(np.int32)})

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, gram long, at int")


def _times(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``gram``, ``times``: how often n-grams that may matter stand in all documents, added up in each batch first."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(separators=PUNCTUATION)
        for batch in slices(batches):
            grams = _grams(hasher, batch.column("text"))[0]
            own, times = np.unique(grams[_may_matter(shared.value, grams)], return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": own.view(np.int64), "times": times})

    return docs.select("text").mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))


def _seeds(grams: DataFrame, times: DataFrame) -> DataFrame:
    """``item_id``, ``gram``, ``item_at``: the rarest n-grams of every item, as many as one of them must be in a match."""
    of_item = Window.partitionBy("item_id", "variant")
    n = F.count(F.lit(1)).over(of_item)
    # An item has one word more than pairs.
    kept = F.greatest(F.lit(1), F.ceil((n + 1) * (4 * SHARE - 1) / 3) - 1)
    rank = F.row_number().over(of_item.orderBy(F.coalesce("times", F.lit(0)), "gram", "item_at"))
    counted = grams.join(times, "gram", "left").withColumn("rank", rank).withColumn("last", n - kept + 1)
    return counted.where("rank <= last AND times IS NOT NULL").select("item_id", "gram", "item_at")


def _passages(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The words of the asked windows: texts meet their windows on the row, and only the passages go on."""
    asked = windows.groupBy("row_key").agg(F.collect_list(F.struct("item_id", "low", "high")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row, text, own in zip(batch.column("row_key").to_pylist(), utf8(batch.column("text")), batch.column("windows").to_pylist()):
                words = words_of(text)
                out += [(row, w["item_id"], b" ".join(words[max(w["low"], 0) : w["high"]])) for w in own]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({"row_key": pa.array(columns[0], pa.int64()), "item_id": pa.array(columns[1], pa.int64()), "passage": pa.array(columns[2], pa.binary())})

    return docs.select("row_key", "text").join(asked, "row_key").mapInArrow(run, "row_key long, item_id long, passage binary")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        shares = []
        for item, passage in zip(utf8(batch.column("item")), utf8(batch.column("passage"))):
            a, b = _hashed(words_of(item), known), _hashed(passage.split(), known)
            # No alignment scores more than its equal words do.
            least = MATCH * max(SHARE * len(a), LEAST_WORDS)
            score = align(a, b) if MATCH * int(np.isin(a, b).sum()) >= least else 0
            shares.append(score / (MATCH * len(a)) if score >= least else 0.0)
        yield pa.RecordBatch.from_pydict({"row_key": batch.column("row_key"), "item_id": batch.column("item_id"), "share": pa.array(shares, pa.float64())})


def _keyed(docs: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return with_row_key(docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _matches(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``row_key``, ``item_id``, ``share``: the best alignment of every row with every item that reaches ``SHARE``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").distinct()
    # Two texts may have one item_id.
    texts = items.withColumn("variant", F.xxhash64("text"))
    grams = stored(texts.mapInArrow(_item_grams, "item_id long, variant long, gram long, item_at int"), "benchmark-grams")
    seeds = stored(_seeds(grams, _times(keyed, _bitmap(grams))), "benchmark-seeds")
    hits = _hits(keyed, _bitmap(seeds))
    size = items.groupBy("item_id").agg(F.max(F.length("text")).alias("letters"))
    # Seeds on one band of diagonals ask for one passage; the item has at most half as many words as letters.
    asked = hits.join(seeds, "gram").withColumn("band", F.floor((F.col("at") - F.col("item_at")) / BAND)).select("row_key", "item_id", "band").distinct()
    wide = asked.join(size, "item_id").select(
        "row_key", "item_id", (F.col("band") * BAND - SLACK).cast("int").alias("low"), ((F.col("band") + 1) * BAND + SLACK + F.col("letters") / 2 + 1).cast("int").alias("high")
    )
    passages = _passages(keyed, wide)
    texts = items.select("item_id", F.col("text").alias("item"))
    scored = passages.join(texts, "item_id").select("row_key", "item_id", "item", "passage").mapInArrow(_aligned, "row_key long, item_id long, share double")
    best = scored.groupBy("row_key", "item_id").agg(F.max("share").alias("share"))
    return best.where(F.col("share") >= SHARE)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``contaminated``, the ``item_ids`` that it has passages of, and the best ``share``."""
    keyed = _keyed(docs)
    found = _matches(keyed, benchmark).groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    return keyed.select("row_key", "doc_id").join(found, "row_key", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    keyed = _keyed(docs)
    found = stored(_matches(keyed, benchmark).select("row_key").distinct(), "contaminated")
    return keyed.join(found, "row_key", "left_anti").select("row.*")
