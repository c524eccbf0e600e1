"""N-gram Jaccard join with prefixes of token combinations.

A document is the set of its distinct five-word shingles. All sets are ordered alike: rare tokens
first, frequent ones last, by hash within a class. Two sets whose Jaccard similarity reaches the
threshold share at least K tokens of their prefixes of n - ceil(t n) + K tokens (or all that they
share, if these are fewer). So a shared rare token is found by itself; if all shared ones are
frequent, two of them are found as a combination.
Documents with very many frequent tokens in the prefix (members of large groups of copies) would
need too many combinations: they are found by single frequent tokens, which the other documents
offer to them but not to each other.

Equal sets are one class before anything is indexed. Of the classes that meet under a token, each
is compared with one of them, which differs from round to round; groups whose members are in one
component by then need no further pair. After ``ROUNDS`` rounds the pairs between different components
that are left are verified, if they have a common token that stands early enough in both and enough
other tokens that are shared at all. In every round bitmaps must differ in few enough bits: a token of
only one of two sets flips one bit, so more different bits than similar sets may have different tokens
rule a pair out. Bitmaps grow with the sets and are made with their keys, so that whole sets are
written for the pairs that are left only. Every comparison counts the exact intersection.

Frequency is only used to order tokens, so an inexact class costs time but never a link: tokens
count as frequent when the tasks that saw them ``LOCAL_COUNT`` times saw them ``FREQUENT`` times
together, and are told to all tasks as a bitmap of fixed size.

Defined results: null and empty text have no words, 0 shingles, and are linked with nothing; with
fewer than five words the whole sequence is the one shingle; repeated rows are rows of their own
in one component; a null ``doc_id`` takes part but is never the least one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.components import extended
from wrenchbook.llm.shared import MIX_A, MIX_B, mixed, partitions, slices, stored, windows_hash, with_row_key
from wrenchbook.llm.wordhash import WordHasher, runs

SHINGLE = 5
#: Similarity in hundredths from which documents are linked.
SIMILAR = 80
#: Tokens by which prefixes are extended, so many that similar sets share in them.
EXTENDED = 12
#: From so many frequent tokens in a prefix on, single tokens replace their combinations.
MANY_FREQUENT = 8
#: A task reports tokens that it saw in so many different sets.
LOCAL_COUNT = 4
#: Reported sightings that make a token frequent.
FREQUENT = 48
#: Rounds in which the members of a group are compared with one of them.
ROUNDS = 3
#: Size of the bitmap of frequent tokens, and of that of candidate classes, as a power of two.
FREQUENT_BITS = 26
CLASS_BITS = 24
#: Least words of 64 bits of the bitmap that tells how far two sets are apart at least; as many are compared inside a join.
SKETCH_WORDS = 8
#: Shingles that a task gathers before it counts them, postings before it hands them on.
COUNT_FLUSH = 2_000_000
INDEX_FLUSH = 1_000_000

_ALONE, _COMBINED, _OFFERED, _LARGE = 0, 1, 2, 3


def shingle_sets(hasher: WordHasher, column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = hasher(column)
    flat, per = runs(words.hashes[0], words.counts, SHINGLE)
    sets = [np.unique(s) for s in np.split(flat, np.cumsum(per)[:-1])]
    ends = np.cumsum(words.counts)
    for i in np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE)):
        own = words.hashes[0][ends[i] - words.counts[i] : ends[i]]
        sets[i] = windows_hash(own, len(own)) + np.uint64(len(own))
    return sets


def _set_key(tokens: np.ndarray) -> tuple[int, int]:
    a = int(mixed(tokens ^ MIX_A).sum(dtype=np.uint64))
    b = int(mixed(tokens + MIX_B).sum(dtype=np.uint64))
    return a - (1 << 63), b - (1 << 63)


def _positions(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _marked(bitmap: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bitmap[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of at least as many bits as there are tokens, whether an odd number of these fall on it."""
    bits = max(64 * SKETCH_WORDS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer words."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _describe(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Size, key and sketch of every row's set; at the end the tokens that many sets of the task have."""
    hasher, seen, gathered, held = WordHasher(), set(), [], 0

    def report() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(gathered), return_counts=True)
        often = counts >= LOCAL_COUNT
        n = int(often.sum())
        nothing = {"row_key": pa.nulls(n, pa.int64()), "doc_id": pa.nulls(n, id_type), "n": pa.nulls(n, pa.int32()), "key_a": pa.nulls(n, pa.int64()), "key_b": pa.nulls(n, pa.int64()), "sketch": pa.nulls(n, pa.binary())}
        return pa.RecordBatch.from_pydict({**nothing, "token": tokens[often].view(np.int64), "sets": counts[often]})

    for batch in slices(batches):
        sets = shingle_sets(hasher, batch.column("text"))
        keys = [_set_key(s) for s in sets]
        for key, tokens in zip(keys, sets):
            if len(tokens) and key not in seen:
                seen.add(key)
                gathered.append(tokens)
                held += len(tokens)
        yield pa.RecordBatch.from_pydict(
            {
                "row_key": batch.column("row_key"), "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int32()),
                "key_a": pa.array([k[0] for k in keys], pa.int64()), "key_b": pa.array([k[1] for k in keys], pa.int64()),
                "sketch": pa.array([_sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                "token": pa.nulls(len(sets), pa.int64()), "sets": pa.nulls(len(sets), pa.int64()),
            }
        )
        if held > COUNT_FLUSH:
            yield report()
            gathered, held = [], 0
    if gathered:
        yield report()


def _bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``2 ** bits`` bits from a column ``position``; what comes to the driver has that size at most."""
    block = 17

    def pack(group: pa.Table) -> pa.Table:
        at = group.column("position").to_numpy()
        marks = np.zeros(1 << block, bool)
        marks[at & ((1 << block) - 1)] = True
        return pa.table({"block": pa.array([at[0] >> block], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    rows = positions.groupBy(F.shiftright("position", block)).applyInArrow(pack, "block long, marks binary").collect()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        start = row["block"] << (block - 3)
        whole[start : start + (1 << (block - 3))] = np.frombuffer(bytes(row["marks"]), np.uint8)
    return whole


def _signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a set, their kinds and places; the upper bits of a kind count the frequent tokens."""
    n = len(tokens)
    length = min(n, n - -(-SIMILAR * n // 100) + EXTENDED)
    rare = tokens[~frequent][:length]
    often = tokens[frequent][: length - len(rare)]
    a, b = np.triu_indices(len(often) if len(often) <= MANY_FREQUENT else 0, 1)
    keys = [rare, mixed(often[a] * MIX_A + often[b]), mixed(often ^ MIX_B)]
    kinds = np.repeat(np.array([_ALONE, _COMBINED, _OFFERED if len(often) <= MANY_FREQUENT else _LARGE], np.uint8), [len(k) for k in keys])
    # A combination is found wherever its tokens stand.
    places = np.concatenate([np.arange(len(rare)), np.zeros(len(a)), len(rare) + np.arange(len(often))])
    return np.concatenate(keys), kinds | np.uint8(min(len(often), 63) << 2), np.minimum(places, 65535).astype(np.uint16)


def _index(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of the task's different sets, packed by bucket of their key."""
    hasher, seen = WordHasher(), set()
    keys, kinds, places, rows, held = [], [], [], [], 0

    def packed() -> pa.RecordBatch:
        key, kind, place, row = map(np.concatenate, (keys, kinds, places, rows))
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        parts = list(zip(starts, [*starts[1:], len(order)]))

        def column(values: np.ndarray) -> pa.Array:
            values = values[order]
            return pa.array([values[a:b].tobytes() for a, b in parts], pa.binary())

        return pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "keys": column(key), "kinds": column(kind), "places": column(place), "rows": column(row)})

    for batch in slices(batches):
        for row, tokens in zip(batch.column("row_key").to_pylist(), shingle_sets(hasher, batch.column("text"))):
            key = _set_key(tokens)
            if not len(tokens) or key in seen:
                continue
            seen.add(key)
            own, kind, place = _signatures(tokens, _marked(bitmap, _positions(tokens, FREQUENT_BITS)))
            keys.append(own)
            kinds.append(kind)
            places.append(place)
            rows.append(np.full(len(own), row, np.int64))
            held += len(own)
        if held > INDEX_FLUSH:
            yield packed()
            keys, kinds, places, rows, held = [], [], [], [], 0
    if held:
        yield packed()


_GROUPS = pa.schema([("name", pa.int64()), ("weight", pa.int32()), ("row_key", pa.int64()), ("offered", pa.bool_()), ("often", pa.int32()), ("place", pa.int32())])


def _groups(bucket: pa.Table) -> pa.Table:
    """Rows that share a key, each different set of rows once."""
    def whole(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(bucket.column(name).to_pylist()), kind)

    keys, kinds, places, rows = whole("keys", np.uint64), whole("kinds", np.uint8), whole("places", np.uint16), whole("rows", np.int64)
    if not len(keys):
        return _GROUPS.empty_table()
    order = np.lexsort((rows, keys))
    keys, kinds, often, places, rows = keys[order], kinds[order] & 3, kinds[order] >> 2, places[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    # Offered tokens are for sets of many frequent ones: a group needs one of these.
    kind = np.maximum.reduceat(kinds, starts)
    chosen = np.flatnonzero((sizes > 1) & (kind != _OFFERED))
    # Equal member lists have equal sums of hashes; one of the groups that have them stands for all.
    spread = mixed(rows.view(np.uint64) ^ (kinds.astype(np.uint64) << np.uint64(62)))
    name = np.add.reduceat(spread, starts) + kind.astype(np.uint64)
    names, first, alike, weight = np.unique(name[chosen], return_index=True, return_inverse=True, return_counts=True)
    weight *= kind[chosen[first]] != _COMBINED

    def members(groups: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in groups]) if len(groups) else np.empty(0, np.int64)

    # The first place of a member under any key of the group.
    width = sizes[chosen]
    begin = np.cumsum(width[first]) - width[first]
    slot = np.repeat(begin[alike] - (np.cumsum(width) - width), width) + np.arange(width.sum())
    place = np.full(width[first].sum(), 65535, np.int32)
    np.minimum.at(place, slot, places[members(chosen)])
    chosen = chosen[first]
    member = members(chosen)
    return pa.table(
        {
            "name": np.repeat(names, sizes[chosen]).view(np.int64), "weight": np.repeat(weight, sizes[chosen]).astype(np.int32),
            "row_key": rows[member], "offered": kinds[member] == _OFFERED, "often": often[member].astype(np.int32), "place": place,
        },
        schema=_GROUPS,
    )


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of the least size, as columns."""
    for batch in batches:
        words = np.zeros((len(batch), SKETCH_WORDS), np.int64)
        for at, sketch in enumerate(batch.column("sketch").to_pylist()):
            words[at] = _folded(np.frombuffer(sketch, np.uint64), SKETCH_WORDS).view(np.int64)
        yield pa.RecordBatch.from_pydict({"class": batch.column("class"), **{f"bits_{i}": pa.array(words[:, i]) for i in range(SKETCH_WORDS)}})


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches differ in no more bits than similar sets may have different tokens."""
    for batch in batches:
        near = []
        for a, b, m, n in zip(*[batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")]):
            words = min(len(a), len(b)) // 8
            x, y = _folded(np.frombuffer(a, np.uint64), words), _folded(np.frombuffer(b, np.uint64), words)
            overlap = -(-(m + n) * SIMILAR // (100 + SIMILAR))
            near.append(int(np.bitwise_count(x ^ y).sum()) <= m + n - 2 * overlap)
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


class JaccardJoin:
    """The join over one table of documents (``doc_id``, ``text``)."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        self.keyed = with_row_key(docs.select(row, "doc_id", "text"))
        id_type = docs.schema["doc_id"].dataType.simpleString()
        arrow_id = self.spark.createDataFrame([], f"doc_id {id_type}").toArrow().schema.field("doc_id").type
        described = stored(
            self.keyed.select("row_key", "doc_id", "text").mapInArrow(
                lambda batches: _describe(batches, arrow_id), f"row_key long, doc_id {id_type}, n int, key_a long, key_b long, sketch binary, token long, sets long"
            ),
            "jaccard-rows",
        )
        self.rows = described.where("row_key IS NOT NULL").drop("token", "sets", "sketch")
        self._often = described.where("row_key IS NULL").groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= FREQUENT)
        #: One row per different set: its first row and its least id.
        self.classes = stored(
            self.rows.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("row_key").alias("class"), F.min("doc_id").alias("least")), "jaccard-classes"
        )
        # Rows of one class have equal sketches; that of the row that names it is taken.
        self._sketched = described.where("n > 0").select(F.col("row_key").alias("class"), "n", "sketch")

    def _member_groups(self) -> DataFrame:
        """Classes that meet under a key: ``name`` and ``weight`` (keys of one token) of the group, ``class``, ``n``, ``offered``, ``often``, ``place``."""
        frequent = self.spark.sparkContext.broadcast(_bitmap(self._often.select(F.shiftrightunsigned("token", 64 - FREQUENT_BITS).alias("position")), FREQUENT_BITS))
        buckets = 4 * partitions(self.spark)
        packed = self.keyed.select("row_key", "text").mapInArrow(lambda b: _index(b, frequent.value, buckets), "bucket int, keys binary, kinds binary, places binary, rows binary")
        found = packed.groupBy("bucket").applyInArrow(_groups, "name long, weight int, row_key long, offered boolean, often int, place int")
        of_row = self.rows.where("n > 0").join(self.classes, ["key_a", "key_b", "n"]).select("row_key", "class", "n")
        # Different buckets may have found the same group; its keys add up.
        named = found.join(of_row, "row_key").groupBy("name", "class").agg(
            F.first("n").alias("n"), F.sum("weight").alias("weight"), F.min("offered").alias("offered"), F.first("often").alias("often"), F.min("place").alias("place"),
        )
        return stored(named, "jaccard-groups")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """The token sets of the classes in column ``class``."""
        spread = F.shiftrightunsigned(F.xxhash64("class"), 64 - CLASS_BITS)
        marks = self.spark.sparkContext.broadcast(_bitmap(wanted.select(spread.alias("position")), CLASS_BITS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher()
            for batch in slices(batches):
                batch = batch.filter(pa.array(_marked(marks.value, batch.column("position").to_numpy())))
                if len(batch):
                    sets = shingle_sets(hasher, batch.column("text"))
                    yield pa.RecordBatch.from_pydict({"class": batch.column("class"), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

        # A class is named by its first row, and that row alone tells its set.
        rows = self.keyed.select(F.col("row_key").alias("class"), "text").withColumn("position", spread)
        return stored(rows.mapInArrow(run, "class long, tokens binary"), "jaccard-sets")

    def _with_sets(self, sets: DataFrame, wanted: DataFrame) -> DataFrame:
        """``sets`` and those of the classes in ``wanted`` that it lacks."""
        new = stored(wanted.join(sets, "class", "left_anti"), "jaccard-wanted")
        return sets if new.isEmpty() else sets.unionByName(self._sets(new))

    def _near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their sketches do not rule out."""
        left = self._sketched.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        right = self._sketched.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_close, "a long, b long")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("set_a"))
        right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("set_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_common, "a long, b long")

    def roots(self) -> DataFrame:
        """``node`` and ``root``, the least class that it is linked with; classes without links are not listed."""
        groups = self._member_groups()
        compared = self.spark.createDataFrame([], "a long, b long")
        sets = self.spark.createDataFrame([], "class long, tokens binary")
        known = self.spark.createDataFrame([], "node long, root long")
        placed = groups.withColumn("root", F.col("class"))
        for number in range(ROUNDS + 1):
            pairs = self._stars(placed, number) if number < ROUNDS else self._between(stored(self._open_members(groups, placed), "jaccard-open"))
            pairs = stored(self._near(pairs.join(compared, ["a", "b"], "left_anti")), "jaccard-pairs")
            if pairs.isEmpty():
                continue
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
            sets = self._with_sets(sets, wanted)
            compared = compared.unionByName(pairs)
            links = stored(self._verified(pairs, sets), "jaccard-links")
            known = extended(known, links, "jaccard-near")
            placed = groups.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        return known

    def _stars(self, placed: DataFrame, number: int) -> DataFrame:
        """Pairs of one member of a group, another one in every round, with those of other components."""
        near = (F.col("n") * 100 >= F.col("first.n") * SIMILAR) & (F.col("first.n") * 100 >= F.col("n") * SIMILAR)
        # A member that is offered can only be a partner, so the first one is not, if there is one.
        first = placed.groupBy("name").agg(F.min(F.struct("offered", F.xxhash64("class", F.lit(number)), "class", "n", "root")).alias("first"))
        apart = (F.col("root") != F.col("first.root")) & ~(F.col("offered") & F.col("first.offered"))
        stars = placed.join(first, "name").where(near & apart)
        return stars.select(F.least("first.class", "class").alias("a"), F.greatest("first.class", "class").alias("b")).distinct()

    def _open_members(self, groups: DataFrame, placed: DataFrame) -> DataFrame:
        """Members of groups that more than one component has part in, with the number of their shareable tokens."""
        mixed_groups = placed.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("name")
        # At most the keys that a set shares with any other one, and what stands behind the prefixes, can be
        # common. Frequent tokens are keys of their own only beside a set that has many.
        uncounted = F.when(F.max("often") > MANY_FREQUENT, 0).otherwise(F.max("often"))
        shareable = groups.groupBy("class").agg((F.sum("weight") + uncounted).alias("shareable"))
        members = placed.join(mixed_groups, "name").join(shareable, "class")
        return members.select("name", "class", "root", "n", "offered", "place", "shareable")

    def _between(self, rest: DataFrame) -> DataFrame:
        """Pairs of a group that are in different components and may be similar."""
        bits = [f"bits_{i}" for i in range(SKETCH_WORDS)]
        sketched = self._sketched.join(rest.select("class"), "class", "left_semi").mapInArrow(_short, ", ".join(["class long", *[f"{b} long" for b in bits]]))
        open_members = rest.join(sketched, "class")
        x, y = open_members.alias("x"), open_members.alias("y")

        def behind(n: str) -> Column:
            return F.greatest(F.lit(0), F.ceil(F.col(n) * SIMILAR / 100) - EXTENDED)

        overlap = F.ceil((F.col("x.n") + F.col("y.n")) * SIMILAR / (100 + SIMILAR))
        needed = overlap - F.greatest(behind("x.n"), behind("y.n"))
        # The first common token stands before those that the pair must have in common.
        early = (F.col("x.place") <= F.col("x.n") - overlap) & (F.col("y.place") <= F.col("y.n") - overlap)
        different = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits), F.lit(0))
        close = different <= F.col("x.n") + F.col("y.n") - 2 * overlap
        apart = (
            (F.col("x.name") == F.col("y.name")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.class") < F.col("y.class"))
            & ~(F.col("x.offered") & F.col("y.offered")) & (F.least("x.shareable", "y.shareable") >= needed) & early
            & (F.col("x.n") * 100 >= F.col("y.n") * SIMILAR) & (F.col("y.n") * 100 >= F.col("x.n") * SIMILAR) & close
        )
        return x.join(y, apart).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()

    def components(self) -> DataFrame:
        """One row per row of ``docs``; ``root`` is the class that names the component."""
        placed = self.classes.join(self.roots(), F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
        ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        of_class = placed.join(ids, "root").select("key_a", "key_b", "n", "root", "component_id")
        # Sets of no shingle have a key too, but no class.
        joined = self.rows.join(of_class, ["key_a", "key_b", "n"], "left")
        own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return joined.select("row_key", "doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "root")


def near_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links, for every row."""
    return JaccardJoin(docs).components().drop("row_key", "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that have a row before them in their component.

    The row with the least ``doc_id`` stays, of equal ids the first one; rows without words stay.
    """
    join = JaccardJoin(docs)
    placed = stored(join.components(), "jaccard-placed")
    texts = placed.where("n_shingles > 0")
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias("row_key"))
    later = texts.select("row_key").join(first, "row_key", "left_anti")
    return join.keyed.join(later, "row_key", "left_anti").select("row.*")
