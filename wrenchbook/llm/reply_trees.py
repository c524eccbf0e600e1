"""Chat formatting of reply trees.

A tree's nodes know their parent. Iterative self-joins double the reach of every node's link to
its ancestors until all links have passed the root, and add up scores on the way; after k rounds
trees of depth 2^k are done. The leaves of a tree are its branches, ranked by the score of their
path. The chosen leaves then walk back: each of the stored rounds, the longest first, doubles the
number of nodes that are known of a path. Every round is written, so plans stay small.

A path is one conversation. Every turn stands between control strings of its role, and control
characters inside texts and roles are escaped by a backslash, so no text can end a turn, and the
formatted string can be parsed back. The loss mask lists the escaped assistant texts.

Defined results: null text and null role are empty; other roles than the three known ones name
themselves in the string; turns of equal number follow each other by role and text; a
node whose parent is missing is a root; a node in a cycle is in no path; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.functions.ordering import by_number, with_previous
from wrenchbook.llm.shared import stored

# The template: what stands before and after a turn of each role.
TURNS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_ESCAPED = r"([\\<\[|])"

FORMATTED = "formatted string, n_turns long, loss array<struct<start: long, end: long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turns_as_tree(turns: DataFrame) -> DataFrame:
    """Conversations of numbered turns as trees with one branch: every turn replies to the one before it."""
    plain = turns.select(
        F.col("conv_id").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Repeated rows differ in a number; numbers of different rows need not be dense.
    counted = plain.groupBy("tree", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    single = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    named = single.withColumn("at", F.coalesce("turn", F.lit(-(1 << 62)))).withColumn("node", F.sha2(F.to_json(F.struct("at", "role", "text", "copy")), 256))
    linked = with_previous(named, ["tree"], ["at", "role", "text", "copy"], ["node"], by_number("at"))
    return linked.select("tree", "node", F.col("previous.node").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """For every round ``tree``, ``node``, ``up`` (the ancestor 2^k above, null beyond the root), ``sum`` and ``steps`` of the nodes below it."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    first = nodes.alias("n").join(known.alias("k"), _same("n.tree", "k.tree") & (F.col("n.parent") == F.col("k.parent")), "left").select(
        "n.tree", "n.node", F.when(F.col("k.there"), F.col("n.parent")).alias("up"), F.col("n.score").alias("sum"), F.lit(1).cast("long").alias("steps")
    )
    rounds, before = [stored(first, "reply-links")], -1
    # A tree has nodes of every depth up to its own, so links that do not get fewer are cycles.
    while (left := rounds[-1].where("up IS NOT NULL").count()) not in (0, before):
        before = left
        # Only nodes whose link has not passed the root take part.
        low, high = rounds[-1].where("up IS NOT NULL").alias("low"), rounds[-1].alias("high")
        joined = low.join(high, _same("low.tree", "high.tree") & (F.col("low.up") == F.col("high.node")))
        done = rounds[-1].where("up IS NULL")
        rounds.append(
            stored(
                joined.select(
                    "low.tree", "low.node", F.col("high.up").alias("up"),
                    (F.col("low.sum") + F.coalesce("high.sum", F.lit(0.0))).alias("sum"), (F.col("low.steps") + F.coalesce("high.steps", F.lit(0))).alias("steps"),
                ).unionByName(done),
                "reply-links",
            )
        )
    return rounds


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """The turns of the best ``branches`` paths of each tree (None: all): ``tree``, ``leaf``, ``rank``, ``place``, ``role``, ``text``.

    ``nodes``: ``tree``, ``node``, ``parent``, ``role``, ``text``, ``score``. Branches are ranked by the
    sum of their scores, then by leaf.
    """
    rounds = _ancestors(nodes)
    parents = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    # Nodes that still have an ancestor after the last round are in a cycle or below one.
    leaves = rounds[-1].where("up IS NULL").alias("l").join(parents.alias("p"), _same("l.tree", "p.tree") & (F.col("l.node") == F.col("p.node")), "left_anti")
    if branches == 1:
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("sum")).alias("worse"), F.col("node").alias("leaf"), F.col("steps").alias("length"))).alias("b"))
        chosen = best.select("tree", "b.leaf", "b.length", F.lit(1).alias("rank"))
    else:
        # One more than the branches that are better; a group of all branches is not gathered in memory.
        order = "row_number() OVER (PARTITION BY tree ORDER BY sum DESC, node)"
        chosen = leaves.select("tree", F.col("node").alias("leaf"), F.col("steps").alias("length"), F.expr(order).alias("rank"))
        chosen = chosen if branches is None else chosen.where(F.col("rank") <= branches)
    walked = chosen.withColumn("node", F.col("leaf")).withColumn("place", F.col("length"))
    for number in range(len(rounds) - 1, -1, -1):
        up = rounds[number].where("up IS NOT NULL").alias("u")
        above = walked.alias("w").join(up, _same("w.tree", "u.tree") & (F.col("w.node") == F.col("u.node"))).select(
            "w.tree", "w.leaf", "w.length", "w.rank", F.col("u.up").alias("node"), (F.col("w.place") - (1 << number)).alias("place")
        )
        walked = stored(walked.unionByName(above), "reply-paths")
    texts = nodes.select("tree", "node", "role", "text").alias("n")
    return walked.alias("w").join(texts, _same("w.tree", "n.tree") & (F.col("w.node") == F.col("n.node"))).select("w.tree", "w.leaf", "w.rank", "w.place", "n.role", "n.text")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per path: ``tree``, ``rank``, ``formatted``, ``n_turns`` and the ``loss`` spans in it (code points)."""
    text, role = escape(F.coalesce("text", F.lit(""))), escape(F.coalesce("role", F.lit("")))
    before, after = F.concat(F.lit("<|"), role, F.lit("|> ")), F.lit(" <|end|>")
    for name, (start, end) in TURNS.items():
        before, after = F.when(F.col("role") == name, F.lit(start)).otherwise(before), F.when(F.col("role") == name, F.lit(end)).otherwise(after)
    piece = F.struct("place", F.length(before).alias("skip"), F.length(text).alias("size"), (F.coalesce("role", F.lit("")) == "assistant").alias("counts"), F.concat(before, text, after).alias("whole"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("loss"))

    def follow(state: Column, p: Column) -> Column:
        start = state["at"] + p["skip"]
        span = F.array(F.struct(start.alias("start"), (start + p["size"]).alias("end")))
        return F.struct((state["at"] + F.length(p["whole"])).alias("at"), F.when(p["counts"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"))

    return whole.select(
        "tree", "rank", F.array_join(F.transform("pieces", lambda p: p["whole"]), "").alias("formatted"), F.size("pieces").cast("long").alias("n_turns"),
        F.aggregate("pieces", first, follow, lambda state: state["loss"]).alias("loss"),
    )


_BODY = r"((?:[^\\<\[|]|\\.)*)"
_TURN = re.compile(
    "|".join([re.escape(start) + _BODY + re.escape(end) for start, end in TURNS.values()] + [r"<\|" + _BODY + r"\|> " + _BODY + r" <\|end\|>"]), re.DOTALL
)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        *known, role, body = found.groups()
        named = [(name, own) for name, own in zip(TURNS, known) if own is not None]
        name, own = named[0] if named else (unescape(role), body)
        out.append((name, unescape(own)))
        at = found.end()
    return out


def parsed(conversations: DataFrame) -> DataFrame:
    """Reads formatted strings back: ``tree``, ``rank``, ``turns`` and ``learned``, the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(text)] for text in texts]
            learned = ["".join(unescape(text[s["start"] : s["end"]]) for s in spans) for text, spans in zip(texts, batch.column("loss").to_pylist())]
            yield pa.RecordBatch.from_pydict({"tree": batch.column("tree"), "rank": batch.column("rank"), "formatted": batch.column("formatted"), "turns": pa.array(turns, kind), "learned": pa.array(learned, pa.string())})

    tree = conversations.schema["tree"].dataType.simpleString()
    columns = conversations.select("tree", "rank", "formatted", "loss")
    return columns.mapInArrow(run, f"tree {tree}, rank int, formatted string, turns array<struct<role: string, text: string>>, learned string")
