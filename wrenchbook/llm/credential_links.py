"""Secret scans that link the parts of a credential.

Some kinds of text are secrets by themselves: assignments, access keys, long hex strings. Others
are weak: an account name, a mixed token or an endpoint means nothing alone. A weak token is
reported when an identifier or an endpoint stands in its scope, an identifier or an endpoint when
a secret does. The scope of a part is ``REACH`` code points on both sides, inside one text, and the whole
block of settings that it stands in: neighbouring lines that are settings or comments. Parts are
joined by interval: one side stands in the bins that it covers, the other in those that its scope
covers, and a part is kept as soon as one partner overlaps its scope (a semi join), so no pairs
are listed; blocks are joined by their start in the same way. Everything is DataFrame expressions.

Defined results: null text is empty; rows are told apart by their place, so repeated rows and null
ids are rows of their own; weak parts that overlap a strong one are dropped. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchbook.llm.shared import stored, with_row_key

#: Code points between complementary parts, at most, and the width of a bin.
REACH = 200
BIN = 256

# Patterns of the kinds that are reported by themselves, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
STRONG = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))

#: Kinds that are reported with a partner only. A weak token has 16 characters, a letter and a digit.
IDENTIFIER = r"""(?i)(access_?key_?id|client_?id|app_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"""(?i)(https?|ftp|ldap|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+"""
WEAK = (("identifier", IDENTIFIER), ("weak_secret", TOKEN), ("endpoint", ENDPOINT))

#: Two lines or more, each a name with ``:`` or ``=`` behind it or a comment. Possessive, so that long blocks need no stack.
_LINE = r"""[\x20\t]*(?:(?:export\x20|-\x20)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*[:=]|#|//|;)[^\n]*"""
BLOCK = rf"(?<![^\n])(?:{_LINE}(?:\n|\z)){{2,}}+"

_SPAN = "struct<start: bigint, kind: int, end: bigint>"


def _spans(text: Column, pattern: str, kind: int, accept) -> Column:
    """Leftmost matches that do not overlap, as spans; the gaps between them tell where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern), lambda gap: F.length(gap)).alias("gap"), found.alias("match"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def follow(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        kept = F.when(F.coalesce(accept(pair["match"]), F.lit(False)), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    spans = F.aggregate(pairs, first, follow, lambda state: state["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _accept(kind: str):
    if kind == "assign":
        return lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    if kind == "access":
        return lambda m: F.length(m) >= 20
    if kind == "identifier":
        return lambda m: F.length(F.regexp_extract(m, IDENTIFIER, 2)) >= 3
    if kind == "weak_secret":
        return lambda m: F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]"))
    return lambda m: m.isNotNull()


KINDS = tuple(name for name, _ in (*STRONG, *WEAK))


def joined(spans: Column) -> Column:
    """Spans as text, by start and then by kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _strong_and_weak(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, the spans of the strong kinds, all parts that do not overlap one of these, and the blocks of settings."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = [_spans(F.col("text"), pattern, at, _accept(name)) for at, (name, pattern) in enumerate(STRONG)]
    weak = [_spans(F.col("text"), pattern, at + len(STRONG), _accept(name)) for at, (name, pattern) in enumerate(WEAK)]
    rows = with_row_key(docs.select("doc_id", text.alias("text")))
    found = rows.select("row_key", "doc_id", *[s.alias(f"s{i}") for i, s in enumerate(strong)], F.concat(*weak).alias("weak"), _spans(F.col("text"), BLOCK, 0, lambda m: m.isNotNull()).alias("blocks"))
    all_strong = F.concat(*[F.col(f"s{i}") for i in range(len(strong))])
    found = found.withColumn("strong", all_strong)
    clear = F.filter("weak", lambda w: ~F.exists("strong", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return found.withColumn("weak", clear)


def _in_bins(parts: DataFrame, reach: int) -> DataFrame:
    low, high = F.greatest(F.lit(0), F.col("part.start") - reach), F.col("part.end") + reach
    return parts.withColumn("bin", F.explode(F.sequence((low / BIN).cast("long"), (high / BIN).cast("long"))))


def _linked(rows: DataFrame) -> DataFrame:
    """The weak parts that have a partner: ``row_key``, ``part``."""
    weak = rows.select("row_key", F.explode("weak").alias("part"))
    # An access key names an account; assignments and hex strings are secrets.
    partner = rows.where(F.size("weak") > 0).select("row_key", F.explode(F.concat("strong", "weak")).alias("part"))
    secret, named = F.col("part.kind").isin(0, 2, 4), F.col("part.kind").isin(1, 3, 5)
    wide, narrow = _in_bins(weak, REACH).alias("w"), _in_bins(partner, 0).alias("p")
    complementary = (F.col("w.part.kind") == 4) == F.col("p.part.kind").isin(1, 3, 5)
    # A part is no partner of itself, nor of one inside it.
    apart = (F.col("p.part.end") <= F.col("w.part.start")) | (F.col("w.part.end") <= F.col("p.part.start"))
    near = (F.col("w.part.start") - REACH < F.col("p.part.end")) & (F.col("p.part.start") < F.col("w.part.end") + REACH)
    met = wide.where(secret | named).join(
        narrow, (F.col("w.row_key") == F.col("p.row_key")) & (F.col("w.bin") == F.col("p.bin")) & complementary & near & apart, "left_semi"
    )
    # In a block of settings distance does not count; what a part asks for is part of the key.
    block = F.get(F.filter("blocks", lambda b: (b["start"] <= F.col("part.start")) & (F.col("part.start") < b["end"])), F.lit(0))["start"].alias("block")
    asking = rows.select("row_key", "blocks", F.explode("weak").alias("part")).select("row_key", "part", block, (F.col("part.kind") != 4).alias("secret")).where("block IS NOT NULL")
    offered = rows.where(F.size("weak") > 0).select("row_key", "blocks", F.explode(F.concat("strong", "weak")).alias("part"))
    offered = offered.select("row_key", block, secret.alias("secret"), "part").where("block IS NOT NULL").alias("p")
    asking = asking.alias("w")
    same = (F.col("w.row_key") == F.col("p.row_key")) & (F.col("w.block") == F.col("p.block")) & (F.col("w.secret") == F.col("p.secret"))
    together = asking.join(offered, same & apart, "left_semi")
    return met.select("row_key", "part").unionByName(together.select("row_key", "part")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the spans of each strong kind, and those of weak kinds with a partner.

    A span is a struct of start, number of the kind in ``KINDS`` and end, in code points.
    """
    rows = stored(_strong_and_weak(docs), "credential-parts")
    linked = _linked(rows).groupBy("row_key").agg(F.collect_list("part").alias("linked"))
    none = F.array().cast(f"array<{_SPAN}>")
    columns = [F.col(f"s{at}").alias(name) for at, (name, _) in enumerate(STRONG)]
    return rows.join(linked, "row_key", "left").select("doc_id", *columns, F.coalesce("linked", none).alias("linked"))
