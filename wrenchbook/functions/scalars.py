"""Time, number and JSON expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenchbook.functions.text import strip

_JSON_KEY = r'"((?:[^"\\]|\\.)*)"\s*:'


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours as a double, to the microsecond, rounded to six digits."""
    return F.round(micros_between(start, end) / F.lit(3.6e9), 6)


def plus_minutes(moment: Column, minutes: Column) -> Column:
    return moment + F.make_dt_interval(mins=minutes.cast("int"))


def plus_days(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days=days.cast("int"))


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text to a naive UTC timestamp; no zone means UTC, bad text gives NULL.

    Relies on a UTC session, which every entry point of the library sets.
    """
    return F.try_to_timestamp(strip(text)).cast("timestamp_ntz")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Four-digit ratio; an empty denominator counts as a perfect score."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(
        F.round(numerator.cast("double") / denominator.cast("double"), 4)
    )


def json_keys_at_any_depth(json_text: Column) -> Column:
    """Lower-case trimmed key names found anywhere in a JSON text.

    A key is a quoted string (escapes allowed) followed by a colon, so quotes
    escaped inside values are not taken for keys.
    """
    return F.transform(F.regexp_extract_all(json_text, F.lit(_JSON_KEY), F.lit(1)), lambda k: F.lower(F.trim(k)))


def literal_map(pairs: dict[str, object]) -> Column:
    """A small fixed map as a literal, so that no join is planned for it."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def lookup(pairs: dict[str, object], key: Column) -> Column:
    """Value of ``key`` in a fixed map, NULL when it is absent."""
    return F.try_element_at(literal_map(pairs), key)
