"""Text, hash and identity expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space at either end, Unicode-aware; the separators 1C-1F count as white space too.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"
# One CJK character, one run of ASCII word characters, or any other visible character.
_COUNTED_TOKEN = r"(?U)[㐀-鿿]|[A-Za-z0-9_]+|[^\s]"
# One CJK character or one run of other letters, digits and underscores.
_SEARCH_TOKEN = r"[一-鿿]|[\p{L}\p{N}_&&[^一-鿿]]+"


def strip(text: Column) -> Column:
    """Remove white space at both ends; plain ``trim`` removes ASCII spaces only."""
    return F.regexp_replace(text, _ENDS, "")


def is_blank(text: Column) -> Column:
    """True for NULL, the empty string and white space."""
    return text.isNull() | ~text.rlike(_VISIBLE)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in lower-case hex."""
    return F.sha2(text, 256)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_COUNTED_TOKEN))


def search_tokens(text: Column) -> Column:
    """Lower-case search tokens as an array, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(_SEARCH_TOKEN), F.lit(0))


def nul_joined(*parts: Column) -> Column:
    return F.concat_ws("\x00", *[p.cast("string") for p in parts])


def business_key(*parts: Column) -> Column:
    """SHA-256 over the NUL-joined parts."""
    return F.sha2(nul_joined(*parts), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (RFC 4122 version 5) without leaving the JVM."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def utf8_prefix(text: Column, max_bytes: int) -> Column:
    """The longest prefix of whole characters that fits in ``max_bytes`` bytes."""
    raw = F.encode(text, "UTF-8")
    # A character starts at the cut when the next byte is no continuation byte (80-BF);
    # at most three bytes have to be given back.
    cut = F.lit(max_bytes)
    for back in (3, 2, 1, 0):
        end = max_bytes - back
        following = F.conv(F.hex(F.substring(raw, end + 1, 1)), 16, 10).cast("int")
        cut = F.when((following >= 128) & (following < 192), cut).otherwise(F.lit(end))
    kept = F.decode(F.call_function("substring", raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(kept)
