"""Byte-level text rules, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One well-formed UTF-8 sequence of two to four bytes, written over the
# ISO-8859-1 view of the bytes (one character per byte).
_SEQUENCE = (
    r"(?:[\xC2-\xDF][\x80-\xBF]"
    r"|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})"
)

# A byte outside every well-formed sequence: a lead that starts none, or a
# continuation that is the second, third or fourth byte of none.
_STRAY_BYTE = (
    rf"(?s)(?!{_SEQUENCE})[\xC0-\xFF]"
    rf"|(?<!(?={_SEQUENCE})[\xC2-\xF4])"
    rf"(?<!(?={_SEQUENCE})[\xE0-\xF4].)"
    rf"(?<!(?={_SEQUENCE})[\xF0-\xF4]..)[\x80-\xBF]"
)

# U+0100 cannot occur in an ISO-8859-1 text, so it marks stray bytes safely.
_MARK = "Ā"
_REPLACEMENT_AS_LATIN1 = "ï¿½"  # EF BF BD, the bytes of U+FFFD


def valid_utf8(text: Column) -> Column:
    """Replace each run of invalid UTF-8 bytes with one U+FFFD.

    Valid values pass through untouched; only invalid ones pay for the repair.
    """
    latin1 = F.decode(text.cast("binary"), "ISO-8859-1")
    marked = F.regexp_replace(latin1, _STRAY_BYTE, _MARK)
    repaired = F.regexp_replace(marked, f"{_MARK}+", _REPLACEMENT_AS_LATIN1)
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(repaired, "ISO-8859-1").cast("string"))


def truncate_bytes(text: Column, limit: int) -> Column:
    """Return the longest prefix of at most ``limit`` bytes on a character boundary."""
    if limit <= 0:
        return F.lit("")
    data = text.cast("binary")
    # The byte after the cut has to start a character; back up at most three bytes.
    cut = F.lit(max(limit - 3, 0))
    for back in range(min(limit, 3) - 1, -1, -1):
        following = F.substring(data, limit + 1 - back, 1)
        cut = F.when(_is_continuation(following), cut).otherwise(F.lit(limit - back))
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.substring(data, F.lit(1), cut).cast("string")
    )


def _is_continuation(byte: Column) -> Column:
    return byte.between(F.unhex(F.lit("80")), F.unhex(F.lit("BF")))


def ascii_lower(text: Column) -> Column:
    """Lower A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(text: Column) -> Column:
    """Upper a-z only."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
