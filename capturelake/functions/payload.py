"""Functions of payload bytes and time texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the entropy bands and their names.
BANDS = (
    (1.0, "Structured/repetitive"), (3.5, "Low entropy (structured binary)"), (5.0, "Text/markup"),
    (6.5, "Mixed/encoded"), (7.5, "High entropy (compressed)"),
)
LAST_BAND = "Likely encrypted/compressed"
LEAST_BYTES = 16


def _letters(data: Column) -> Column:
    """One character a byte."""
    return F.decode(data, "ISO-8859-1")


def entropy(data: Column) -> Column:
    """Shannon entropy of the bytes in bits, to two places; null below 16 bytes."""
    text, n = _letters(data), F.length(data)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n >= LEAST_BYTES, F.round(F.aggregate(F.transform(kinds, share), F.lit(0.0), lambda a, p: a - p * F.log2(p)), 2))


def entropy_label(value: Column) -> Column:
    out = F.lit(LAST_BAND)
    for end, name in reversed(BANDS):
        out = F.when(value < end, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def hex_dump(data: Column) -> Column:
    """Lines of offset, 16 bytes in hexadecimal and their printable characters; '' without bytes."""

    def line(i: Column) -> Column:
        piece = F.substring(data, i * 16 + 1, F.lit(16))
        pairs = F.btrim(F.regexp_replace(F.lower(F.hex(piece)), "(..)", "$1 "))
        offset = F.lower(F.hex(i * 16))
        return F.concat(F.lpad(offset, F.greatest(F.length(offset), F.lit(4)), F.lit("0")), F.lit("  "), F.rpad(pairs, 47, " "), F.lit("  "), F.regexp_replace(_letters(piece), r"[^\x20-\x7e]", "."))

    lines = F.transform(F.sequence(F.lit(0), F.floor((F.length(data) - 1) / 16).cast("int")), line)
    return F.when(F.length(data) > 0, F.array_join(lines, "\n")).otherwise("")


def iso_epoch(text: Column) -> Column:
    """Seconds of an ISO-8601 time, with Z or an offset or in the session's zone; null for other texts."""
    return F.unix_micros(text.try_cast("timestamp")) / 1_000_000
