"""The application protocol that a payload's first bytes show, and how it agrees with the ports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions.net import protocol_by_port

#: The bytes that a signature looks at.
LOOKED_AT = 1024
#: Priority, protocol, pattern of the payload's start, one character a byte. The least priority that fits wins, then the
#: earlier row.
SIGNATURES = (
    (10, "TLS", r"(?s)\A\x16\x03[\x00-\x04].{3}"),
    (12, "DCE/RPC", r"(?s)\A\x05[\x00\x01][\x00-\x13].(?:[\x10-\x1f\x30-\x3f\x50-\x5f\x70-\x7f\x90-\x9f\xb0-\xbf\xd0-\xdf\xf0-\xff].{3}(?:[\x10-\xff].|.[\x01-\xff])|[^\x10-\x1f\x30-\x3f\x50-\x5f\x70-\x7f\x90-\x9f\xb0-\xbf\xd0-\xdf\xf0-\xff].{3}(?:[\x01-\xff].|.[\x10-\xff])).{6}"),
    (12, "QUIC", r"(?s)\A[\x80-\xff](?:\x00{4}|\x00{3}\x01|\x6b\x33\x43\xcf|\xff.{3})"),
    (15, "HTTP", r"\A(?:GET|POST|PUT|DELETE|HEAD|PATCH|OPTIONS|CONNECT) "),
    (15, "SMB", r"(?s)\A(?:.{4}[\xfe\xff]SMB|[\xfe\xff]SMB.{4})"),
    (16, "HTTP", r"\AHTTP/"),
    (16, "Kerberos", r"(?s)\A[\x6a-\x6f\x74-\x76\x7e].{3}"),
    (18, "DHCP", r"(?s)\A[\x01\x02].{235}\x63\x82\x53\x63"),
    (20, "SSH", r"\ASSH-"),
    (22, "LDAP", None),
    (25, "SMTP", r"(?is)\A220(?:(?!\r\n).)*SMTP"),
    (25, "FTP", r"(?is)\A220(?:(?!\r\n).)*FTP"),
)
#: Pairs of names of one family.
SAME_FAMILY = (("HTTPS", "TLS"), ("HTTP", "HTTP-ALT"), ("HTTP", "HTTP-ALT2"), ("HTTPS", "HTTPS-ALT"))


def letters(data: Column) -> Column:
    """One character a byte, of the first LOOKED_AT bytes."""
    return F.decode(F.substring(data, 1, LOOKED_AT), "ISO-8859-1")


def _byte(text: Column, at: Column) -> Column:
    """The byte at a place from 0; 0 past the end."""
    return F.ascii(F.substr(text, at.cast("int") + 1, F.lit(1)))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _after_length(text: Column, at: Column) -> Column:
    """struct(length, at): a length field of the basic encoding rules, one byte or 128 + n and n bytes, and the place after it."""

    def field(first: Column) -> Column:
        n = F.when(first < 128, 0).otherwise(first - 128)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        long = F.aggregate(places, F.lit(0.0), lambda total, i: total * 256 + _byte(text, at + i))
        return F.struct(F.when(first < 128, first.cast("double")).otherwise(long).alias("length"), (at + 1 + n).alias("at"))

    return once(_byte(text, at), field)


def _ldap(text: Column) -> Column:
    """A sequence of a message number and an application-tagged operation."""
    n = F.length(text)

    def message(outer: Column) -> Column:
        number = lambda inner: (inner["at"] + inner["length"] < n) & _byte(text, inner["at"] + inner["length"]).between(0x60, 0x7F)
        return (outer["length"] > 0) & (outer["at"] < n) & (_byte(text, outer["at"]) == 2) & once(_after_length(text, outer["at"] + 1), number)

    return F.when((n >= 7) & text.startswith("0"), once(_after_length(text, F.lit(1)), message)).otherwise(False)


def by_payload(data: Column) -> Column:
    """The protocol whose signature the payload has; null without one, for payloads under four bytes and null ones."""

    def first(text: Column) -> Column:
        out = F.when((F.length(text) >= 6) & text.startswith("\x16"), "TLS")
        for _, protocol, pattern in reversed(SIGNATURES):
            fits = _ldap(text) if pattern is None else text.rlike(pattern)
            out = F.when(fits, protocol).otherwise(out)
        return out

    return F.when(F.length(data) >= 4, once(letters(data), first))


def classified(payload: Column, transport: str = "transport", src_port: str = "src_port", dst_port: str = "dst_port") -> Column:
    """struct(protocol, by_port, by_payload, confidence, conflict): the protocol of a packet by ports and payload.

    A signature wins over the port. ``confidence``: 'port+payload' where both name one family, 'payload', 'port', or '' without either; a signature
    of another family than the port's is a ``conflict``. A packet without payload has the port's protocol, and no confidence.
    """
    has = F.coalesce(F.length(payload) > 0, F.lit(False))

    def judged(port: Column, seen: Column) -> Column:
        known = port != F.col(transport)
        family = port == seen
        for a, b in SAME_FAMILY:
            family = family | ((port == a) & (seen == b)) | ((port == b) & (seen == a))
        agrees = F.coalesce(family, F.lit(False))
        confidence = F.when(~has, "").when(seen.isNotNull() & known & agrees, "port+payload").when(seen.isNotNull(), "payload").when(known, "port").otherwise("")
        return F.struct(
            F.when(seen.isNotNull() & ~(known & agrees), seen).otherwise(port).alias("protocol"), F.when(has & known, port).otherwise("").alias("by_port"),
            F.coalesce(seen, F.lit("")).alias("by_payload"), confidence.alias("confidence"), (seen.isNotNull() & known & ~agrees).alias("conflict"),
        )

    return once(protocol_by_port(F.col(transport), F.col(src_port), F.col(dst_port)), lambda port: once(by_payload(payload), lambda seen: judged(port, seen)))
