"""Derivatives of web archives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.0"
#: Name space of the record ids, so that a rerun gives each record the id it had.
IDS = uuid.UUID("6f1c4bd2-6a0e-5f0e-9a55-3c1d6f6b7a10")
DATE = "2024-01-01T00:00:00Z"

# Fixed values of HTML: elements without shown text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head", "svg")
BLOCKS = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul"
).split()

_HIDDEN = re.compile(r"<(%s)\b[^>]*>.*?(?:</\1\s*>|\Z)" % "|".join(HIDDEN), re.I | re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_BREAK = re.compile(r"</?(?:%s)\b[^>]*>" % "|".join(BLOCKS), re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>?")
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"""<(a|area|link|img|iframe|script)\b[^>]*?\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def plain_text(page: str) -> str:
    """The page's shown text: hidden elements and comments go, block elements end lines, entities are resolved, white space is joined."""
    page = _HIDDEN.sub("\n", _COMMENT.sub("", page))
    page = html.unescape(_TAG.sub("", _BREAK.sub("\n", page)))
    return _LINES.sub("\n", _BLANK.sub(" ", page)).strip()


def title(page: str) -> str:
    found = _TITLE.search(page)
    return _BLANK.sub(" ", html.unescape(found[1]).replace("\n", " ")).strip() if found else ""


def outlinks(page: str, base: str) -> list[str]:
    """'target tag/attribute' of each link in order, once, made absolute by ``base``; bad ones stay as written."""
    out = {}
    for m in _LINK.finditer(_COMMENT.sub("", page)):
        to = html.unescape(next(x for x in (m[3], m[4], m[5]) if x is not None)).strip()
        try:
            to = urljoin(base, to)
        except ValueError:
            pass
        if to:
            out[f"{to} {m[1].upper()}/@{m[2].lower()}"] = None
    return list(out)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, chr(0).join(parts))}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "\r\n".join([VERSION, *(f"{k}: {_line(v)}" for k, v in headers), f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed file; stops at the first that is cut short."""
    out, at = [], 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines if ": " in x)
        size = int(headers.get("Content-Length", -1))
        if not first.startswith("WARC/") or size < 0 or end + 4 + size > len(data):
            break
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


RESPONSE_SCHEMA = "page_id long, record_id string, target_uri string, date string, http_headers string, payload binary, payload_digest string, block_digest string, record binary"
_TEXT, _BIN = pa.string(), pa.binary()
_RESPONSE = pa.schema([("page_id", pa.int64()), ("record_id", _TEXT), ("target_uri", _TEXT), ("date", _TEXT), ("http_headers", _TEXT), ("payload", _BIN), ("payload_digest", _TEXT), ("block_digest", _TEXT), ("record", _BIN)])


def responses(pages: DataFrame) -> DataFrame:
    """Response records of rows (page_id, url, html). The record's id follows from page_id, url, payload and, for rows that repeat
    all three, their number, so no two records share one, and a second run gives the same ids. Null html is an empty payload, a null url an
    empty target, a null page_id stays null and counts as the text 'None' in the id; an empty table gives no rows; other columns are not read.
    A page is one value of one row, as long as it may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page, time in zip(*(c.to_pylist() for c in batch.columns)):
                url, payload = url or "", (page or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                rid, block = record_id("response", str(page_id), url, digest(payload), str(time)), http.encode() + payload
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
                rows.append((page_id, rid, url, DATE, http, payload, digest(payload), digest(block), record(headers, block)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESPONSE)], schema=_RESPONSE)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # rows that repeat are counted before they are dealt out, then come again with their numbers
    counted = rows.groupBy("page_id", "url", "html").agg(F.count(F.lit(1)).alias("times"))
    each = counted.select("page_id", "url", "html", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    return each.mapInArrow(run, RESPONSE_SCHEMA)


DERIVED_SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_headers string, source_digest string, block_digest string, n_links int, block binary, record binary"
_DERIVED = pa.schema([("page_id", pa.int64()), *((n, _TEXT) for n in "warc_type record_id refers_to target_uri date content_type source_headers source_digest block_digest".split()), ("n_links", pa.int32()), ("block", _BIN), ("record", _BIN)])


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response: 'metadata' (title, source headers, outlinks) and 'conversion' (plain text).

    Both refer to the response (WARC-Refers-To) and keep its target, its date and its payload digest
    (WARC-Refers-To-Payload-Digest); the HTTP header lines are kept in the metadata block and in ``source_headers``.
    A payload that isn't UTF-8 is read with replacement characters. Empty payloads give both records with empty blocks or headers alone; each
    response, repeated or not, gives its own two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, rid, url, date, http, payload, source in zip(*(c.to_pylist() for c in batch.columns)):
                page, lines = payload.decode("utf-8", "replace"), [x for x in http.split("\r\n")[1:] if x]
                links = outlinks(page, url)
                fields = [("title", title(page)), *(("http-" + k.lower(), v) for k, _, v in (x.partition(": ") for x in lines)), *(("outlink", x) for x in links)]
                meta = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode()
                for kind, content, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
                    own = record_id(kind, rid)
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To-Payload-Digest", source), ("Content-Type", content), ("WARC-Block-Digest", digest(block))]
                    rows.append((page_id, kind, own, rid, url, date, content, "\r\n".join(lines), source, digest(block), len(links), block, record(headers, block)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DERIVED)], schema=_DERIVED)

    return found.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest").mapInArrow(run, DERIVED_SCHEMA)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """The two derived records of every page; nulls, empties and repeats as in :func:`responses` and :func:`derivatives`."""
    out = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.when(F.col("warc_type") == "conversion", F.col("block").cast("string"))
    return out.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", "block_digest",
        "n_links", F.length("block").alias("block_bytes"), F.sha2("record", 256).alias("record_sha256"), text.alias("text"),
    )
