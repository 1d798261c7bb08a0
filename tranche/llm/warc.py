"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response record is read as bytes (WARC header, HTTP header, payload). Two records follow from it:
`metadata`, a JSON block with the response's WARC and HTTP headers, title and links, and `conversion`, the
page's text. Both refer to the response by its id, keep its target, date and payload digest, and carry a
digest of their own block; ids follow from the response's id, so reruns agree.

Defined results: null HTML is an empty payload with an empty text; null url is an empty target; a record that
is not a whole response (wrong type or cut off) gives no derivatives but a row of type `rejected`; repeated
records each give their own rows.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_slices

DATE = "2024-01-01T00:00:00Z"
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "article", "section", "header", "footer", "nav", "aside", "blockquote", "pre", "body", "title", "head", "html", "main", "form", "hr", "figure", "figcaption"}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>?", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ROWS = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, header string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(of).encode()).digest()[:16], version=4)}>"


def serialise(header: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in header).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(raw: bytes) -> list[tuple[str, str]]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()]


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields and block of a record; ValueError if it is no whole record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, _, head = head.partition(b"\r\n")
    header = fields(head)
    size = next((int(v) for k, v in header if k.lower() == "content-length" and v.isdigit()), -1)
    if not found or not first.startswith(b"WARC/") or not 0 <= size <= len(rest):
        raise ValueError("not a whole record")
    return header, rest[:size]


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """The response record of a page."""
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = re.sub(r"[\r\n]", "", url or "")
    header = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), target)), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return serialise(header, block)


def text_and_links(page: str) -> tuple[str, str, list[str]]:
    """Text (a line per block of the page), title and links of a page."""
    out, at, links = [], 0, []
    for m in MARKUP.finditer(page):
        out.append(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if m[1] is None and (name := NAME.match(tag)):
            if name[1].lower() in BREAKS:
                out.append("\0")
            if "=" in tag:
                links += [html.unescape(a or b or c) for a, b, c in LINK.findall(tag)]
    out.append(page[at:])
    lines = (" ".join(html.unescape(x).split()) for x in "".join(out).split("\0"))
    title = TITLE.search(page)
    return "\n".join(x for x in lines if x), " ".join(html.unescape(title[1]).split()) if title else "", links


def derive(record: bytes) -> list[dict]:
    """Metadata and conversion of a response record."""
    try:
        header, block = parse(record)
        h = {k.lower(): v for k, v in header}
        head, found, payload = block.partition(b"\r\n\r\n")
        if h.get("warc-type") != "response" or not found:
            raise ValueError("not a response")
    except ValueError as e:
        return [{"warc_type": "rejected", "block": str(e)}]
    status, _, rest = head.partition(b"\r\n")
    text, title, links = text_and_links(payload.decode("utf-8", "replace"))
    source, target, date = h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", "")
    about = {"WARC-Header": dict(header), "HTTP-Status": status.decode("utf-8", "replace"), "HTTP-Header": dict(fields(rest)), "Payload-Length": len(payload), "Title": title, "Links": links}
    rows = []
    for kind, ctype, body in (("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text)):
        raw = body.encode()
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", ctype), ("WARC-Block-Digest", digest(raw)), ("Content-Length", str(len(raw)))]
        rows.append({"warc_type": kind, "record_id": own[1][1], "refers_to": source, "target_uri": target, "warc_date": date, "content_type": ctype, "content_length": len(raw), "block_digest": own[6][1], "payload_digest": h.get("warc-payload-digest") or digest(payload), "header": "".join(f"{k}: {v}\r\n" for k, v in own), "block": body})
    return rows


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and record (bytes) of each page (page_id, url, html)."""

    @F.arrow_udf("binary")
    def build(ids: pa.Array, urls: pa.Array, htmls: pa.Array) -> pa.Array:
        return pa.array((response(i.as_py(), u.as_py(), h.as_py(), date) for i, u, h in zip(ids, urls, htmls, strict=True)), pa.binary())

    return pages.select("page_id", build("page_id", "url", "html").alias("record"))


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in ROWS.split(", ")]
    for b in in_slices(batches, 1):
        rows = [{"page_id": i, **r} for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in derive(x.as_buffer().to_pybytes() if x.is_valid else b"")]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)


def derivatives(records: DataFrame) -> DataFrame:
    """records: page_id, record. Two rows per response; `header` and `block` make up the record to write."""
    return records.select("page_id", "record").mapInArrow(_derived, ROWS)
