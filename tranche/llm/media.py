"""Interleaved document sequences: pages become ordered text and media references, digests find the media.

A page's HTML is parsed into items in reading order, each a piece of text or a reference to a medium by its
digest, with its caption. Media live in a store of (digest, media); a join by digest resolves references. Payload
bytes are read where they lie: what is computed from them is folded, map-side first, to one small row per digest and
joined to the references. Neither bytes nor texts are shuffled. References to one medium that many pages show meet
its one row, so Spark's skew join can split them over tasks.

Media here are grey images (binary PGM, 8-bit samples, ROW samples a row), which hold any bytes without loss.

Defined results: null or empty HTML has no items; text inside script and style doesn't count; a caption is a
figcaption of the same figure, else the alt text, else empty; an image without a digest counts by its
source alone (null digest); a digest that the store lacks stays, with nulls; repeated pages each return; columns
of pages stay as they are, whatever their names, but for those named as results (item, media), which are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_slices

ROW, TAIL = 64, 64
SCHEME = "urn:sha256:"
ITEM = "array<struct<position:int,kind:string,text:string,source:string,digest:string,caption:string>>"
_ITEM = pa.list_(pa.struct([("position", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "source", "digest", "caption")]]))


class _Page(HTMLParser):
    HIDDEN, BREAKS, MEDIA = {"script", "style", "template", "noscript"}, {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "table", "article", "section", "header", "footer", "nav", "figure", "figcaption", "blockquote", "pre", "body", "title"}, {"img", "audio", "video", "source", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []  # open ones: media without a caption yet, caption and its place among the items
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "source": None, "digest": None, "caption": None})

    def end_figure(self) -> None:
        """A caption goes to the media of its figure, before or after it, that inner figures give none; a text if there are no media."""
        f = self.figures.pop()
        if f["caption"] is None:
            if self.figures:
                self.figures[-1]["media"] += f["media"]
        elif f["media"]:
            for item in f["media"]:
                item["caption"] = f["caption"]
        elif f["caption"]:
            self.items.insert(f["place"], {"kind": "text", "text": f["caption"], "source": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BREAKS or tag in self.MEDIA:
            self.end_text() if self.caption is None else self.caption.append(" ")
        if tag == "figure":
            self.figures.append({"media": [], "caption": None, "place": 0})
        if tag == "figcaption":
            self.caption = []
        if tag in self.MEDIA:
            a = dict(attrs)
            source = a.get("src") or ""
            digest = source[len(SCHEME) :] if source.startswith(SCHEME) else a.get("data-digest")
            item = {"kind": "media", "text": None, "source": source, "digest": digest, "caption": a.get("alt") or ""}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            if self.figures:
                self.figures[-1].update(caption=text, place=len(self.items))
            else:
                self.words.append(text)
            self.caption = None
        if tag in self.BREAKS and self.caption is None:
            self.end_text()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[dict]:
    page = _Page()
    page.feed(html or "")
    page.close()
    if page.caption:
        page.words.extend(page.caption)
    page.end_text()
    while page.figures:
        page.end_figure()
    return [{"position": i, **x} for i, x in enumerate(page.items)]


def with_items(pages: DataFrame, html: str = "html", to: str = "items") -> DataFrame:
    """Adds the ordered items of each page."""

    @F.arrow_udf(ITEM)
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array((items_of(t.as_py()) for t in texts), _ITEM)

    return pages.withColumn(to, parse(F.col(html)))


def padded(data: Column) -> Column:
    """The bytes, filled up with zeros to a positive multiple of ROW."""
    size = F.greatest(F.lit(ROW), F.ceil(F.octet_length(data) / ROW) * ROW).cast("int")
    return F.rpad(data, size, F.lit(b"\0"))


def to_media(payload: Column) -> Column:
    """A PGM image of the payload's bytes; its length must be a multiple of ROW."""
    head = F.concat(F.lit(f"P5\n{ROW} "), (F.octet_length(payload) / ROW).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), payload)


def from_media(media: bytes) -> np.ndarray:
    """Samples of a PGM image, a row of the image each."""
    magic, size, most, _ = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255":
        raise ValueError("not an 8-bit grey image")
    return np.frombuffer(media, np.uint8, width * height, len(magic) + len(size) + len(most) + 3).reshape(height, width)


def feature_of(image: np.ndarray) -> str:
    """Size, mean in thousandths, shares of sixteen grey levels in thousandths, and sum of steps between neighbours."""
    h, w = image.shape
    levels = np.bincount(image.ravel() >> 4, minlength=16) * 1000 // image.size
    steps = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum())
    return f"{w}x{h};{int(image.sum(dtype=np.int64)) * 1000 // image.size};{','.join(map(str, levels))};{steps}"


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    for b in in_slices(batches, 1):
        rows = []
        for d, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            stored = m.as_buffer().to_pybytes()
            image = from_media(stored)
            payload = image.tobytes()
            rows.append((d, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(image)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("digest", "payload_sha256", "media_sha256", "feature") else pa.int64()) for n, c in zip(names, cols, strict=True)], names)


def read_back(store: DataFrame) -> DataFrame:
    """store: digest, media. One row per digest with what its stored bytes give when read."""
    return store.select("digest", "media").mapInArrow(_read, READ).groupBy("digest").agg(*[F.first(c).alias(c) for c in (x.split()[0] for x in READ.split(", ")) if c != "digest"])


def resolve(sequences: DataFrame, known: DataFrame, items: str = "items", texts: bool = True) -> DataFrame:
    """sequences: an items column. A row per item, in place, with the struct `item` and the struct `media`: the columns of
    known (one row per digest), null where it has none. texts: whether text items return too."""
    keep = [c for c in sequences.columns if c not in (items, "item", "media")]
    wanted = F.col(f"`{items}`") if texts else F.filter(F.col(f"`{items}`"), lambda i: i["kind"] == "media")
    rows = sequences.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("_page"), F.explode(wanted).alias("item"))
    facts = known.select(F.col("digest").alias("_digest"), F.struct(*[c for c in known.columns if c != "digest"]).alias("media"))
    return rows.join(facts, F.col("item.digest") == F.col("_digest"), "left").select(*[F.col(f"_page.`{c}`").alias(c) for c in keep], "item", "media")
