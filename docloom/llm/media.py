"""Operator 2, media columns: interleaved document sequences.

HTML is parsed into one ordered sequence of structs: runs of text, and references to media
with their caption. A reference names a payload by digest (``sha256:...`` or an inline
``data:`` URI, whose digest is taken) or by address, which a table of addresses turns into a
digest. Payloads are kept losslessly, 8 bits a sample, as grey images (PGM) of 64 samples a
line in a content-addressed table. References are exploded, joined to the payloads by digest,
and put back by position, so text, media and captions stay aligned.

The store is written by the tasks that hold the payloads, without a shuffle, and read back
from its files for digests and features. What is joined is one row of features for each
digest, not the payload; ``resolved`` can join the payload too.

Edge cases: a null or empty text has a payload of 64 zero bytes; null HTML gives an empty
sequence; a reference without a payload keeps its place with null columns; repeated rows
keep their number and share payloads; empty tables give empty results; columns other than
those named are kept by ``resolved`` and not read by the query.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, written

WIDTH = 64
BINS = 16
ITEM = "struct<pos:int,kind:string,text:string,caption:string,address:string,digest:string>"
FEATURES = (
    "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)
#: Elements that refer to a payload (fixed values).
MEDIA = {"img": "image", "audio": "audio", "video": "video", "embed": "embed", "source": "source"}
HIDDEN = {"script", "style", "template", "noscript"}
BREAKS = {
    "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "article", "section",
    "figure", "figcaption", "header", "footer", "nav", "title", "blockquote", "pre", "body", "head", "html",
}


class Sequence(HTMLParser):
    """Ordered items of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[list[int]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text=None, caption=None, address=None, digest=None) -> None:
        self.items.append({"pos": len(self.items), "kind": kind, "text": text, "caption": caption, "address": address, "digest": digest})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            address = a.get("src")
            if address:
                self.flush()
                if self.figures:
                    self.figures[-1].append(len(self.items))
                self.add(MEDIA[tag], caption=a.get("alt") or a.get("title"), address=address, digest=digest_of(address))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for k in self.figures[-1] if self.figures and text else []:
                self.items[k]["caption"] = text
        elif tag == "figure" and self.figures:
            self.figures.pop()
        if tag in BREAKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def inline_payload(address: str) -> bytes | None:
    """The bytes of a ``data:`` URI; None if it isn't a good one."""
    head, comma, body = address.partition(",")
    if not head.lower().startswith("data:") or not comma:
        return None
    try:
        return base64.b64decode(body, validate=True) if head.lower().endswith(";base64") else unquote_to_bytes(body)
    except (binascii.Error, ValueError):
        return None


def digest_of(address: str) -> str | None:
    if address.startswith("sha256:"):
        return address[7:].lower()
    data = inline_payload(address)
    return None if data is None else hashlib.sha256(data).hexdigest()


def sequence(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, html: str = "html", out: str = "items") -> DataFrame:
    """``pages`` without its HTML but with the ordered items of it."""

    kept = [c for c in pages.columns if c not in (html, out)]
    source = pages.select(*kept, F.col(html).alias(html))
    item = pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "caption", "address", "digest"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sequence(x) for x in batch.column(html).to_pylist()], type=pa.list_(item))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, out])

    schema = source.select(*kept, F.lit(None).cast(f"array<{ITEM}>").alias(out)).schema
    return source.mapInArrow(run, schema)


def padded(text: Column) -> Column:
    """A text's UTF-8 bytes, with bytes 0 up to a positive multiple of WIDTH."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / WIDTH).cast("int")) * WIDTH
    return F.rpad(data, size, F.lit(b"\0"))


def image(payload: Column) -> Column:
    """A payload whose length is a multiple of WIDTH as a PGM file."""
    lines = (F.octet_length(payload) / WIDTH).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), lines, F.lit("\n255\n")).cast("binary"), payload)


def samples(media: bytes) -> bytes:
    """The payload of a PGM file made by :func:`image`."""
    kind, size, most, data = media.split(b"\n", 3)
    width, lines = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(data) != width * lines:
        raise ValueError("not a stored payload")
    return data


def feature(payload: bytes) -> str:
    """Mean, deviation, share of non-zero samples, a histogram in percent, and an 8 x 8 mean hash."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, levels = len(x), np.arange(256)
    mean = float(counts @ levels) / n
    spread = max(0.0, float(counts @ levels**2) / n - mean * mean) ** 0.5
    bins = counts.reshape(BINS, -1).sum(axis=1) * 100 // n
    lines = x.reshape(-1, WIDTH)
    edges = np.linspace(0, len(lines), 9).astype(int)
    cells = np.zeros((8, 8))
    for k in range(8):
        part = lines[edges[k] : max(edges[k + 1], edges[k] + 1)]
        cells[k] = part.reshape(len(part), 8, 8).mean(axis=(0, 2))
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"mean={mean:.3f};std={spread:.3f};nonzero={(n - counts[0]) / n:.4f};hist={'-'.join(map(str, bins))};hash={bits}"


def features(store: DataFrame) -> DataFrame:
    """FEATURES of every stored payload, computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                data = samples(media)
                sha = hashlib.sha256(data).hexdigest()
                rows.append((len(data), sha, zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), *(pa.array(c, type=k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds))],
                names=[x.split()[0] for x in FEATURES.split(", ")],
            )

    bounded_batches(store.sparkSession)
    return store.select("digest", "media").mapInArrow(run, FEATURES)


def stored(payloads: DataFrame) -> DataFrame:
    """Write payloads (lengths multiples of WIDTH) to the content-addressed table: (digest, media)."""
    data = F.col("payload")
    return written(payloads.select(F.sha2(data, 256).alias("digest"), image(data).alias("media")), "media")


def resolved(rows: DataFrame, media: DataFrame, key: list[str], items: str = "items") -> DataFrame:
    """``rows`` with each item's media columns joined by digest, in the old order.

    ``media`` has one row for each ``digest``; ``key`` tells rows apart. All columns of
    ``media`` become a struct ``media`` of the item, null for text and missing payloads.
    """
    flat = rows.select(*key, F.posexplode(items).alias("_at", "_item"))
    side = media.select(F.col("digest").alias("_digest"), F.struct(*[c for c in media.columns if c != "digest"]).alias("_media"))
    met = flat.join(side, F.col("_item.digest") == F.col("_digest"), "left")
    again = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_item", "_media"))).alias("_all"))
    again = again.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], F.transform("_all", lambda x: F.struct(x["_item"].alias("item"), x["_media"].alias("media"))).alias("resolved"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(key)]
    return rows.join(again, on, "left").drop(*[f"_k{n}" for n in range(len(key))])


def document_media(docs: DataFrame) -> DataFrame:
    """Every text as a payload: stored, referred to from a page, and joined by digest."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    payload = padded(F.col("text"))
    catalog = written(
        features(stored(base.select(payload.alias("payload")))).groupBy("digest").agg(*[F.first(x.split()[0]).alias(x.split()[0]) for x in FEATURES.split(", ")[1:]]),
        "catalog",
    )
    name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    page = F.concat(
        F.lit("<article><p>"), name, F.lit('</p><figure><img src="sha256:'), F.sha2(payload, 256), F.lit('" alt="text"><figcaption>'), name, F.lit("</figcaption></figure></article>")
    )
    pages = base.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), page.alias("html"))
    refs = (
        sequences(pages)
        .select("doc_id", "n_bytes", F.explode("items").alias("i"))
        .where("i.digest is not null")
        .select("doc_id", "n_bytes", F.col("i.pos").alias("position"), F.col("i.caption").alias("caption"), F.col("i.digest").alias("digest"))
    )
    names = [x.split()[0] for x in FEATURES.split(", ")[1:]]
    return refs.join(catalog, "digest").select("doc_id", "n_bytes", *names, "position", "caption")
