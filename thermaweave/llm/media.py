"""Interleaved document sequences: ordered text and media structs from HTML, with payloads resolved by digest.

Payloads are kept in a media store, a table of (digest, stored form): portable pixmaps (P6) 64 pixels wide, whose 8-bit
samples are the payload's bytes. A document's HTML is parsed into an array of (position, kind, text, digest, caption);
references meet what was read back from the store by a join on the digest, and positions and captions stay with them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, doc_columns, forget, steps, stored, table

#: Bytes of a row of 64 pixels with 3 samples each.
ROW = 192
ITEM = "position int, kind string, text string, digest string, caption string"
#: Tags whose text isn't text of the document; tags that end a run of text. Fixed values.
SKIPPED = frozenset({"script", "style", "head", "template", "noscript"})
BLOCKS = frozenset({"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "br", "figure", "figcaption", "nav", "body", "blockquote", "pre"})
MEDIA = frozenset({"img", "video", "audio", "source"})


class _Items(HTMLParser):
    """The items of a page in document order; white space within a run of text is collapsed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if tag in BLOCKS or tag in MEDIA:
            self.end_text()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.caption = []
        if tag in MEDIA:
            held = dict(attrs)
            source = held.get("src") or ""
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": source.removeprefix("sha256:") if source.startswith("sha256:") else None, "caption": held.get("alt")})

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media" and text:
                    item["caption"] = text
        if tag in BLOCKS:
            self.end_text()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skip:
            self.held.append(data)


def parse(html: str | None) -> list[dict]:
    p = _Items()
    p.feed(html or "")
    p.close()
    p.end_text()
    return p.items


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, items: the ordered items of every row's HTML. Null and empty HTML have no items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            for first, texts in steps(b, column="html"):
                yield batch({"key": (b.column(0).slice(first, len(texts)), pa.int64()), "items": ([parse(t.decode()) for t in texts], kind)})

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"key long, items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ITEM.split(', '))}>>").withColumnRenamed("key", key)


def payload_of(text: bytes) -> bytes:
    """The text, filled up with blanks to a positive multiple of ROW."""
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def to_pixmap(payload: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (ROW // 3, len(payload) // ROW) + payload


def from_pixmap(stored_form: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, samples) of a P6 pixmap with 8-bit samples."""
    magic, shape, most, data = stored_form.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P6" or most != b"255" or len(data) != 3 * width * height:
        raise ValueError("not a pixmap with 8-bit samples")
    return width, height, np.frombuffer(data, dtype=np.uint8)


def feature(width: int, height: int, samples: np.ndarray) -> str:
    """Size, mean colour and contrast in thousandths, and a 64-bit difference hash of 8 x 9 mean brightnesses."""
    pixels = samples.reshape(-1, 3)
    colour = (pixels.sum(axis=0, dtype=np.int64) * 1000) // len(pixels)
    spread = int(np.sqrt(samples.var(dtype=np.float64)) * 1000)
    grey = pixels.sum(axis=1, dtype=np.int64)
    edges = np.arange(73) * len(grey) // 72
    sums = np.concatenate([[0], np.cumsum(grey)])
    cells = ((sums[np.maximum(edges[1:], edges[:-1] + 1).clip(max=len(grey))] - sums[edges[:-1].clip(max=len(grey) - 1)]) // np.maximum(edges[1:] - edges[:-1], 1)).reshape(8, 9)
    bits = "".join("1" if x else "0" for x in (cells[:, 1:] > cells[:, :-1]).ravel())
    return f"{width}x{height};rgb={','.join(map(str, colour.tolist()))};sd={spread};dhash={int(bits, 2):016x}"


def media_store(docs: DataFrame) -> DataFrame:
    """digest, media: the stored form of each text's payload, once a task (stored as a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for _, texts in steps(b):
                rows = []
                for t in texts:
                    p = payload_of(t)
                    h = hashlib.sha256(p)
                    if h.digest() not in seen:
                        if len(seen) < 1 << 18:
                            seen.add(h.digest())
                        rows.append((h.hexdigest(), to_pixmap(p)))
                yield batch({"digest": ([r[0] for r in rows], pa.string()), "media": ([r[1] for r in rows], pa.binary())})

    return stored(docs.select("text").mapInArrow(run, "digest string, media binary"), "media")


def describe(store: DataFrame) -> DataFrame:
    """What reading the stored forms back gives: one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                media = media.as_py()
                width, height, samples = from_pixmap(media)
                data = samples.tobytes()
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(width, height, samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield batch(dict(zip(("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), ((c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), strict=True)))

    found = store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest"])


def resolve(items: DataFrame, key: str, described: DataFrame) -> DataFrame:
    """Media items (key, position, caption, digest, and what `items` holds beside its items) with what the store knows of
    their digest (null: not in the store)."""
    others = [c for c in items.columns if c not in (key, "items")]
    media = items.select(key, *others, F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i")).select(key, *others, "i.position", "i.caption", "i.digest")
    return media.join(described, "digest", "left")


def with_text(items: DataFrame) -> DataFrame:
    """items with n_items, n_texts, text_bytes and text_sha256: how many items there are and how many of text, and the
    bytes and digest of all text items in order, joined by line ends."""
    text = F.array_join(F.transform(F.filter("items", lambda i: i["kind"] == "text"), lambda i: i["text"]), "\n")
    n_texts = F.size(F.filter("items", lambda i: i["kind"] == "text"))
    return items.withColumns({"n_items": F.size("items"), "n_texts": n_texts, "text_bytes": F.octet_length(text).cast("long"), "text_sha256": F.sha2(text, 256)})


def page_of(text: bytes) -> str:
    """A page of the whole text, a paragraph a line that isn't blank, with its payload as a captioned figure after the first."""
    lines = [f"<p>{escape(x)}</p>" for x in text.decode("utf-8", "replace").split("\n") if x.strip()]
    lines.insert(1, f'<figure><img src="sha256:{hashlib.sha256(payload_of(text)).hexdigest()}"><figcaption>{len(text)} bytes</figcaption></figure>')
    return f"<html><body>{''.join(lines)}</body></html>"


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: a page for each document, as page_of() makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in steps(b):
                yield batch({"doc_id": (b.column(0).slice(first, len(texts)), pa.int64()), "n_bytes": ([len(t) for t in texts], pa.int64()), "html": ([page_of(t) for t in texts], pa.string())})

    return docs.mapInArrow(run, "doc_id long, n_bytes long, html string")


def interleave(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, position and caption of the document's figure; n_items, n_texts, text_bytes and text_sha256 of its sequence.

    Null texts are empty; an empty text's payload is one row of blanks. Texts of any length are stored whole. Equal
    texts share a digest and so all values; repeated rows and null ids come out as often as they stand there. An empty
    table gives no rows. References carry digests only, so a text that a third of all rows share meets one described
    row in a join whose partitions Spark can split.
    """
    store = media_store(docs)
    described = stored(describe(store), "described")
    forget(store)
    # An item's caption is the byte count, so ids need not be unique for it to follow its document.
    found = resolve(with_text(sequences(document_pages(docs), "doc_id")), "doc_id", described)
    return found.select("doc_id", F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "n_texts", "text_bytes", "text_sha256")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(doc_columns(table(spark, sf_dir, "documents")))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all pages as they are given, a row an item: page_id, position, kind, text, digest, caption."""
    return sequences(table(spark, sf_dir, "pages")).select("page_id", F.inline("items"))
