"""Operator 2: interleaved document sequences with content-addressed media.

`parse_html` reads a page into an ordered sequence of items: text, or a reference to media by digest, with
the caption that stands with it (figcaption, else the alternative text). `store` keeps payloads as media
files in a table, addressed by the SHA-256 of their bytes; `resolve` joins references and media by
digest, one row for each item with its position, so captions and positions stay aligned; `sequences`
puts the items of a document together again in order.

Media are 8-bit greyscale PNG images, 64 samples a row: lossless, and Spark's Parquet holds the bytes as
they are. `read_png` gives the payload back and verifies every checksum.

Null text is an empty payload, padded to one row of zeros. Null or malformed HTML gives what the parser
finds, at worst no items. References without media resolve to null. A task stores equal payloads once;
further copies from other tasks are equal and are dropped when references resolve. Rows that repeat are
kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import query, shared_dir

WIDTH, LEVEL = 64, 6
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_SIGN = b"\x89PNG\r\n\x1a\n"
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "section", "article", "blockquote", "pre", "ul", "ol", "nav", "header", "footer", "title", "figure", "figcaption", "body", "head"}


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.caption, self.hidden, self.figure = [], [], None, 0, []

    def flush(self):
        text = " ".join("".join(self.run).split())
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.flush()
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            found = dict(attrs)
            self.flush()
            item = {"kind": "media", "text": None, "digest": (found.get("src") or "").removeprefix("sha256:") or None, "caption": found.get("alt") or None}
            self.items.append(item)
            self.figure.append(item)

    def handle_endtag(self, tag):
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figure:
                item["caption"] = text or item["caption"]
            self.caption = None
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_items(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def parse_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `items`, the ordered sequence, in place of the html column."""
    place, names = pages.columns.index(html), [c for c in pages.columns if c not in (html, "items")]
    item = pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))])

    def parsed(batches):
        for batch in batches:
            items = pa.array([parse_items(x) for x in batch.column(place).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), items], [*names, "items"])

    from pyspark.sql.types import StructType

    schema = StructType([pages.schema[n] for n in names] + StructType.fromDDL(f"items array<{ITEM}>").fields)
    return pages.mapInArrow(parsed, schema)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as an 8-bit greyscale image."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> bytes:
    if media[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, own = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", own)
        elif kind == b"IDAT":
            data.append(own)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if size[2:] != (8, 0, 0, 0, 0) or rows[:, 0].any():
        raise ValueError("not the form that write_png writes")
    return rows[:, 1:].tobytes()


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store(docs: DataFrame, path: str) -> None:
    """Write below path, for each row of docs (doc_id, source, lang, text): the digest and size of its text as media, and the
    media itself where the task has not stored an equal one before."""
    kinds = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("media", pa.binary())])

    def stored_rows(batches):
        seen: set[bytes] = set()
        for batch in batches:
            data, at = words.text_buffer(batch.column(3))
            raw, n = data.tobytes(), 0
            for lo, hi in words.chunks(at, 4 << 20):
                digests, media = [], []
                for i in range(lo, hi):
                    payload = padded(raw[at[i] : at[i + 1]])
                    digest = hashlib.sha256(payload)
                    digests.append(digest.hexdigest())
                    media.append(None if digest.digest() in seen else write_png(payload))
                    seen.add(digest.digest())
                own = batch.slice(lo, hi - lo)
                sizes = np.diff(at[lo : hi + 1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(sizes), pa.array(digests), pa.array(media, pa.binary())], schema=kinds)
                n += hi - lo

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    rows.mapInArrow(stored_rows, "doc_id bigint, source string, lang string, n_bytes bigint, digest string, media binary").write.option("compression", "uncompressed").parquet(path)


def features(media: DataFrame) -> DataFrame:
    """media (digest, media) read back: digest and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def computed(batches):
        for batch in batches:
            out = []
            for digest, form in zip(batch.column(0).to_pylist(), batch.column(1)):
                form = form.as_py()
                payload = read_png(form)
                samples = np.frombuffer(payload, np.uint8)
                bands = np.bincount(samples >> 5, minlength=8)
                feature = f"rows={len(samples) // WIDTH};mean={samples.mean(dtype=np.float64):.6f};bands={','.join(map(str, bands))}"
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names)

    return media.select("digest", "media").mapInArrow(computed, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def resolve(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each item of `parsed` (as from parse_html), media items with the columns of `media` for their digest."""
    own = [c for c in parsed.columns if c != "items"]
    items = parsed.select(*own, F.explode("items").alias("item")).select(*own, "item.*")
    return items.join(media.dropDuplicates(["digest"]), "digest", "left")


def sequences(resolved: DataFrame, key: str) -> DataFrame:
    """The items of each `key` as one array in order of position."""
    others = [c for c in resolved.columns if c != key and c != "position"]
    return resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *others))).alias("items"))


@query
def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    kept = spark.read.parquet(path)
    media = features(kept.filter("media is not null"))
    # Each document as a page: its source as text, then its text as a figure with the language for a caption.
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<article><h1>"), escaped("source"), F.lit('</h1><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'), escaped("lang"), F.lit("</figcaption></figure></article>"))
    parsed = parse_html(kept.select("doc_id", "n_bytes", page.alias("html")))
    found = resolve(parsed, media).filter("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
