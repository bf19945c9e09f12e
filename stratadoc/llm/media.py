"""Interleaved document sequences with media columns.

HTML becomes an ordered array of text and media-reference structs. References name media by the SHA-256 of the
stored bytes; a digest join puts what the store holds beside each reference, position and caption unchanged. The
store's samples are 8-bit grey in a PGM image 64 samples wide, whose comment carries the length before padding.
The bytes of media are read where they lie; only digests and features are shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

WIDTH = 64
SCHEME = "media:sha256/"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
ITEM = pa.struct([("position", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
#: Elements whose start or end breaks a text, and those whose content isn't text.
BREAKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html img li main nav ol p pre section table td th tr ul video audio source".split())
SILENT = frozenset(["script", "style", "head", "template"])
MEDIA = frozenset(["img", "video", "audio", "source"])


def encode_image(data: bytes) -> bytes:
    """A binary PGM whose samples are the data, padded with 0 to a positive multiple of 64."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(data), WIDTH, rows) + data + bytes(rows * WIDTH - len(data))


def decode_image(stored: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows x 64) and the length before padding."""
    head = re.match(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n", stored)
    return np.frombuffer(stored, np.uint8, offset=head.end()).reshape(int(head[3]), int(head[2])), int(head[1])


def feature_of(samples: np.ndarray) -> str:
    """Shape, mean, deviation, and eight-bin histogram of the samples; whole numbers and fixed digits only."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n, levels = int(counts.sum()), np.arange(256)
    total, squares = int((counts * levels).sum()), int((counts * levels * levels).sum())
    mean = total / n
    bins = ",".join(map(str, counts.reshape(8, 32).sum(1).tolist()))
    return f"grey {samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} dev={max(0.0, squares / n - mean * mean) ** 0.5:.4f} hist={bins}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, media): each text's bytes as an image; media is null where the task has stored that digest before.

    Null texts are empty and give one row of zeros. Repeated rows share a digest; an empty table gives none.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            digests, media = [], []
            for text in batch.column(1):
                buffer = text.as_buffer() if text.is_valid else None
                image = encode_image(memoryview(buffer).tobytes() if buffer else b"")
                digest = hashlib.sha256(image)
                digests.append(digest.hexdigest())
                media.append(None if digest.digest() in seen else image)
                seen.add(digest.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["id", "digest", "media"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(store, f"id {src.schema['id'].dataType.simpleString()}, digest string, media binary").withColumnRenamed("id", id_col)


class Sequence(HTMLParser):
    """Texts and media references in reading order. A figure's caption goes to its media, others' is their alt text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent, self.caption, self.figure = [], [], 0, None, None

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS and self.caption is None:
            self.flush()
        if tag in SILENT:
            self.silent += 1
        given = dict(attrs)
        if tag in MEDIA and given.get("src"):
            self.items.append({"kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or None})
        elif tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag == "figure":
            if self.caption is not None:
                self.end_caption()
            self.figure = None
        if tag in BREAKS:
            self.flush()

    def end_caption(self) -> None:
        caption = " ".join("".join(self.caption).split())
        own = [x for x in self.items[self.figure :] if x["kind"] == "media"]
        for x in own:
            x["caption"] = caption or x["caption"]
        if caption and not own:
            self.items.append({"kind": "text", "text": caption, "ref": None, "caption": None})
        self.caption = None

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str) -> list[dict]:
    parser = Sequence()
    parser.feed(html)
    parser.close()
    if parser.caption is not None:
        parser.end_caption()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items): items are structs (position, kind 'text' or 'media', text, ref, caption) in reading order.

    Null and empty pages give an empty array; broken HTML gives what the lenient parser finds; rows are independent.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items = [sequence_of(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(ITEM))], names=["id", "items"])

    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    items = "array<struct<position:long,kind:string,text:string,ref:string,caption:string>>"
    return src.mapInArrow(parse, f"id {src.schema['id'].dataType.simpleString()}, items {items}").withColumnRenamed("id", id_col)


def media_features(store: DataFrame) -> DataFrame:
    """One row per digest of a store: what its bytes say when read back. Copies of a digest count once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = memoryview(stored.as_buffer())
                found = hashlib.sha256(image).hexdigest()
                if found != digest:
                    raise ValueError(f"the store holds {found} as {digest}")
                samples, n_bytes = decode_image(image)
                payload = samples.tobytes()
                rows.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), found, feature_of(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    each = store.where("media is not null").select("digest", "media").mapInArrow(read, FEATURES)
    return each.groupBy("digest").agg(*[F.first(c).alias(c) for c in each.columns[1:]])


def resolved(sequences: DataFrame, features: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row per item of interleaved(), with the features of its media; unknown and foreign references keep nulls."""
    items = sequences.select(F.col(id_col), F.inline("items"))
    digest = F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    return items.withColumn("digest", digest).join(features, "digest", "left")


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Each document's text as an image that its page refers to; the page is parsed, the reference resolved."""
    store = written(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "store")
    figure = F.concat(F.lit(f'<article><p>Text of</p><figure><img src="{SCHEME}'), "digest", F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit("</figcaption></figure></article>"))
    pages = store.select("doc_id", figure.alias("html"))
    rows = resolved(interleaved(pages, "doc_id"), media_features(store), "doc_id").where("kind = 'media'")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
