"""WARC archives as chunk tables.

Executors and the driver share no local folder, so an archive is a table: one row for each chunk of a record, with
the record's number, the chunk's number and the running SHA-1 of the payload up to there. The chunks of a record
in order are the bytes of a WARC/1.1 record, those of all records of an archive its file. Writing and reading
hold one chunk of a record at a time besides the row that Spark hands over.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "archive_id long, record_no long, chunk_no int, n_chunks int, data binary, running_sha1 string"
RECORDS = "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target_uri string, digest_ok boolean"


def record_id(page_id, sha1: str) -> str:
    return f"<urn:page:{page_id}:{sha1}>"


def head_of(kind: str, rid: str, uri: str, sha1: str, size: int, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n" if kind == "response" else "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(), f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if refers:
        lines += [f"WARC-Refers-To: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def decided(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (page_id, url, html, sha1, n, keeper): keeper is the page that holds the payload, null for itself.

    Only (id, digest) pairs are grouped; the texts move once, dealt by page, whatever the size of a group of copies.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html").cast("long"))
    light = src.where(F.col("n") >= least).select("page_id", "sha1", "n")
    keeper = light.groupBy("sha1", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = light.join(keeper, ["sha1", "n"]).where("page_id is null or page_id < keeper").select("page_id", "sha1", "keeper").distinct()
    keyed = src.join(revisits.withColumnRenamed("page_id", "id2").withColumnRenamed("sha1", "sha2"), F.expr("page_id <=> id2 and sha1 = sha2"), "left")
    return keyed.drop("id2", "sha2")


def write_archives(pages: DataFrame, least: int = 1000, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The chunk rows of the archives, one archive for each partition.

    A page whose payload has `least` bytes or more and equals that of a page with a larger id is a revisit of the
    largest; all others are responses. Null payloads are empty. A page repeated under one id and payload is the
    same record each time. An empty table gives no rows; other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, number = TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        rows, held = [], 0
        for batch in batches:
            for page, url, html, sha1, keeper in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, sha1, keeper = page.as_py(), sha1.as_py(), keeper.as_py()
                body = memoryview(html.as_buffer())
                kind = "response" if keeper is None else "revisit"
                refers = None if keeper is None else record_id(keeper, sha1)
                head = head_of(kind, record_id(page, sha1), quote(url.as_py() or "about:blank", safe=":/?#[]@!$&'()*+,;=%~"), sha1, len(body), refers)
                sent = body if kind == "response" else body[:0]
                total, running = max(1, -(-len(sent) // chunk)), hashlib.sha1()
                for k in range(total):
                    part = sent[k * chunk : (k + 1) * chunk]
                    running.update(part)
                    data = (head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if k == total - 1 else b"")
                    rows.append((archive, number, k, total, data, running.hexdigest()))
                    held += len(data)
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                number += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return decided(pages, least, id_col, url_col, html_col).select("page_id", "url", "html", "sha1", "keeper").mapInArrow(write, CHUNKS)


class Reader:
    """Reads one record from its chunks, in order; keeps the head and digest states, never the payload."""

    def __init__(self):
        self.head, self.body, self.sha, self.seen, self.left = b"", None, hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> None:
        if self.body is None:
            self.head += data
            if (end := self.head.find(b"\r\n\r\n")) < 0 or (http := self.head.find(b"\r\n\r\n", end + 4)) < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"]) - (http - end)
            self.body, data = True, self.head[http + 4 :]
        part = data[: self.left]
        self.left -= len(part)
        self.seen += len(part)
        self.sha.update(part)

    def row(self, running: str) -> tuple:
        f, refers = self.fields, self.fields.get("WARC-Refers-To")
        said = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        response = f["WARC-Type"] == "response"
        digest = self.sha.hexdigest() if response else said
        ok = self.left == 0 and digest == said and (not response or running == digest)
        return f["WARC-Record-ID"], self.seen if response else int(f["X-Payload-Length"]), digest, f["WARC-Type"], refers, f["WARC-Target-URI"], ok


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table; digest_ok tells whether length, header and running digests agree.

    Records of one chunk are read where they lie; only those of several are brought together, sorted, and streamed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, reader = [x.split()[0] for x in RECORDS.split(", ")], Reader()
        for batch in batches:
            rows = []
            for chunk_no, n, data, running in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                if chunk_no.as_py() == 0:
                    reader = Reader()
                reader.feed(data.as_py())
                if chunk_no.as_py() == n.as_py() - 1:
                    rows.append(reader.row(running.as_py()))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    single = chunks.where("n_chunks = 1")
    several = chunks.where("n_chunks > 1").repartition("archive_id", "record_no").sortWithinPartitions("archive_id", "record_no", "chunk_no")
    return single.mapInArrow(read, RECORDS).unionByName(several.mapInArrow(read, RECORDS))


def page_of(col: str):
    return F.regexp_extract(col, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    chunks = written(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return read_archives(chunks).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "digest_ok")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN k.top > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.top > p.page_id THEN k.top END AS refers_to, true AS digest_ok
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""
