import hashlib

from stratadoc.llm import warc


def test_roundtrip(spark):
    big, dup = "x" * 5000 + "é", "<p>same</p>" * 200
    rows = [(1, "http://a/\r\nX: y", dup, 1), (2, None, dup, 1), (3, "http://c", None, 1), (4, "u", "", 1), (5, "u", big, 1), (6, "u", "short", 1), (7, "u", "short", 1), (9, "u", dup, 1), (9, "u", dup, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes long").repartition(3)
    chunks = warc.write_archives(df, chunk=700)
    for part in [chunks, warc.written(chunks, "t")]:
        got = [(warc_page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and warc_page(r.refers_to)) for r in warc.read_archives(part).collect() if r.digest_ok]
        want = []
        for page, _, html, _ in rows:
            data = (html or "").encode()
            revisit = html == dup and page < 9
            want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert chunks.where("record_no >= 0 and n_chunks > 1").count() > 5


def warc_page(rid):
    return int(rid.split(":")[2])


def test_archive_is_warc(spark):
    df = spark.createDataFrame([(1, "http://a", "hi")], "page_id long, url string, html string")
    data = b"".join(bytes(r.data) for r in warc.write_archives(df).orderBy("record_no", "chunk_no").collect())
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\nhi\r\n\r\n")


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0


def test_given_pages(spark):
    rows = warc.op7_warc(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count() and all(r.digest_ok for r in rows)
