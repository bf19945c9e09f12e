import hashlib
import zlib

from hypothesis import given
from hypothesis import strategies as st

from stratadoc.llm import media


@given(st.binary(max_size=300))
def test_image_roundtrip(data):
    samples, n = media.decode_image(media.encode_image(data))
    payload = samples.tobytes()
    assert payload[:n] == data and len(payload) % 64 == 0 and payload and not any(payload[n:])


def test_reading_order():
    html = "<head><title>no</title></head><h1>One</h1>two <b>bold</b><img src=a alt=first><p>three<figure><img src='media:sha256/00'><figcaption>A <i>cap</i></figcaption></figure>four<script>x</script>"
    got = [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.sequence_of(html)]
    assert got == [(0, "text", "One", None), (1, "text", "two bold", None), (2, "media", "a", "first"), (3, "text", "three", None), (4, "media", "media:sha256/00", "A cap"), (5, "text", "four", None)]
    assert media.sequence_of("") == [] and media.sequence_of("<figure><figcaption>lone")[0]["text"] == "lone"


def test_documents(spark, tmp_path):
    rows = [(1, None, 7), (2, "", 7), (3, "é" * 40, 7), (4, "é" * 40, 7), (4, "é" * 40, 7), (5, "y" * 64, 7), (6, "z" * 300_001, 7), (7, "é" * 40 + "\0", 7), (None, "q", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, digest int").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op3_media(spark, str(tmp_path)).collect()
    want = []
    for d, t, _ in rows:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        image = media.encode_image(data)
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(r.caption == ("document without id" if r.doc_id is None else f"document {r.doc_id}") for r in got)
    assert len({r.feature for r in got if r.doc_id in (3, 4)}) == 1


def test_empty_and_unknown(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    features = media.media_features(media.store_media(docs))
    pages = spark.createDataFrame([(1, '<img src="media:sha256/ff" alt="x"><img src="http://y">'), (2, None)], "page_id long, html string")
    rows = media.resolved(media.interleaved(pages), features).orderBy("position").collect()
    assert [(r.page_id, r.caption, r.media_sha256) for r in rows] == [(1, "x", None), (1, None, None)]
