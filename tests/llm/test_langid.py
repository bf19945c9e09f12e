import zlib

import numpy as np

from stratadoc.llm import langid


def test_bundle_is_the_sum_of_bound_trigrams():
    p = langid.Profiles()
    codes, counts = p.trigrams("Ab, ab 1c")
    want = {}
    for word in ("ab", "ab", "c"):
        padded = [0, *map(ord, word), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            want[a << 42 | b << 21 | c] = want.get(a << 42 | b << 21 | c, 0) + 1
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want
    code = next(iter(want))
    plain = np.roll(p.of_letter(code >> 42), 2) * np.roll(p.of_letter(code >> 21 & 0x1FFFFF), 1) * p.of_letter(code & 0x1FFFFF)
    assert (p.rows([code])[0] == plain).all()
    assert p.trigrams("12 !") is None and p.trigrams("") is None


def test_held_out_accuracy(spark):
    src = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = langid.op10_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(src) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == src[r.doc_id].lang for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    learn = [(i, "the house and the garden", "en") for i in range(20)] + [(i + 20, "das haus und der garten", "de") for i in range(20)]
    rows = [*learn, (100, None, "en"), (101, "", "en"), (102, "123 !!", None), (103, "das haus", None), (103, "das haus", None), (104, "the house " * 20_000, None), (None, "the garden", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de" and got[None][0] == "en"
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("false or true").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_against_plain_python(spark):
    """Each row's language and cosine, by vectors of whole texts made letter by letter."""
    p = langid.Profiles()

    def bundle(text):
        out = np.zeros(langid.DIMS)
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = [0, *map(ord, word), 0]
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                out += np.roll(p.of_letter(a), 2).astype(float) * np.roll(p.of_letter(b), 1) * p.of_letter(c)
        return out

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    src = {r.doc_id: (r.text or "", r.lang) for r in docs.collect()}
    own = {d: bundle(t) for d, (t, _) in src.items()}
    learnt = {}
    for d, (_, lang) in src.items():
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None:
            learnt[lang] = learnt.get(lang, 0) + own[d]
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for r in langid.identify(docs).collect():
        scores = {lang: cosine(own[r.doc_id], v) for lang, v in learnt.items()} if own[r.doc_id].any() else {}
        if not scores:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        assert abs(scores[r.lang_pred] - r.score) < 1e-3 and scores[r.lang_pred] > max(scores.values()) - 1e-3


def test_a_text_of_megabytes(spark):
    rows = [(i, "the house and the garden", "en") for i in range(9)] + [(i + 20, "das haus und der garten", "de") for i in range(9)] + [(99, "das haus " * 400_000, None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[99] == "de"
