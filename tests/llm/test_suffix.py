import datetime
import decimal
import hashlib
import random

import numpy as np
import pandas as pd
import zstandard

from stratadoc.llm import suffix


def plain(rows, size):
    """rows: (id, bytes)."""
    first = {}
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - size + 1):
                w = b[i : i + size]
                first[w] = min(first.get(w, 1 << 62), d)
    out = []
    for d, b in rows:
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - size + 1):
                if first[b[i : i + size]] < d:
                    gone[i : i + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = rng.integers(97, 100, 200, dtype=np.uint8)
        room = 200 - np.arange(200)
        for depth in (5, 8, 13, 50):
            order = suffix.suffix_array(text, room, depth)
            got = [text[i : i + depth].tobytes() for i in order]
            assert got == sorted(text[i : i + depth].tobytes() for i in range(201 - depth))
            lcp = suffix.common_prefixes(text, order, depth)
            want = [0] + [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(got, got[1:])]
            assert lcp.tolist() == want


def run(df, size):
    return sorted((tuple(r) for r in suffix.removed(df, size).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def made(rng):
    words = [("w%d" % i) * rng.randint(1, 3) for i in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, rows = say(60), []
    for i in range(60):
        kind = i % 6
        text = say(rng.randint(0, 80))
        if kind == 1:
            text = say(5) + common + say(9)
        elif kind == 2 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 3 and rows:
            old = rng.choice(rows)[1] or ""
            text = old[: len(old) // 2] + "é" + old[len(old) // 2 + 3 :]
        elif kind == 4:
            text = "ab" * rng.randint(0, 300) + "\0" * rng.randint(0, 80)
        rows.append((rng.randrange(1000), text))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    for size, shard in ((50, 4 << 20), (24, 2000)):
        monkeypatch.setattr(suffix, "SHARD", shard)
        monkeypatch.setattr(suffix, "LEAST_BUCKETS", 256 if size == 50 else 2)
        rows = made(rng) + [(5, None), (6, ""), (7, "same row " * 20), (7, "same row " * 20), (None, "same row " * 20), (2000, "x" * 70_000)]
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(5)
        assert run(df, size) == plain([(d, (t or "").encode()) for d, t in rows], size)


def test_empty(spark):
    assert suffix.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(df, 50) == plain([(r.doc_id, r.text.encode()) for r in df.collect()], 50)


def test_rows_keep_their_columns(spark):
    text = "".join(f"sentence {i} is here. " for i in range(9))
    df = spark.createDataFrame([(1, text, "a", 2), (2, "x " + text + "é", None, 3), (3, None, "c", None), (None, text, "d", 4)], "doc_id long, text string, rest string, n int")
    got = {(r.doc_id, r.text, r.rest, r.n) for r in suffix.deduplicated(df).collect()}
    assert got == {(1, text, "a", 2), (2, "x é", None, 3), (3, None, "c", None), (None, text, "d", 4)}


def test_other_columns_stay_as_they_are(spark):
    when = datetime.datetime(2024, 5, 1, 10, 0, 1, 123456)
    rows = [(1, "one text", when, b"\x00\xff", decimal.Decimal("1.10"), {"a": 1}, [None, 2], "id"), (2, None, None, None, None, None, None, None), (None, "free", when, b"", decimal.Decimal("0.01"), {}, [], "x")]
    kind = "doc_id long, text string, at timestamp, raw binary, price decimal(5,2), of map<string,int>, list array<int>, rest string"
    df = spark.createDataFrame(rows, kind)
    got = suffix.deduplicated(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert suffix.deduplicated(df.select("doc_id", "text")).count() == 3


def test_equal_contexts_of_a_shard_are_sorted_once(monkeypatch):
    rng = np.random.default_rng(3)
    text, other = (bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (70, 60))
    contexts = [(0, 5, [(0, 9, text), (100, 7, other)]), (1, 6, [(50, 4, text)]), (2, 7, [(0, 12, text), (90, 8, other + b"z")])]
    frame = pd.DataFrame([(0, blob, False, suffix.pack(np.array([c[0] for c in own], np.int32)), suffix.pack(np.array([c[1] for c in own], np.int64)), suffix.pack(np.array([len(c[2]) for c in own], np.int32)), zstandard.compress(b"".join(c[2] for c in own))) for _, blob, own in contexts], columns=["shard", "blob", "local", "at", "ids", "sizes", "data"])
    sorted_bytes = []
    monkeypatch.setattr(suffix, "Windows", lambda data, *more, own=suffix.Windows: (sorted_bytes.append(len(data)), own(data, *more))[1])
    got = sorted((r.blob, *pair) for r in suffix.judged(frame, 50).itertuples() for pair in zip(suffix.unpack(r.at, np.int32).tolist(), suffix.unpack(r.sizes, np.int32).tolist(), strict=True))
    assert got == [(5, 0, 70), (7, 0, 70), (7, 90, 60)]
    assert sum(sorted_bytes) == 70 + 60 + 61


def test_gram_hashes():
    part = np.random.default_rng(2).integers(0, 255, 300, dtype=np.uint8)
    for gram in (1, 2, 5, 8, 13, 20):
        want = np.zeros(301 - gram, np.uint64)
        for i in range(gram):
            want = want * np.uint64(0x9E3779B97F4A7C15) + part[i : i + len(want)]
        assert (suffix.gram_hashes(part, gram) == want).all()


def shard_of(texts, size):
    """The one shard's row that a blob of documents sends."""
    row = {"ids": suffix.pack(np.arange(len(texts))), "sizes": suffix.pack(np.array([*map(len, texts)])), "data": zstandard.compress(b"".join(texts)), "n_bytes": sum(map(len, texts))}
    blob = suffix.Blob(row, None)
    h, first, last, doc = blob.contexts(size)
    sizes = last - first + size
    data = b"".join(blob.data[a : a + n].tobytes() for a, n in zip(first, sizes))
    parts = (h % np.uint64(suffix.PARTS)).astype(np.uint32) << np.uint32(24)
    return pd.DataFrame([(0, 0, False, suffix.pack(first.astype(np.int32)), suffix.pack(doc), suffix.pack(sizes.astype(np.uint32) | parts), zstandard.compress(data))], columns=[x.split()[0] for x in suffix.CONTEXTS.split(", ")])


def test_arrays_of_a_shard_share_no_window(monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcd ") for _ in range(90)) for _ in range(60)]
    texts = ["".join(rng.choice(lines) for _ in range(rng.randint(1, 6))).encode() for _ in range(80)]
    grids, own = [], suffix.Windows.sorted_windows
    monkeypatch.setattr(suffix.Windows, "sorted_windows", lambda self, *part: (grids.append(len(own(self, *part))), own(self, *part))[1])
    want = [(n, gone) for _, n, gone, _, _ in sorted(plain([*enumerate(texts)], 50), key=lambda r: r[0])]
    # parts that fit: no window is written out; one part in many arrays: each window twice, and a sample
    for shard, parts, most in ((4 << 20, 256, 0), (5000, 256, 0), (5000, 1, 3 * sum(map(len, texts)))):
        monkeypatch.setattr(suffix, "SHARD", shard)
        monkeypatch.setattr(suffix, "PARTS", parts)
        grids.clear()
        edge = np.zeros(sum(map(len, texts)) + 1, int)
        for mark in suffix.judged(shard_of(texts, 50), 50).itertuples():
            at, sizes = suffix.unpack(mark.at, np.int32), suffix.unpack(mark.sizes, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + sizes, -1)
        gone = np.split(np.cumsum(edge[:-1]) > 0, np.cumsum([*map(len, texts)])[:-1])
        assert [(len(x), int(x.sum())) for x in gone] == want
        assert sum(grids) <= most and bool(grids) == (parts == 1)
