import random
import re

import numpy as np
import pytest

from stratadoc.llm import minhash, simhash

SF = "/root/testdata/sf0.001"


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_components(rows, k=2):
    """rows: (doc_id, text) with distinct ids; every pair is looked at."""
    sets = [(d, plain_set(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, own) in enumerate(sets):
        for b, other in sets[i + 1 :]:
            both = len(own & other)
            if own and other and 100 * both >= 80 * (len(own) + len(other) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets}


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert answers(minhash.op11_minhash(spark, SF)) == plain_components(rows)


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(2)
    for common, each in ((400, 50), (60, 10), (4, 1), (100, 300)):
        got = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, common + 2 * each).astype(np.uint64) * np.uint64(2)
            a, b = (minhash.signature(minhash.minima(s)) for s in (x[: common + each], x[each:]))
            got.append(minhash.estimate(minhash.differing(a, b)))
        assert abs(np.mean(got) - common / (common + 2 * each)) < 0.03 and max(map(abs, got - np.mean(got))) < 0.2


def test_low_bits_and_counts():
    least = np.arange(minhash.SLOTS, dtype=np.uint32) * np.uint32(7) + np.uint32(3)
    bits = [int(minhash.signature(least)[i // 16]) >> 4 * (i % 16) & 15 for i in range(minhash.SLOTS)]
    assert bits == [int(x) & 15 for x in least]
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, (5, 8), dtype=np.uint64), rng.integers(0, 1 << 63, (9, 8), dtype=np.uint64)
    y[:5] = x ^ np.uint64(0x1001)
    slots = lambda v: [int(w) >> k & 15 for w in v for k in range(0, 64, 4)]
    want = [[sum(p != q for p, q in zip(slots(u), slots(v), strict=True)) for v in y] for u in x]
    assert minhash.differing(x[:, None], y[None]).tolist() == want and want[0][0] == 16
    for cells in (1, 20, 1 << 18):
        a, b = minhash.may_be_similar(x, y, 119, cells)
        assert [*zip(a, b, strict=True)] == [(i, j) for i in range(5) for j in range(9) if want[i][j] <= 119]
    assert len(set(minhash.band_keys(least).tolist())) == minhash.BANDS


def made(rng, n, common, k):
    """Two texts of n shingles of k words each, of which they share so many."""
    word = lambda: f"w{rng.randrange(10**9)}"
    words = [word() for _ in range(n + k - 1)]
    return " ".join(words), " ".join(words[: common + k - 1] + [word() for _ in range(n - common)])


@pytest.mark.parametrize("k", [2, 5])
def test_pairs_at_the_similarity(spark, k):
    rng, rows, above = random.Random(4), [], {}
    for i in range(300):
        n, common = ((400, 357 + i % 3), (400, 353 - i % 3), (12, 11), (9, 8), (60, 54), (60, 53))[i % 6]
        rows += enumerate(made(rng, n, common, k), 2 * i)
        above[2 * i + 1] = 100 * common >= 80 * (2 * n - common)
    got = answers(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=k))
    assert {d: not got[d][2] for d in above} == above and 0 < sum(above.values()) < len(above)
    assert all(got[d][1] == d - 1 for d, near in above.items() if near)


@pytest.mark.parametrize("rows_of_a_tile", [4096, 16])
def test_a_large_group_in_tiles(spark, monkeypatch, rows_of_a_tile):
    """Texts near one another in one block: links only between some, found whichever tiles they lie in."""
    monkeypatch.setattr(simhash, "TILE_ROWS", rows_of_a_tile)
    rng, rows = random.Random(rows_of_a_tile), []
    base = [f"w{rng.randrange(999)}" for _ in range(60)]
    for i in range(150):
        words = base.copy()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(60)] = f"n{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    assert answers(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)) == plain_components(rows)


def test_odd_rows(spark):
    rows = [(5, None, "x"), (6, "", "x"), (7, " \n", "x"), (8, "A b C", "x"), (9, "a B  c", "x"), (9, "a B c", "x"), (None, "a b c", "x"), (10, "w " * 300_000, "x"), (None, "unseen", "x"), (None, None, "x"), (11, "One", "x"), (12, "one", "x"), (13, "a\x0bb\xa0c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=2).collect()), key=str)
    want = [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 2, 8, True), (9, 2, 8, False), (9, 2, 8, False), (None, 2, 8, False), (10, 1, 10, True), (None, 1, None, False), (None, 0, None, False), (11, 1, 11, True), (12, 1, 11, False), (13, 1, 13, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
