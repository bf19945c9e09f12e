import random

import numpy as np
import pytest
import xxhash

from stratadoc.llm import simhash


def plain_print(text, k=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (doc_id, fingerprint)."""
    parent = {d: d for d, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in pairs:
        for b, fb in pairs:
            if a < b and (fa ^ fb).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


def test_fingerprint():
    for text in ["", " \n", "One", "One two", "one TWO three", "a b c d a b c É\xa0x", "x " * 50]:
        assert simhash.shingle_fingerprint(text) == plain_print(text)


def test_near_equals_brute_force():
    rng = np.random.default_rng(3)
    for words, radius, n in ((1, 2, 300), (16, 155, 200), (2, 20, 130)):
        base = rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)
        for i in range(1, n, 2):  # neighbours at all kinds of distances
            base[i] = base[i - 1]
            for b in rng.integers(0, words * 64, rng.integers(0, 2 * radius)):
                base[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        want = {(i, j) for i in range(n) for j in range(n) if sum(int(x).bit_count() for x in base[i] ^ base[j]) <= radius}
        assert set(zip(*map(list, simhash.near(base, base, radius)), strict=True)) == want


def test_blocks_with_pivots():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (3, 1), dtype=np.uint64)
    prints = np.concatenate([np.repeat(centres[:1], 1500, 0), np.repeat(centres[1:2], 40, 0), rng.integers(0, 1 << 63, (60, 1), dtype=np.uint64)])
    for i in range(len(prints)):
        prints[i, 0] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    forest = simhash.Forest(len(prints))
    for a, b in simhash.block_links(prints, 2):
        forest.join(a, b)
    assert len({forest.root(i) for i in range(1500)}) == 1 and len({forest.root(i) for i in range(len(prints))}) == 62


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {k: got.get(k, k) for k in parent} == parent
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, "/root/testdata/sf0.001").collect()}
    prints = [(d, plain_print(t)) for d, t in src]
    comp = plain_components(prints)
    assert got == {d: (f"{p:016x}", comp[d]) for d, p in prints}


def test_odd_rows(spark):
    rows = [(5, None, "x"), (6, "", "x"), (7, "A b C", "x"), (8, "a B c", "x"), (8, "a B c", "x"), (None, "a b c", "x"), (9, "w " * 30_000, "x"), (None, "unseen", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_components(df).collect()), key=str)
    assert got == sorted([(5, 5), (6, 5), (7, 7), (8, 7), (8, 7), (None, 7), (9, 9), (None, None)], key=str)
    assert simhash.near_components(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.deduplicated(df).collect()) == [0, 0, 5, 7, 9]


def test_similar_documents(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper())]
    for i in range(2, 12):  # six of 400 words changed: a similarity of about 0.86
        words = base.copy()
        for j in range(6):
            words[rng.randrange(400)] = f"n{i}_{j}"
        rows.append((i, " ".join(words)))
    rows += [(50 + i, " ".join(f"w{rng.randrange(9999)}" for _ in range(300))) for i in range(20)]
    half = base[:230] + [f"w{rng.randrange(9999)}" for _ in range(170)]
    rows.append((90, " ".join(half)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(df).collect()} == {0, 90, *range(50, 70)}


def test_near_duplicates_at_the_similarity(spark):
    """Pairs of 0.8 and a little more are one component each; those a little below stay apart."""
    rng, rows, above = random.Random(4), [], {}
    for i in range(400):
        n, common = ((400, 357 + i % 3), (400, 353 - i % 3), (12, 12), (9, 8), (60, 54), (60, 53))[i % 6]  # shingles of both, and those they share
        word = lambda: f"w{rng.randrange(10**9)}"
        words = [word() for _ in range(n + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: common + 4] + [word() for _ in range(n - common)]))]
        above[2 * i + 1] = common >= 0.8 * (2 * n - common)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(above.values()) > 150 and {d: got[d] == d - 1 for d in above} == above
    assert simhash.candidate_radius(0.8) > simhash.wide_radius(0.8) + 48


def test_repeated_rows_stay_once(spark):
    rows = [(5, "one text here", 1), (5, "one text here", 2), (6, "one text here", 3), (7, "another", 4), (7, "other words", 5), (None, "x", 6), (None, "x", 7)]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, class int")).collect())
    assert kept == [(0, "x"), (0, "x"), (5, "one text here"), (7, "another"), (7, "other words")]


def test_sets_and_keys():
    own = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (simhash.unpacked_set(simhash.packed_set(own)) == own >> np.uint64(24)).all()
    assert len(simhash.unpacked_set(simhash.packed_set(own[:0]))) == 0
    assert len(set(simhash.block_keys(own[:1]).tolist())) == simhash.KEYS
    shared = [len(set(simhash.block_keys(own[:450]).tolist()) & set(simhash.block_keys(own[k:]).tolist())) for k in (0, 50, 440)]
    assert shared[0] > shared[1] > 0 == shared[2]


@pytest.mark.parametrize("rows_of_a_tile", [4096, 16])
def test_no_pivot_stands_for_unchecked_links(spark, monkeypatch, rows_of_a_tile):
    """A group in which many pairs are near 0.8, against all pairs by brute force."""
    monkeypatch.setattr(simhash, "TILE_ROWS", rows_of_a_tile)
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(204)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            words[rng.randrange(204)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(200)} for w in (t.split() for _, t in rows)]
    parent = list(range(120))
    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(parent)) and len(set(parent)) > 3
