import random

import numpy as np

from stratadoc.llm import decontam


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        assert decontam.common_length(a, b) == plain_common(a, b)


def test_basis_spans_the_passages(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    weight = np.linspace(1, 3, decontam.FEATURES)
    known, basis = decontam.latent_basis(bench, weight, 64)
    words = decontam.Words()
    for r in bench.collect():
        own, value = decontam.vector(words.ids(r.text), weight)
        assert abs(np.linalg.norm(value @ basis[np.searchsorted(known, own)]) - 1) < 1e-6  # rank 64 holds 40 passages
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)


def test_recall_against_brute_force(spark):
    """Brute force: every window against every passage by common words alone."""
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    words, want = decontam.Words(), set()
    items = [(r.item_id, words.ids(r.text).tolist()) for r in bench]
    for d in docs:
        ids = words.ids(d.text).tolist()
        for item, own in items:
            rare = set(own)
            for s in range(0, max(1, len(ids) - decontam.STRIDE), decontam.STRIDE):
                part = ids[max(0, s - len(own)) : s + decontam.WINDOW + len(own)]
                if len(rare & set(part)) >= decontam.SAME * len(rare) * 0.9 and decontam.common_length(own, part) >= decontam.SAME * len(own):
                    want.add((d.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in decontam.op8_decontamination(spark, sf).collect() if r.common_share >= decontam.SAME}
    assert want and len(want & got) >= 0.9 * len(want) and not got - want


def made(rng, n):
    return [rng.choice("qwertzuiopasdfghjkl") + "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_paraphrases_blocks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    items = [made(rng, rng.randint(15, 60)) for _ in range(30)]
    docs = []
    for i in range(60):
        text = made(rng, rng.randint(40, 300))
        if i < 20:  # a fifth of the words changed, case and punctuation too
            words = [w if rng.random() < 0.8 else made(rng, 1)[0] for w in items[i]]
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in words]
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "..."), (103, " ".join(items[29]) + " " + "word " * 30_000), (103, " ".join(items[29])), (None, " ".join(items[28]))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = sorted([(i, i) for i in range(20)] + [(103, 29), (103, 29), (None, 28)], key=str)
    for words in (decontam.BLOCK_WORDS, 400):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        assert sorted(((r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()), key=str) == want
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20_000)
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {*range(20, 60), 100, 101, 102, None}
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_more_passages_than_directions(spark):
    """A verbatim copy of each of 1,000 passages is found, in one block of words."""
    rng = random.Random(3)
    items = [made(rng, 20) for _ in range(1000)]
    docs = [(i, " ".join(made(rng, 60) + x + made(rng, 60))) for i, x in enumerate(items)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} >= {(i, i) for i in range(1000)}


def test_passages_of_all_lengths(spark):
    """Verbatim copies of 3 to 600 words at any place, copies with half of the words changed, and scripts without spaces."""
    rng = random.Random(5)
    word = lambda: made(rng, 1)[0]
    items = [made(rng, n) for n in (3, 4, 5, 6, 8, 10, 12, 14, 20, 30, 45, 60, 100, 200, 300, 500, 600) for _ in range(6)]
    docs = []
    for i, x in enumerate(items):
        if i % 6 > 3 and len(x) > 14:
            answer = set(x[:2])
            x = [w if w in answer or k % 2 else word() for k, w in enumerate(x)]
        docs.append((i, " ".join(made(rng, rng.randint(40, 90)) + x + made(rng, 70))))
    answers = [" ".join(x[:2]) for x in items]
    han = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n)) for n in (12, 40, 90, 300)]
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(40))
    own = len(items)
    docs += [(own + i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(77)) + x + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(50))) for i, x in enumerate(han)] + [(own + 4, "กขค" * 20 + thai + "งจฉ" * 20)]
    rows = [(i, " ".join(x), a) for i, (x, a) in enumerate(zip(items, answers, strict=True))] + [(own + i, x, None) for i, x in enumerate([*han, thai])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string, answer string")
    missing = {i for i in range(len(rows))} - {r.doc_id for r in decontam.leaks(df, bench).collect() if r.doc_id == r.item_id}
    assert not missing
