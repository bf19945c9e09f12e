"""Chains and cycles of any depth, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stratadoc.operators import content as C
from stratadoc.operators import graphs as G
from stratadoc.operators import styles as S


def plain_chain(styles):
    """styles: {id: (based_on, type)}."""
    rows = []
    for start, (_, kind) in styles.items():
        seen, at, depth = [], start, 0
        while True:
            reason = "cycle" if at in seen else "missing" if at not in styles else "wrong_type" if styles[at][1] != kind else None
            rows.append((start, at, depth, reason))
            if reason or styles[at][0] is None:
                break
            seen.append(at)
            at, depth = styles[at][0], depth + 1
    return sorted(rows)


def test_style_chain(spark):
    styles = {i: (i - 1 if i else None, "p") for i in range(150)}  # a deep chain
    styles |= {200 + i: (200 + (i + 1) % 80, "p") for i in range(80)}  # a long cycle
    styles |= {300: (205, "p"), 301: (300, "p"), 302: (302, "p"), 303: (999, "p"), 304: (303, "p"), 305: (149, "c"), 306: (305, "c"), 307: (None, "c")}
    df = spark.createDataFrame([(k, *v) for k, v in styles.items()], "style_id long, based_on long, style_type string")
    assert sorted(map(tuple, S.style_chain(df).collect())) == plain_chain(styles)


def plain_cycles(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = set(), [*out.get(v, ())]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += out.get(x, ())
        return seen

    return {v for v in out if v in reach(v)}


DEEP = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)]


@pytest.mark.parametrize("kind", ["deep", "mixed"])
def test_cycles(spark, kind):
    rng = random.Random(3)
    if kind == "deep":
        edges = [*DEEP[:100], *[(f"x{i}", f"x{(i + 1) % 120}") for i in range(120)], ("x3", "y0"), ("y0", "y1"), ("z", "x7")]
    else:
        edges = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(70)] + [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("s", "a"), ("e", "t")]
    got = [r.node for r in S.find_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cycles(edges)


def test_a_ring_of_ten_thousand_with_chords(spark, monkeypatch):
    """Rounds, each one checkpoint at most, grow with the logarithm of the ring."""
    rounds, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: rounds.append(1) or cut(df))
    rng, n = random.Random(4), 10_000
    edges = [(k, (k + 1) % n) for k in range(n)] + [(k, k + 5000) for k in range(50, 4000, 900)] + [(77, 20_000)] + [(20_000 + k, 20_001 + k) for k in range(500)] + [(30_000 + k, 30_000 + (k + 1) % 700) for k in range(700)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node for r in G.find_cycles(df).collect()} == {*range(n), *range(30_000, 30_700)} and len(rounds) < 80
    rounds.clear()
    seen, missing = G.reachable(spark.createDataFrame([(20_100,), (5,)], "node long"), df.withColumn("external", F.lit(False)), df.select(F.col("src").alias("node")))
    assert seen.count() == n + 501 and [r.node for r in missing.collect()] == [20_500] and len(rounds) < 80


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    """Trees, rings, rings with tails and knots, against plain search."""
    rng = random.Random(seed)
    edges = [(f"t{k}", f"t{rng.randrange(k)}") if seed % 2 else (f"t{rng.randrange(k)}", f"t{k}") for k in range(1, 60)]
    edges += [(f"r{k}", f"r{(k + 1) % 20}") for k in range(20)] + [(f"g{rng.randrange(25)}", f"g{rng.randrange(25)}") for _ in range(rng.randrange(15, 45))]
    every = [x for e in edges for x in e]
    edges += [(rng.choice(every), rng.choice(every)) for _ in range(6)]
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(todo):
        seen = {*todo}
        todo = [*todo]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    df = spark.createDataFrame(edges, "src string, dst string")
    labels = {r.node: r.component for r in G.strong_components(df).collect()}
    far = {v: reach([v]) for v in set(every)}
    assert all((labels[a] == labels[b]) == (a in far[b] and b in far[a]) for a in far for b in far) and labels.keys() == far.keys()
    seeds = rng.sample(sorted(far), 3)
    seen, _ = G.reachable(spark.createDataFrame([(v,) for v in seeds], "node string"), df.withColumn("external", F.lit(False)), df.select(F.col("src").alias("node")))
    got = [r.node for r in seen.collect()]
    assert len(got) == len(set(got)) and set(got) == reach(seeds)
    assert {r.node for r in G.find_cycles(df).collect()} == plain_cycles(edges)


def test_a_chain_of_a_thousand(spark):
    edges = spark.createDataFrame([(a, b, False) for a, b in DEEP] + [("n0500", "out", True)], "src string, dst string, external boolean")
    seen, missing = S.reachable(spark.createDataFrame([("n0000",)], "node string"), edges, edges.select(edges.src.alias("node")))
    assert seen.count() == 1001 and [r.node for r in missing.collect()] == ["n1000"]
    assert S.find_cycles(edges).count() == 0


def test_leak_scan(spark):
    canaries = [(1, "password hunter2"), (2, "hunter2"), (3, "no such secret anywhere"), (4, "öäü ß"), (5, "a"), (6, None), (7, "line\nbreak in a secret")]
    texts = [("logs", "xpassword hunter2xyz"), ("logs", "some öäü ßtext"), ("mail", "A HUNTER2"), ("mail", None), ("mail", ""), ("mail", "tail: " + "z" * 50 + "password hunter2"), ("mail", "xxline\nbreak in a secretyy"), ("logs", "xpassword hunter2xyz")]
    got = {(r.canary_id, r.surface): r.hits for r in C.leak_scan(spark.createDataFrame(canaries, "canary_id long, text string"), spark.createDataFrame(texts, "surface string, text string"), ["logs", "mail"]).collect()}
    assert got == {(i, s): sum(t is not None and c is not None and c in t for u, t in texts if u == s) for i, c in canaries for s in ("logs", "mail")}


@pytest.mark.parametrize("most,size", [(32, 24_000), (3, 20)])
def test_plan_batches(spark, most, size):
    rng, rows, want = random.Random(5), [], {}
    for doc in range(4):
        batch, n, total = 0, 0, 0
        for block in range((0, 1, 70, 200)[doc]):
            value = "x" * rng.choice([0, 3, 9, 30, 1500])
            if n and (n >= most or total + len(value) > size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + len(value)
            rows.append((doc, block, 0, value))
            want[doc, block] = batch
    got = {(r.doc_id, r.block): r.batch for r in C.plan_batches(spark.createDataFrame(rows, "doc_id long, block long, inline long, value string"), most, size).collect()}
    assert got == want
