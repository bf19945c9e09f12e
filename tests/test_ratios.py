"""Ratios of many pairs at once against difflib, and similarity in steps against the one expression."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stratadoc.operators import alignment as A
from stratadoc.operators.ratios import ratios


def some_pairs(rng, letters, longest, n):
    text = lambda size: "".join(rng.choice(letters) for _ in range(rng.randrange(size + 1)))
    for _ in range(n):
        x = text(longest)
        yield x, x[: len(x) // 2] + text(longest // 3) + x[len(x) // 2 :] if rng.random() < 0.4 else text(longest)


@pytest.mark.parametrize("autojunk", [False, True])
def test_ratios_are_those_of_difflib(autojunk):
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "b"), ("x" * 700, "x" * 650)]
    for letters, longest in (("ab", 9), ("abcdefgh ", 90), ("etaoinshrdlu", 450), ("é好🙂\U0010ffff", 40)):
        pairs += some_pairs(rng, letters, longest, 60)
    want = [SequenceMatcher(None, x, y, autojunk=autojunk).ratio() for x, y in pairs]
    for least in (0.0, 0.2, 0.58):
        assert ratios(*zip(*pairs), least, autojunk).tolist() == [r if r >= least else 0.0 for r in want]
    assert ratios([], []).tolist() == []


def test_many_pairs_take_less_than_one_at_a_time():
    rng = random.Random(4)
    pairs = [*some_pairs(rng, "etaoinshrdlu ", 250, 3000)]
    start = time.process_time()
    got = ratios(*zip(*pairs), A.ANY_RATIO)
    middle = time.process_time()
    want = [SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs]
    assert got.tolist() == [r if r >= A.ANY_RATIO else 0.0 for r in want]
    assert middle - start < time.process_time() - middle


def test_similarity_in_steps(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(["alpha", "beta ", "<SLOT>", "：", "□", "ab", " "]) for _ in range(rng.randrange(5)))
    rows = [(k, x := text(), x if rng.random() < 0.2 else text(), rng.choice([True, False, None]), rng.choice([True, False, None])) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, a string, b string, cell boolean, one boolean")
    score, method = A.paragraph_similarity(F.col("a"), F.col("b"), F.col("cell"), F.col("one"))
    want = {tuple(r) for r in df.select("k", score.alias("similarity"), method.alias("method")).collect()}
    steps = A.with_similarity(df, "a", "b", F.col("cell"), F.col("one"))
    assert {(r.k, r.similarity, r.method) for r in steps.collect()} == want
    assert len({m for _, _, m in want}) > 6
