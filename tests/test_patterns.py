"""Many strings in many texts, against plain containment."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratadoc.operators import content as C
from stratadoc.operators import evaluation as E
from stratadoc.operators import patterns as P


@pytest.mark.parametrize("block,in_pass,in_task", [(1 << 20, 1 << 24, 1 << 24), (20, 100, 300)])
def test_held_strings(spark, monkeypatch, block, in_pass, in_task):
    monkeypatch.setattr(P, "BLOCK_CHARS", block)
    monkeypatch.setattr(P, "PASS_CHARS", in_pass)
    monkeypatch.setattr(P, "HELD_CHARS", in_task)
    rng = random.Random(1)
    made = lambda n: "".join(rng.choice("ab é\n日😀\x00") for _ in range(n))
    strings = [made(rng.randrange(1, 7)) for _ in range(80)] + ["", None, "a", "a", "        ", "x" * 200]
    texts = [(k, made(rng.randrange(60))) for k in range(120)] + [(120, None), (121, ""), (3, "a"), (3, "a"), (None, " " * 30 + "x" * 300)]
    df = spark.createDataFrame(texts, "k long, text string").repartition(3)
    got = Counter((r.k, r.string) for r in P.held_strings(df, spark.createDataFrame([(s,) for s in strings], "string string")).collect())
    assert got == Counter((k, s) for k, t in texts for s in {*strings} if s is not None and t is not None and s in t)
    assert P.held_strings(df, spark.createDataFrame([], "string string")).count() == 0
    assert P.held_strings(df.limit(0), spark.createDataFrame([("a",)], "string string")).count() == 0


def test_no_join_of_texts_and_strings(spark):
    texts = spark.createDataFrame([("s", "some text")], "surface string, text string")
    scan = C.leak_scan(spark.createDataFrame([(1, "e")], "canary_id long, text string"), texts, ["s"])
    assert "NestedLoop" not in scan._jdf.queryExecution().toString() and scan.first().hits == 1


def test_residue_scan(spark):
    rng = random.Random(2)
    docs = [(k, f"s{k % 3}", rng.choice([None, "", "abc def", "xx TODO yy", "left over here", "TODO"])) for k in range(40)] + [(1, "s1", "other rows of one id: TODO")]
    regions = [(k, f"s{k % 4}", rng.choice([None, "TODO", "over", "", "zzz"])) for k in range(30)]
    got = Counter(map(tuple, E.residue_scan(spark.createDataFrame(regions, "region_id long, source string, forbidden string"), spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()))
    assert got == Counter((d, r, "UNKNOWN" if f is None else "FAIL" if t is not None and f in t else "PASS") for d, s, t in docs for r, u, f in regions if s == u)
