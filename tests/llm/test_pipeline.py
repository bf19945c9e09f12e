import hashlib

import pytest

import corpus_pipeline
from stratadoc.llm import quality, simhash
from tests.llm.test_packing import checked
from tests.llm.test_suffix import plain

SF = "/root/testdata/sf0.001"


def similarity(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def plain_components(texts):
    """The smallest id that each document reaches by similarities of 0.8, over all pairs."""
    parent = {d: d for d in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if parent[a] != parent[b] and similarity(texts[a], texts[b]) >= 0.8:
                x, y = sorted((parent[a], parent[b]))
                parent = {d: x if p == y else p for d, p in parent.items()}
    return parent


@pytest.fixture()
def odd(spark, tmp_path):
    """A table of odd rows with clashing columns, and tables for the stages."""
    text = "a fair text of some plain words that says the same as others do, and more " * 6
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n\t"), (5, text + "end"), (6, "word " * 300_000), (None, text), (None, None), (7, "日本語 テキスト"), (8, text.upper())]
    docs = spark.createDataFrame([(d, t, ("en", None)[i % 2], "s", len(t or ""), 1, "x", b"k") for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, class int, ids string, keys binary")
    spark.createDataFrame([(1, 1, 0), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no document has this passage of several odd words here"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, str(tmp_path)


def test_stages_on_odd_rows(spark, odd):
    docs, sf = odd
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, sf)
            if name != "packing":
                assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
            rows = got.collect()
            assert rows if table is docs else not rows
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r.doc_id or 0, r["class"]) for r in stages["near_duplicates"](spark, docs, sf).collect()) == [(0, 1), (0, 1), (1, 1), (2, 1), (6, 1), (7, 1)]
    ids = [r.doc_id for r in stages["quality"](spark, docs, sf).collect()]
    assert ids.count(None) == 2 and not {2, 3, 4} & set(ids)
    assert stages["decontamination"](spark, docs, sf).count() == docs.count()
    cut = {(r.doc_id, r.n_chars) for r in stages["substrings"](spark, docs, sf).collect()}
    assert (2, None) in cut and (3, 0) in cut and sum(d is None for d, _ in cut) == 2


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, []
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        got = docs.collect()
        rows = {r.doc_id: r for r in got}
        assert len(rows) == len(got) and rows.keys() <= before.keys()
        names.append(name)
        if name == "quality":
            good = {r.doc_id for r in quality.op5_quality(spark, SF).collect() if r.accepted}
            assert rows.keys() == good
        if name == "near_duplicates":
            assert rows.keys() == set(plain_components({d: r.text for d, r in before.items()}).values())
        if name == "substrings":
            want = {d: h for d, _, _, _, h in plain([(d, r.text.encode()) for d, r in before.items()], 50)}
            assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in rows.items()} == want
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if name == "decontamination":
            passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(p in r.text for p in passages for r in rows.values())
    checked(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), [(d, r.text) for d, r in rows.items()])
    assert len(rows) > 80


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in rows}) > 80


def test_wide_radius():
    assert 150 < simhash.wide_radius(0.8) < 160 and simhash.wide_radius(1.0) == 0
