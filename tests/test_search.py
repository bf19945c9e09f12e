"""The registry search against a scan of all fields for each query."""

import random

from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.operators import evaluation as E


def plain_search(query, terms, fields, k):
    norm = lambda x: "".join((x or "").split()).casefold()
    q, out = norm(query), []
    if not q:
        return []
    for seq, field_id, label, meaning, notes in fields:
        parts = [norm(x) for x in (field_id, label, meaning, notes)]
        if q in parts[:2]:
            score = 1000
        elif any(hits := [q in x for x in parts]):
            score = (800, 800, 500, 200)[hits.index(True)]
        else:
            hits = [[norm(t) in x for x in parts] for t in terms or [] if norm(t)]
            score = sum((110, 90, 40, 20)[h.index(True)] for h in hits if any(h))
        if score:
            out.append((-score, seq, field_id))
    return [(field, -score, rank) for rank, (score, _, field) in enumerate(sorted(out)[:k], 1)]


def test_search_equals_a_scan(spark):
    rng = random.Random(3)
    words = ["title", "name", "author", "Straße", "date", "of", "the", "ab", "a", "b", "x1", "key words"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    fields = [(k, f"{some(3)}.{k}", some(4), some(8), some(8) if k % 3 else None) for k in range(150)] + [(150, "title", None, None, None), (151, None, "Title", "", "")]
    queries = [(k, some(6), None if k == 4 else [rng.choice([*words, "", "zzz"]) for _ in range(rng.randrange(5))]) for k in range(60)] + [(60, "title", ["title"]), (61, "", ["title"]), (62, None, ["title"]), (63, "STRASSE the", ["STRASSE", "the", "the"]), (64, "nowhere to be found", ["the", "a", "of"])]
    index = E.search_registry(spark.createDataFrame(queries, "query_id long, query string, terms array<string>"), spark.createDataFrame(fields, "seq long, field_id string, label string, meaning string, notes string"), T.norm_text, 4)
    got = {}
    for r in index.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.field_id, r.score, r.rank))
    assert got == {k: want for k, q, t in queries if (want := plain_search(q, t, fields, 4))}
    assert "NestedLoop" not in index._jdf.queryExecution().toString()
    assert E.search_registry(spark.createDataFrame([(1, "title", ["title"])], "query_id long, query string, terms array<string>"), spark.createDataFrame(fields[:5], "seq long, field_id string, label string, meaning string, notes string").drop("notes").withColumn("label", F.lit("title")), T.norm_text, 2).count() == 2
