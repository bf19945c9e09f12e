"""Telemetry operators against plain Python."""

import datetime
import decimal
import math
import random
from collections import defaultdict

from stratadoc.operators import telemetry as T
from stratadoc.plans import telemetry_queries as Q


def plain_eviction(rows, most, most_bytes):
    """rows of one run in order: (sequence, priority, size). The sequences that stay."""
    held = []
    for sequence, own, size in rows:
        while len(held) >= most or sum(x[2] for x in held) + size > most_bytes:
            lower = [x for x in held if x[1] > own and x[1] != "P0"]
            if not lower:
                break
            held.remove(min(lower, key=lambda x: (-int(x[1][1]), x[0])))
        else:
            held.append((sequence, own, size))
    return {x[0] for x in held}


def test_eviction(spark):
    rng = random.Random(1)
    rows = [("a", i, f"e{i}", "k", "P2" if i < 5 else "P0", 1) for i in range(8)]
    rows += [(f"r{n}", i, f"e{i}", "k", rng.choice(["P0", "P1", "P2"]), rng.randrange(1, 9)) for n in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id string, source_sequence long, source_event_id string, kind string, priority string, size long").repartition(3)
    got, by = defaultdict(set), defaultdict(list)
    out = T.evict_by_priority(df, 5, 25).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.kept:
            got[r.run_id].add(r.source_sequence)
    for r in rows:
        by[r[0]].append((r[1], r[4], r[5]))
    assert got["a"] == {3, 4, 5, 6, 7} and got == {k: plain_eviction(v, 5, 25) for k, v in by.items()}
    assert T.evict_by_priority(df.limit(0), 5, 25).count() == 0


def test_eviction_leaves_columns_as_they_are(spark, monkeypatch):
    """Longs beside nulls, decimals, times, lists and maps come back bit for bit, whatever the batches."""
    kinds = "run_id string, source_sequence long, source_event_id string, kind string, priority string, size long, big long, exact decimal(38,10), at timestamp, parts array<long>, named map<string,double>, _1 struct<a:long>"
    rng = random.Random(3)
    some = lambda x: x if rng.random() < 0.6 else None
    rows = [(f"r{rng.randrange(3)}", i, f"e{i}", "k", rng.choice(["P0", "P1", "P2", "P2"]), rng.randrange(1, 9), some(2**53 + 1 + i), some(decimal.Decimal(f"{10**20 + i}.0000000001")), some(datetime.datetime(2024, 1, 1, 0, 0, 0, i)), some([2**60 + i, None]), some({"x": 0.1 * i}), some((2**54 + i,))) for i in range(300)]
    rows += [(None, 1, None, None, "P1", 3, 2**53 + 1, None, None, None, None, None), ("r1", None, None, None, None, 3, None, None, None, None, None, None), ("r1", 5000, "x", "k", "P9", None, 7, None, None, None, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = T.evict_by_priority(spark.createDataFrame(rows, kinds), 6, 30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda r: str([v.asDict() if hasattr(v, "asDict") else {"a": v[0]} if isinstance(v, tuple) else v for v in r])
    assert sorted(plain(r[:-1]) for r in out) == sorted(map(plain, rows))
    for run in ("r0", "r1", "r2"):
        own = sorted(r for r in rows if r[0] == run and r[4] in T.PRIORITIES and r[5] is not None)
        assert {r.source_sequence for r in out if r.run_id == run and r.kept} == plain_eviction([(r[1], r[4], r[5]) for r in own], 6, 30)


def test_query_of_eviction(spark):
    """All events of a table ten times as large; some runs have several events of one number."""
    rows = defaultdict(list)
    kept = defaultdict(int)
    for r in Q.QUERIES["ss05_evict_by_priority"](spark, "/root/testdata/sf0.01").collect():
        rows[r.run_id].append((r.source_sequence, r.priority, r.size))
        kept[r.run_id] += r.kept
    events = defaultdict(list)
    for r in Q.events(spark, "/root/testdata/sf0.01").select("run_id", "source_sequence", "source_event_id", "kind", "priority", "size").collect():
        events[r.run_id].append(((r.source_sequence, r.source_event_id, r.kind), r.priority, r.size))
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted((x[0], p, n) for x, p, n in v) for k, v in events.items()}
    assert kept == {k: len(plain_eviction([(i, p, n) for i, (_, p, n) in enumerate(sorted(v))], 20, 2200)) for k, v in events.items()}


def test_nearest_rank(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 0.0, -3.5, rng.gauss(0, 1000), float(rng.randrange(5))])) for k in ("a", "b", "c") for _ in range(400)] + [("d", 1.5), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.05, 0.5, 0.95, 1.0):
        got = {r.k: r.rank_value for r in T.nearest_rank(df, "k", "v", share).collect()}
        values = {k: sorted(v for x, v in rows if x == k and v is not None) for k in "abcd"}
        assert got == {k: v[math.ceil(share * len(v)) - 1] for k, v in values.items()}


def test_rules_on_actors_attributes_evidence_and_errors(spark):
    kinds = "n long, schema_version int, run_id string, source_event_id string, source_sequence long, observed_at string, offset_ms double, source string, priority string, kind string, status string, tool_use_id string, tool_name string, duration_ms double, actor struct<role:string,agent_id:string,agent_type:string>, attributes array<struct<key:string,value:string>>, evidence_refs array<struct<kind:string,value:string,document_sha256:string,render_sha256:string>>, error struct<code:string,origin:string>"
    good = {"n": 0, "schema_version": 1, "run_id": "run_" + "a" * 32, "source_event_id": "e1", "source_sequence": 0, "observed_at": "2024-01-01", "offset_ms": 1.0, "source": "sdk", "priority": "P0", "kind": "tool_use", "status": None, "tool_use_id": None, "tool_name": None, "duration_ms": None, "actor": ("main", None, None), "attributes": [("dpi", "96"), ("mode", '"pages"'), ("errors", '["a","b"]'), ("issues", "[]"), ("overview", "true"), ("focus", "null")], "evidence_refs": [("page", "3", None, None), ("document", "0" * 64, "1" * 64, None)], "error": ("bad_input", "request")}
    cases = [
        ({}, None), ({"attributes": None, "evidence_refs": None, "error": None}, None), ({"schema_version": 2}, "schema"), ({"schema_version": None, "run_id": "x"}, "schema"), ({"run_id": "x", "actor": ("boss", None, None)}, "run_id"),
        ({"actor": ("boss", None, None)}, "actor"), ({"actor": None}, "actor"), ({"actor": ("tool", "a b", None)}, "identifier"), ({"attributes": [("unknown_key", "1")]}, "attributes"), ({"attributes": [("dpi", "-1")]}, "attributes"),
        ({"attributes": [("dpi", "1"), ("dpi", "2")]}, "attributes"), ({"attributes": [("mode", '"a b"')]}, "attributes"), ({"attributes": [("errors", "[" + ",".join(["1"] * 257) + "]")]}, "attributes"), ({"attributes": [("errors", "[" + ",".join(["1"] * 256) + "]")]}, None),
        ({"attributes": [("dpi", None)]}, "attributes"), ({"evidence_refs": [("page", "0", None, None)]}, "evidence"), ({"evidence_refs": [("page", "1", "xyz", None)]}, "evidence"), ({"evidence_refs": [("other", "1", None, None)]}, "evidence"),
        ({"evidence_refs": [("page", "1", None, None)] * 257}, "evidence"), ({"error": ("Bad", "request")}, "error"), ({"error": (None, "request")}, "error"), ({"duration_ms": -1.0, "error": ("Bad", "x")}, "duration"), ({"evidence_refs": [("page", "1" * 70_000, None, None)]}, "too_large"),
    ]
    rows = [tuple((good | change | {"n": k}).values()) for k, (change, _) in enumerate(cases)]
    accepted, rejected = T.validate_events(spark.createDataFrame(rows, kinds), full=True)
    got = {r.n: r.code for r in rejected.collect()} | {r.n: None for r in accepted.collect()}
    code = lambda c: None if c is None else "event_too_large" if c == "too_large" else f"event_{c}_invalid"
    assert got == {k: code(c) for k, (_, c) in enumerate(cases)}


def test_an_event_keeps_its_own_sequence_number(spark):
    """A repeat under a number that an event has by its own id gives way, whichever comes first."""
    from stratadoc.plans import telemetry_queries as Q

    own, repeat = ("r", 1_000_100, 5.0, "sdk", "e1000100", "tool_use"), ("r", 1_000_100, 9.0, "hook", "e100", "tool_use")
    kind = "run_id string, source_sequence long, offset_ms double, source string, source_event_id string, kind string"
    for rows in ([repeat, own], [own, repeat]):
        found = Q.one_each(spark.createDataFrame(rows, kind).coalesce(1)).select(*[c.split()[0] for c in kind.split(", ")]).collect()
        assert [tuple(r) for r in found] == [own]
