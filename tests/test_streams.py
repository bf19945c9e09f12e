"""Stateful streams: the same rows for every cut of the events into batches, and every query ends."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratadoc.operators import telemetry as T
from stratadoc.streaming import runs

USE = "run_id string, tool_use_id string, kind string, at timestamp"
EVENT = "run_id string, source_sequence long, source_event_id string, kind string, priority string, size long, at timestamp"


def played(spark, folder, rows, kinds, cuts, operator):
    """The rows that a stream over the cut rows gives, ended by its own trigger; a minute at most."""
    (folder / "in").mkdir(parents=True)
    for k, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        made = folder / f"part{k}"
        frame = spark.createDataFrame([(*r[:-1], r[-1] and r[-1] / 1000) for r in rows[low:high]], kinds.replace("at timestamp", "at double"))
        frame.withColumn("at", F.timestamp_millis((F.col("at") * 1000).cast("long"))).coalesce(1).write.parquet(str(made))
        source = next(made.glob("*.parquet"))
        source.rename(folder / "in" / f"{k:03}.parquet")
        __import__("os").utime(folder / "in" / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = operator(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
    query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60), "the stream didn't end"
    finally:
        query.stop()
    return Counter(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(folder / "out")).collect())


@pytest.fixture(autouse=True)
def small_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_lifecycles(rows, timeout, delay):
    """Event by event; at the end what the watermark has passed."""
    by, out = defaultdict(list), Counter()
    for run, use, kind, at in rows:
        if use is not None and at is not None and kind != "note":
            by[run, use].append((at, kind in T.TERMINAL_KINDS, kind))
    now = max((r[3] for r in rows if r[3] is not None), default=0) - delay
    for (run, use), events in by.items():
        start = end = None
        told = False
        for at, ends, _ in [*sorted(events), (now, None, None)]:
            if start is not None and end is None and at > start + timeout:
                end = start + timeout
                out[run, use, "timeout"] += 1
            if end is not None and at > end + timeout:
                start, end, told = None, None, False
            if ends is None:
                continue
            if not ends and (end is None or at <= end):
                out[run, use, "partial"] += not told
                start, told = (at if start is None else start), True
            elif ends and end is None:
                end = at
                out[run, use, "closed"] += 1
    return +out


def test_open_lifecycles(spark, tmp_path):
    rng = random.Random(5)
    rows = [("r", "t1", "tool_use", 1000), ("r", "t2", "tool_use", 1000), ("r", None, "tool_use", 1000), ("r", "t1", "tool_post", 1500), ("r", "t9", "tool_result", 1600), ("r", "t3", "tool_use", 9000), ("r", "t2", "tool_post", 9001)]
    rows += [(f"r{rng.randrange(3)}", f"u{rng.randrange(12)}", rng.choice(["tool_use", "tool_pre", "tool_post", "tool_result", "note"]), 10_000 + 40 * k) for k in range(300)]
    rows += [("r", "none", "tool_use", None), ("r1", "last", "tool_use", 22_000)]
    want = plain_lifecycles(rows, 900, 0)
    assert {s for _, _, s in want} == {"partial", "closed", "timeout"} and want["r", "t2", "timeout"] == 1 and want["r1", "last", "timeout"] == 0
    follow = lambda stream: runs.open_lifecycles(stream, "at", 900)
    assert played(spark, tmp_path / "one", rows, USE, [], follow) == want
    assert played(spark, tmp_path / "some", rows, USE, [2, 5, 6, 150, 151, 290], follow) == want
    with pytest.raises(ValueError, match="delay"):
        runs.open_lifecycles(spark.createDataFrame([], USE), "at", 1, 2)


def test_lifecycles_with_late_events(spark, tmp_path):
    """Out of order by less than the delay."""
    rng = random.Random(6)
    rows = [("r", f"u{rng.randrange(15)}", rng.choice(["tool_use", "tool_post"]), 10_000 + 50 * k) for k in range(160)]
    rows = sorted(rows, key=lambda r: r[3] + rng.randrange(400))
    follow = lambda stream: runs.open_lifecycles(stream, "at", 600, 400)
    assert played(spark, tmp_path, rows, USE, [40, 80, 120], follow) == plain_lifecycles(rows, 600, 400)


def test_quota_of_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"r{rng.randrange(3)}", k, f"e{k}", "k", rng.choice(["P0", "P1", "P2", "P2"]), rng.randrange(1, 9), 1000 + k) for k in range(240)]
    events = spark.createDataFrame([r[:-1] for r in rows], EVENT.removesuffix(", at timestamp"))
    stays = {(r.run_id, r.source_sequence) for r in T.evict_by_priority(events, 6, 30).collect() if r.kept}
    evict = lambda stream: runs.evict_by_priority(stream, "at", 6, 30)
    odd = [("r0", 900, None, None, "P9", 1, 1500), (None, 901, "x", "k", "P0", 1, 1500), ("r0", 902, "x", "k", "P0", None, 1500)]
    got = [played(spark, tmp_path / name, rows + odd, EVENT, cuts, evict) for name, cuts in (("one", []), ("some", [1, 70, 71, 200]))]
    assert got[0] == got[1] and sum(d != "evicted" for _, _, _, d in got[0]) == len(rows)
    state = {(r, s) for r, s, _, d in got[0] if d == "kept"} - {(r, s) for r, s, _, d in got[0] if d == "evicted"}
    assert state == stays and {d for *_, d in got[0]} == {"kept", "refused", "evicted"}


def test_a_silent_run_begins_again(spark, tmp_path):
    rows = [("r", k, f"e{k}", "k", "P0", 1, 1000 + k) for k in range(4)] + [("r", 10 + k, f"f{k}", "k", "P0", 1, 90_000 + k) for k in range(4)]
    for name, cuts in (("one", []), ("some", [4, 6])):
        got = played(spark, tmp_path / name, rows, EVENT, cuts, lambda stream: runs.evict_by_priority(stream, "at", 3, 30, 5000))
        assert Counter(d for *_, d in got) == {"kept": 6, "refused": 2}
