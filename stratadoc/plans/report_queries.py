"""Queries of contracts, run reports and evidence over orders and events, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import fixtures as X
from .telemetry_queries import EVENTS, events

QUERIES, ORACLES = {}, {}


def both(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def contracts(s, d):
    li = X.table(s, d, "lineitem")
    slot = F.struct(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("slot_id"), F.col("l_returnflag").alias("field_id"), F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("st"), (F.col("l_partkey") % 4).cast("string"))).alias("style_ref"), (F.col("l_suppkey") % 2 == 0).alias("required"))
    styles = F.array(*[F.struct(F.lit(f"st{i}").alias("style_id"), F.lit(float(i)).alias("size")) for i in range(3)])
    return li.groupBy("l_orderkey").agg(F.collect_list(slot).alias("slots")).select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("contract_id"), "slots", styles.alias("styles"))).alias("contract"))


both("src04_contract_slots", lambda s, d: R.flatten_contracts(contracts(s, d), "contract")[0], "SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, 's' || l_linenumber AS slot_id, l_returnflag AS field_id, CASE WHEN l_partkey % 5 > 0 THEN 'st' || l_partkey % 4 END AS style_ref, l_suppkey % 2 = 0 AS required FROM lineitem")
both("src04_contract_violations", lambda s, d: R.flatten_contracts(contracts(s, d), "contract")[2], "SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, 's' || l_linenumber AS slot_id, CASE WHEN l_partkey % 5 = 0 THEN 'style_missing' ELSE 'style_unresolved' END AS code FROM lineitem WHERE l_partkey % 5 = 0 OR l_partkey % 4 = 3")


def run_reports(s, d):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.when(k % 11 > 0, k % 3 + 1).otherwise(F.lit(None)).alias("version"), F.when(k % 7 > 0, F.concat(F.lit("run_"), F.md5(k.cast("string")))).otherwise("bad").alias("run_id"), F.when(k % 2 == 0, "completed").otherwise("failed").alias("status"), F.when(k % 5 > 1, F.sha2(k.cast("string"), 256)).when(k % 5 == 1, "zz").alias("final_sha256")))
    return X.table(s, d, "orders").select("o_orderkey", F.when(k % 13 == 0, "{broken").otherwise(body).alias("payload"))


both(
    "src07_run_reports",
    lambda s, d: R.check_run_reports(run_reports(s, d), "payload").select("o_orderkey", "code"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'report_unreadable' WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 2 THEN 'report_version_unknown' WHEN o_orderkey % 7 = 0 THEN 'report_run_invalid' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'report_hash_missing' WHEN o_orderkey % 5 = 1 THEN 'report_hash_invalid' END AS code FROM orders",
)


def references(s, d):
    e = events(s, d)
    n = F.col("source_sequence")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("document", "render", "object", "page")]), (n % 4 + 1).cast("int"))
    value = F.when(n % 4 == 0, F.concat(F.lit("d"), (n % 12).cast("string"))).when(n % 4 == 1, F.concat(F.lit("r"), (n % 12).cast("string"))).otherwise(F.concat(F.lit("v"), (n % 40).cast("string")))
    scope = F.when(n % 4 == 2, F.when(n % 10 > 0, F.concat(F.lit("d"), (n % 16 - n % 4).cast("string")))).when(n % 4 == 3, F.concat(F.lit("r"), (n % 8).cast("string")))
    return e.select("run_id", kind.alias("kind"), value.alias("value"), scope.alias("scope"))


both(
    "jn28_associate_evidence",
    lambda s, d: R.associate_evidence(references(s, d)),
    f"WITH {EVENTS}, n AS (SELECT run_id, source_sequence AS n FROM ev), rf AS (SELECT run_id, ['document', 'render', 'object', 'page'][n % 4 + 1] AS kind, CASE n % 4 WHEN 0 THEN 'd' || n % 12 WHEN 1 THEN 'r' || n % 12 ELSE 'v' || n % 40 END AS value, CASE n % 4 WHEN 2 THEN CASE WHEN n % 10 > 0 THEN 'd' || (n % 16 - n % 4) END WHEN 3 THEN 'r' || n % 8 END AS scope FROM n),"
    " k AS (SELECT DISTINCT run_id, kind AS k, value AS scope FROM rf WHERE kind IN ('document', 'render')) SELECT rf.run_id, rf.kind, rf.value, CASE WHEN count(DISTINCT rf.scope) > 1 THEN 'conflict' WHEN count(rf.scope) = 0 THEN 'partial' WHEN bool_and(k.k IS NOT NULL) THEN 'verified' ELSE 'broken' END AS status FROM rf LEFT JOIN k ON k.run_id = rf.run_id AND k.scope = rf.scope AND k.k = CASE rf.kind WHEN 'object' THEN 'document' ELSE 'render' END WHERE rf.kind IN ('object', 'page') GROUP BY rf.run_id, rf.kind, rf.value",
)


def verified(s, d):
    o = X.table(s, d, "lineitem")
    seen = o.where("l_orderkey % 5 > 0").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_returnflag")).otherwise("x").alias("sha256"))
    said = X.table(s, d, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 7 == 0, "y").otherwise("x").alias("sha256"))
    return R.verify_run(seen, said)


both(
    "jn30_verify_run",
    verified,
    "WITH s AS (SELECT l_orderkey AS run_id, list(DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag ELSE 'x' END) AS seen FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY ALL), r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'y' ELSE 'x' END AS said FROM orders WHERE o_orderkey % 4 > 0), c AS (SELECT run_id, CASE WHEN said IS NULL THEN 'report_missing' WHEN seen IS NULL THEN 'hash_not_observed' WHEN len(seen) > 1 THEN 'hashes_differ' WHEN NOT list_contains(seen, said) THEN 'report_differs' END AS code FROM s FULL JOIN r USING (run_id)) SELECT run_id, CASE WHEN code IS NULL THEN 'verified' WHEN code IN ('hashes_differ', 'report_differs') THEN 'conflict' ELSE 'partial' END AS status, code FROM c",
)


def agents(s, d):
    n = F.col("source_sequence")
    e = events(s, d).withColumn("agent_id", F.when(n % 3 > 0, F.concat(F.lit("ag"), (n % 8).cast("string")))).withColumn("parent_tool_use_id", F.when(n % 8 < 6, F.concat(F.lit("tu-"), (n % 8 + F.when((n % 8 == 5) & (n % 7 == 0), 1).otherwise(0)).cast("string")))).withColumn("kind", F.when(n % 4 == 0, "subagent_start").when(n % 4 == 1, "subagent_stop").otherwise(F.col("kind")))
    return R.subagents(e, e.where("tool_use_id in ('tu-0', 'tu-1', 'tu-2', 'tu-4')").select("run_id", "tool_use_id").distinct())


both(
    "wn09_subagents",
    agents,
    f"WITH {EVENTS}, a AS (SELECT *, source_sequence AS n, CASE WHEN source_sequence % 3 > 0 THEN 'ag' || source_sequence % 8 END AS agent, CASE WHEN source_sequence % 8 < 6 THEN 'tu-' || (source_sequence % 8 + CASE WHEN source_sequence % 8 = 5 AND source_sequence % 7 = 0 THEN 1 ELSE 0 END) END AS parent, CASE source_sequence % 4 WHEN 0 THEN 'subagent_start' WHEN 1 THEN 'subagent_stop' ELSE kind END AS k2 FROM ev), t AS (SELECT DISTINCT run_id, tool_use_id FROM ev WHERE tool_use_id IN ('tu-0', 'tu-1', 'tu-2', 'tu-4')),"
    " g AS (SELECT run_id, agent AS agent_id, count(*) FILTER (k2 = 'subagent_start') AS st, count(*) FILTER (k2 = 'subagent_stop') AS sp, list(DISTINCT parent) FILTER (parent IS NOT NULL) AS ps, max(offset_ms) - min(offset_ms) AS elapsed_ms FROM a WHERE agent IS NOT NULL GROUP BY ALL)"
    " SELECT g.run_id, agent_id, CASE WHEN st > 0 AND sp > 0 THEN 'completed' WHEN st > 0 THEN 'started' ELSE 'unknown' END AS status, elapsed_ms, CASE WHEN len(ps) > 1 THEN 'parent_conflict' WHEN coalesce(len(ps), 0) = 0 THEN 'parent_missing' WHEN t.tool_use_id IS NULL THEN 'parent_unknown' END AS reason FROM g LEFT JOIN t ON t.run_id = g.run_id AND len(ps) = 1 AND t.tool_use_id = ps[1]",
)


def edged(s, d):
    n = F.col("source_sequence")
    e = events(s, d).withColumn("agent_id", F.when(n % 3 > 0, F.concat(F.lit("ag"), (n % 8).cast("string")))).withColumn("parent_tool_use_id", F.when(n % 8 < 6, F.concat(F.lit("tu-"), (n % 40).cast("string"))))
    return R.actor_edges(e, e.select("run_id", "tool_use_id").distinct(), e.where("kind = 'tool_use' and agent_id is not null").select("run_id", "agent_id").distinct())


both(
    "jn27_actor_edges",
    edged,
    f"WITH {EVENTS}, a AS (SELECT *, CASE WHEN source_sequence % 3 > 0 THEN 'ag' || source_sequence % 8 END AS agent, CASE WHEN source_sequence % 8 < 6 THEN 'tu-' || source_sequence % 40 END AS parent FROM ev), g AS (SELECT DISTINCT run_id, source_event_id, 'parent' AS edge, parent AS target FROM a WHERE parent IS NOT NULL UNION ALL SELECT DISTINCT run_id, source_event_id, 'actor', agent FROM a WHERE agent IS NOT NULL)"
    " SELECT run_id, source_event_id, edge, target, CASE WHEN edge = 'parent' AND EXISTS (SELECT 1 FROM ev WHERE ev.run_id = g.run_id AND ev.tool_use_id = g.target) OR edge = 'actor' AND EXISTS (SELECT 1 FROM a WHERE a.run_id = g.run_id AND a.agent = g.target AND a.kind = 'tool_use') THEN 'verified' ELSE 'broken' END AS status FROM g",
)


def regions(s, d):
    k = F.col("o_orderkey")
    o = X.table(s, d, "orders").select(F.col("o_custkey").alias("pair_id"), F.concat(F.lit("g"), k.cast("string")).alias("region_id"), F.concat(F.lit("w"), (k % 2).cast("string")).alias("owner"), (k % 6).alias("location"), k.alias("k"))
    return o.where("k % 5 > 0").drop("k"), o.where("k % 3 > 0").drop("k")


both(
    "jn14_align_regions",
    lambda s, d: R.align_regions(*regions(s, d)),
    "WITH o AS (SELECT o_custkey AS pair_id, 'g' || o_orderkey AS region_id, 'w' || o_orderkey % 2 AS owner, o_orderkey % 6 AS location, o_orderkey AS k FROM orders), a AS (SELECT * FROM o WHERE k % 3 > 0), x AS (SELECT g.pair_id, g.region_id, (SELECT count(*) FROM a WHERE a.pair_id = g.pair_id AND a.region_id = g.region_id) AS ni, (SELECT count(*) FROM a WHERE a.pair_id = g.pair_id AND a.owner = g.owner AND a.location = g.location) AS na, (SELECT min(region_id) FROM a WHERE a.pair_id = g.pair_id AND a.owner = g.owner AND a.location = g.location) AS ar FROM o g WHERE g.k % 5 > 0)"
    " SELECT pair_id, region_id, CASE WHEN ni = 1 THEN region_id WHEN ni = 0 AND na = 1 THEN ar END AS actual_region, CASE WHEN ni = 1 OR (ni = 0 AND na = 1) THEN 'MATCHED' WHEN ni > 1 OR (ni = 0 AND na > 1) THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status FROM x",
)
