"""Queries of scoring over assertions made of order lines, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..sources import fixtures as X

QUERIES, ORACLES = {}, {}
DIMENSIONS = [*S.WEIGHTS]
CODES = ["extra_slot", "required_slot_missing", "style_differs", None]


#: Order lines with an id of their own and a mode.
LINES = "(SELECT *, 'm' || l_partkey % 7 AS l_shipmode, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS l_id FROM lineitem) AS li"


def both(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql.replace("FROM lineitem", f"FROM {LINES}")


def order_lines(spark, sf):
    return X.table(spark, sf, "lineitem").withColumn("l_shipmode", F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))).withColumn("l_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")))


def assertions(spark, sf):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    return order_lines(spark, sf).select(
        F.col("l_orderkey").alias("pair_id"),
        F.concat(F.lit("a"), "l_id").alias("assertion_id"),
        pick(DIMENSIONS, F.col("l_partkey") % 8).alias("dimension"),
        F.when(F.col("l_quantity") > 45, "NOT_APPLICABLE").when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("UNKNOWN").alias("status"),
        (F.col("l_suppkey") % 3 == 0).alias("required"),
        pick(CODES, F.col("l_suppkey") % 4).alias("failure_code"),
    )


def listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


A = (
    f"a AS (SELECT l_orderkey AS pair_id, 'a' || l_id AS assertion_id, {listed(DIMENSIONS)}[l_partkey % 8 + 1] AS dimension, CASE WHEN l_quantity > 45 THEN 'NOT_APPLICABLE' WHEN l_returnflag = 'N' THEN 'PASS' WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'UNKNOWN' END AS status, l_suppkey % 3 = 0 AS required, {listed(CODES)}[l_suppkey % 4 + 1] AS failure_code FROM lineitem), "
    "w(dimension, weight) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in S.WEIGHTS.items()) + "), "
    "c AS (SELECT p.pair_id, w.dimension, w.weight, count(*) FILTER (a.status = 'PASS') AS passed, count(*) FILTER (a.status = 'FAIL') AS failed, count(*) FILTER (a.status = 'UNKNOWN') AS unknown, count(*) FILTER (a.status = 'NOT_APPLICABLE') AS not_applicable FROM (SELECT DISTINCT pair_id FROM a) p CROSS JOIN w LEFT JOIN a ON a.pair_id = p.pair_id AND a.dimension = w.dimension GROUP BY ALL), "
    "d AS (SELECT *, round(weight * CASE WHEN passed + failed + unknown = 0 THEN CASE WHEN not_applicable > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN dimension = 'slot.inventory' THEN 2 * passed / (2 * passed + failed + 2 * unknown) ELSE passed / (passed + failed + unknown) END, 4) AS score FROM c), "
    f"v AS (SELECT pair_id, bool_or(status = 'FAIL' AND (required OR coalesce(list_contains({listed(S.HARD_FAILURES)}, failure_code), false))) AS bad, count(DISTINCT dimension) < 8 OR bool_or(status = 'UNKNOWN') AS provisional FROM a GROUP BY pair_id)"
)
VERDICT = "CASE WHEN bad THEN 'FAIL' WHEN provisional THEN 'UNKNOWN' ELSE 'PASS' END"
both("ag06_dimension_scores", lambda s, d: S.dimension_scores(assertions(s, d)), f"WITH {A} SELECT * FROM d")
both("ag07_verdicts", lambda s, d: S.verdicts(assertions(s, d)), f"WITH {A} SELECT pair_id, {VERDICT} AS verdict, provisional FROM v")
both("ag08_coverage", lambda s, d: S.coverage_scores(assertions(s, d)), f"WITH {A} SELECT pair_id, round(sum(CASE WHEN passed + failed + unknown + not_applicable > 0 THEN weight * (passed + failed + not_applicable) / (passed + failed + unknown + not_applicable) ELSE 0 END) / 100, 6) AS coverage FROM c GROUP BY pair_id")
both(
    "ag09_view_scores",
    lambda s, d: S.view_scores(S.dimension_scores(assertions(s, d))),
    f"WITH {A} SELECT pair_id, view, round(sum(score), 4) AS score, sum(weight) AS weight, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(unknown) AS BIGINT) AS unknown, CAST(sum(not_applicable) AS BIGINT) AS not_applicable FROM (SELECT *, split_part(dimension, '.', 1) AS view FROM d) GROUP BY GROUPING SETS ((pair_id, view), (pair_id))",
)
both("wn06_issues", lambda s, d: S.issues(assertions(s, d)), f"WITH {A} SELECT pair_id, printf('ISS-%04d', row_number() OVER (PARTITION BY pair_id ORDER BY split_part(dimension, '.', 1), dimension, assertion_id)) AS issue_id, assertion_id, CASE status WHEN 'FAIL' THEN 'error' ELSE 'warning' END AS severity FROM a WHERE status IN ('FAIL', 'UNKNOWN')")


def union(spark, sf):
    a = assertions(spark, sf)
    return S.all_assertions(a.where(S.view() == "protected"), a.where(S.view() == "slot"), a.where("pair_id % 9 = 0 and status = 'FAIL'")).select("pair_id", "assertion_id", "status", "single")


both("st02_all_assertions", union, f"WITH {A}, u AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE pair_id % 9 = 0 AND status = 'FAIL') SELECT pair_id, assertion_id, status, count(*) OVER (PARTITION BY pair_id, assertion_id) = 1 AS single FROM u")


def reports(spark, sf):
    a = assertions(spark, sf)
    out = S.eval_reports(S.dimension_scores(a), S.verdicts(a).drop("provisional"))
    return out.select("pair_id", F.get_json_object("report", "$.verdict").alias("verdict"), F.get_json_object("report", "$.total").cast("double").alias("total"), F.get_json_object("report", "$.dimensions[0].dimension").alias("first_dimension"), F.get_json_object("report", "$.dimensions[7].passed").cast("long").alias("last_passed"))


both("snk01_eval_reports", reports, f"WITH {A} SELECT d.pair_id, {VERDICT} AS verdict, round(sum(score), 4) AS total, min(dimension) AS first_dimension, arg_max(passed, dimension) AS last_passed FROM d JOIN v USING (pair_id) GROUP BY d.pair_id, bad, provisional")
both(
    "snk02_markdown",
    lambda s, d: S.render_markdown(S.issues(assertions(s, d)), "pair_id", F.concat(F.lit("Pair "), F.col("pair_id").cast("string")), [F.col("issue_id"), F.concat(F.col("assertion_id"), F.lit("|x\ny")), F.col("severity")], "issue_id"),
    f"WITH {A}, i AS (SELECT pair_id, printf('ISS-%04d', row_number() OVER (PARTITION BY pair_id ORDER BY split_part(dimension, '.', 1), dimension, assertion_id)) AS issue_id, assertion_id, CASE status WHEN 'FAIL' THEN 'error' ELSE 'warning' END AS severity FROM a WHERE status IN ('FAIL', 'UNKNOWN')) SELECT pair_id, '# Pair ' || pair_id || chr(10) || chr(10) || string_agg('| ' || issue_id || ' | ' || assertion_id || '\\|x<br>y | ' || severity || ' |', chr(10) ORDER BY issue_id) AS markdown FROM i GROUP BY pair_id",
)
both("ag22_weighted_mean", lambda s, d: S.weighted_mean(order_lines(s, d).select("l_suppkey", F.col("l_discount").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("w")), "l_suppkey", "x", "w"), "SELECT l_suppkey, sum(l_discount::DOUBLE * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE) AS mean, sum(l_quantity::DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey")
both(
    "ag29_alignment_summary",
    lambda s, d: S.alignment_summary(order_lines(s, d).select(F.col("l_orderkey").alias("pair_id"), F.col("l_shipmode").alias("method"), (F.col("l_returnflag") == "N").alias("matched"))).select("pair_id", F.to_json("methods").alias("methods"), "matched", "missing"),
    "WITH m AS (SELECT l_orderkey AS pair_id, l_shipmode AS method, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS hit FROM lineitem GROUP BY ALL) SELECT pair_id, '{' || string_agg('\"' || method || '\":' || n, ',' ORDER BY method) || '}' AS methods, CAST(sum(hit) AS BIGINT) AS matched, CAST(sum(n - hit) AS BIGINT) AS missing FROM m GROUP BY pair_id",
)
both(
    "ag26_majority_mapping",
    lambda s, d: S.majority_mapping(order_lines(s, d).select(F.col("l_suppkey").alias("pair_id"), F.col("l_returnflag").alias("gold_table"), F.col("l_shipmode").alias("actual_table"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))),
    "WITH n AS (SELECT l_suppkey AS pair_id, l_returnflag AS gold_table, l_shipmode AS actual_table, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT pair_id, gold_table, actual_table, n FROM n QUALIFY row_number() OVER (PARTITION BY pair_id, gold_table ORDER BY n DESC, first) = 1",
)


def atoms(spark, sf):
    rows = order_lines(spark, sf).select(F.col("l_orderkey").alias("pair_id"), F.col("l_id").alias("atom_id"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_partkey") % 11 > 0).alias("analyzable"), "l_suppkey")
    changed = F.col("value") + F.when(F.col("l_suppkey") % 5 == 0, 1.0).when(F.col("l_suppkey") % 5 == 1, 0.005).otherwise(0.0)
    gold = rows.where("l_suppkey % 7 > 0").drop("l_suppkey")
    return gold, rows.where("l_suppkey % 4 > 0").withColumn("value", changed).drop("l_suppkey")


both(
    "jn18_compare_atoms",
    lambda s, d: S.compare_atoms(*atoms(s, d), 0.01),
    "WITH r AS (SELECT l_orderkey AS pair_id, l_id AS atom_id, CASE WHEN l_suppkey % 7 = 0 THEN 'extra' WHEN l_suppkey % 4 = 0 THEN 'missing' WHEN l_partkey % 11 = 0 THEN 'not_analyzable' WHEN l_suppkey % 5 = 0 THEN 'changed' ELSE 'equal' END AS reason FROM lineitem WHERE NOT (l_suppkey % 7 = 0 AND l_suppkey % 4 = 0)) SELECT *, CASE reason WHEN 'equal' THEN 'PASS' WHEN 'not_analyzable' THEN 'UNKNOWN' ELSE 'FAIL' END AS status FROM r",
)


def semantic(spark, sf):
    rows = order_lines(spark, sf).select(F.col("l_suppkey").alias("scope"), F.col("l_returnflag").alias("dimension"), F.col("l_quantity").cast("long").alias("value"), F.col("l_id").alias("atom_id"), "l_partkey")
    return rows.where("l_partkey % 2 = 0").drop("l_partkey"), rows.where("l_partkey % 3 > 0").drop("l_partkey")


both(
    "jn19_match_atoms",
    lambda s, d: S.match_atoms(*semantic(s, d)),
    "WITH r AS (SELECT l_suppkey AS scope, l_returnflag AS dimension, CAST(l_quantity AS BIGINT) AS value, l_id AS atom_id, l_partkey FROM lineitem), g AS (SELECT *, row_number() OVER (PARTITION BY scope, dimension, value ORDER BY atom_id) AS n FROM r WHERE l_partkey % 2 = 0), a AS (SELECT *, row_number() OVER (PARTITION BY scope, dimension, value ORDER BY atom_id) AS n FROM r WHERE l_partkey % 3 > 0) SELECT g.scope, g.dimension, g.atom_id, a.atom_id AS actual_id FROM g LEFT JOIN a USING (scope, dimension, value, n)",
)


def styles(spark, sf):
    rows = order_lines(spark, sf).select(F.col("l_id").alias("owner"), F.explode(F.array(F.lit("size"), F.lit("space"))).alias("path"), F.col("l_quantity").cast("double").alias("expected"), "l_suppkey", "l_partkey")
    actual = rows.where("l_partkey % 6 > 0").select("owner", "path", (F.col("expected") + F.when(F.col("l_suppkey") % 3 == 0, 0.02).otherwise(0.0)).alias("actual"))
    return rows.select("owner", "path", "expected"), actual


both(
    "fn13_style_diff",
    lambda s, d: S.style_diff(*styles(s, d), {"size": 0.01, "space": 0.05}),
    "WITH r AS (SELECT l_id AS owner, unnest(['size', 'space']) AS path, l_quantity::DOUBLE AS expected, l_suppkey, l_partkey FROM lineitem) SELECT owner, path, expected, CASE WHEN l_partkey % 6 > 0 THEN expected + CASE WHEN l_suppkey % 3 = 0 THEN 0.02::DOUBLE ELSE 0 END END AS actual FROM r WHERE l_partkey % 6 = 0 OR (l_suppkey % 3 = 0 AND path = 'size')",
)


def spans(spark, sf):
    start = F.col("l_partkey") % 60
    return order_lines(spark, sf).select(F.col("l_orderkey").alias("paragraph"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 12).alias("stop"))


MERGED = """s AS (SELECT l_orderkey AS paragraph, l_partkey % 60 AS start, l_partkey % 60 + CAST(l_quantity AS BIGINT) % 12 AS stop FROM lineitem),
n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY paragraph ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY paragraph ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM n), m AS (SELECT paragraph, min(start) AS start, max(stop) AS stop FROM i GROUP BY paragraph, island)"""


def mask(spark, sf):
    from ..functions.text import masked

    grouped = S.merge_spans(spans(spark, sf)).groupBy("paragraph").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    text = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paragraph"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("text"))
    return text.join(grouped, "paragraph").select("paragraph", masked(F.col("text"), F.transform("spans", lambda x: F.struct(x["start"].cast("int").alias("start"), x["stop"].cast("int").alias("stop")))).alias("masked"))


both("fn14_merge_spans", lambda s, d: S.merge_spans(spans(s, d)), f"WITH {MERGED} SELECT * FROM m")
both(
    "fn14_masked",
    mask,
    f"""WITH {MERGED}, t AS (SELECT o_orderkey AS paragraph, sha256(CAST(o_orderkey AS VARCHAR)) AS text FROM orders), k AS (SELECT *, least(start, 64) AS a, least(stop, 64) AS b FROM m),
    p AS (SELECT paragraph, a, b, coalesce(lag(b) OVER (PARTITION BY paragraph ORDER BY start, stop), 0) AS prev FROM k)
    SELECT paragraph, string_agg(substr(text, prev + 1, a - prev) || '<SLOT>', '' ORDER BY a, b) || substr(any_value(text), max(b) + 1) AS masked FROM p JOIN t USING (paragraph) GROUP BY paragraph""",
)


def props(spark, sf):
    state = F.element_at(F.array(*[F.lit(x) for x in ("value", "missing", "conflict", "unresolved", "value")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return order_lines(spark, sf).select(F.col("l_orderkey").alias("role"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("path"), F.when(F.col("l_quantity") > 25, state).otherwise("value").alias("state"))


both(
    "ag12_closure",
    lambda s, d: S.closure(props(s, d)),
    "WITH p AS (SELECT l_orderkey AS role, 'p' || l_linenumber AS path, CASE WHEN l_quantity > 25 THEN ['value', 'missing', 'conflict', 'unresolved', 'value'][l_partkey % 5 + 1] ELSE 'value' END AS state FROM lineitem), r AS (SELECT role, coalesce(list(path ORDER BY path) FILTER (state = 'conflict'), []) AS failed, coalesce(list(path ORDER BY path) FILTER (state = 'unresolved'), []) AS unresolved, coalesce(list(path ORDER BY path) FILTER (state = 'missing'), []) AS gaps FROM p GROUP BY role) SELECT *, CASE WHEN len(failed) + len(unresolved) > 0 THEN 'FAILED' ELSE 'COMPLETE' END AS closure, CASE WHEN len(failed) + len(unresolved) > 0 THEN 'NOT_EVALUABLE' WHEN len(gaps) > 0 THEN 'INCOMPLETE_KNOWN_GAPS' ELSE 'COMPLETE' END AS eligibility FROM r",
)
both(
    "ag13_role_candidates",
    lambda s, d: S.role_candidates(order_lines(s, d).select(F.col("l_orderkey").alias("role"), F.md5(F.when(F.col("l_orderkey") % 3 == 0, F.col("l_shipmode")).otherwise(F.lit("same"))).alias("digest"), F.col("l_returnflag").alias("field_id"))),
    "SELECT l_orderkey AS role, CASE WHEN count(DISTINCT dg) = 1 THEN 'candidate' ELSE 'conflict' END AS kind, CASE WHEN count(DISTINCT dg) = 1 THEN min(dg) END AS digest, list_sort(list(DISTINCT l_returnflag)) AS fields FROM (SELECT *, md5(CASE WHEN l_orderkey % 3 = 0 THEN l_shipmode ELSE 'same' END) AS dg FROM lineitem) GROUP BY l_orderkey",
)
both(
    "ag10_ownership",
    lambda s, d: S.ownership(order_lines(s, d).select(F.element_at(F.array(F.lit("protected"), F.lit("slot"), F.lit("remove")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("owner"), F.col("l_shipmode").alias("dimension"), (F.col("l_suppkey") % 4 > 0).alias("analyzable"))).select("owner", "dimension", "n", "analyzable", F.col("level").cast("long").alias("level")),
    "WITH f AS (SELECT ['protected', 'slot', 'remove'][l_partkey % 3 + 1] AS owner, l_shipmode AS dimension, l_suppkey % 4 > 0 AS ok FROM lineitem) SELECT owner, dimension, count(*) AS n, count(*) FILTER (ok) AS analyzable, CAST(grouping(owner, dimension) AS BIGINT) AS level FROM f GROUP BY CUBE (owner, dimension)",
)


def drift(spark, sf):
    rows = order_lines(spark, sf).select(F.col("l_id").alias("occurrence_id"), (F.col("l_partkey") % 10).alias("style_id"), "l_suppkey")
    contracts = spark.range(10).select(F.col("id").alias("style_id"), F.explode(F.array(F.lit("size"), F.lit("space"))).alias("path"), (F.col("id") * 1.5).alias("expected"))
    effective = rows.where("l_suppkey % 6 > 0").select("occurrence_id", F.explode(F.array(F.lit("size"), F.lit("space"))).alias("path"), (F.col("style_id") * 1.5 + F.when(F.col("l_suppkey") % 4 == 0, 0.1).otherwise(0.0)).alias("actual"))
    return S.style_drift(rows.select("occurrence_id", "style_id"), contracts, effective)


both("jn23_style_drift", drift, "SELECT l_id AS occurrence_id, CASE WHEN l_suppkey % 6 = 0 THEN 'unresolved' WHEN l_suppkey % 4 = 0 THEN 'failed' ELSE 'passed' END AS status, CAST(CASE WHEN l_suppkey % 6 > 0 AND l_suppkey % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS differences FROM lineitem")
