"""Queries of slot and region evaluation over contracts made of orders, and their DuckDB equivalents by the rule of each fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..sources import fixtures as X

QUERIES, ORACLES = {}, {}


def style(size, colour):
    return F.create_map(F.lit("font.size_pt"), size, F.lit("font.color"), colour)


def slot_tables(s, d):
    """A slot and a control for each order; some are renamed, moved, missing, repeated, mapped or styled otherwise."""
    o = X.table(s, d, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("k"))
    k = F.col("k")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    where = [F.lit("body").alias("story"), text("p", k % 2).alias("part")]
    slot = lambda name, field, size: [
        "pair_id", name.alias("slot_id"), (k % 2 == 0).alias("required"), text("t", k).alias("tag"), *where, F.when(k % 4 > 0, k % 10).alias("paragraph"), F.lit(None).cast("int").alias("occurrence"), F.lit(5).alias("start"), F.lit(9).alias("stop"),
        F.when(k % 3 == 0, "Name:").alias("left_anchor"), F.when(k % 5 == 0, "end").alias("right_anchor"), field.alias("field_id"), F.lit("text").alias("content_type"), style(size, F.lit("red")).alias("style"),
    ]
    control = lambda paragraph: ["pair_id", k.alias("control_no"), text("t", k).alias("tag"), text("f", k % 3).alias("alias"), *where, paragraph.alias("paragraph"), F.lit(5).alias("start"), F.lit(9).alias("stop"), (k % 2 == 1).alias("placeholder"), style(F.lit("12"), F.when(k % 4 == 1, "gray").otherwise("red")).alias("style")]
    gold = o.where("k % 7 > 0").select(*slot(text("s", k), text("f", k % 3), F.lit("12")))
    actual = o.where("k % 11 > 0").select(*slot(F.when(k % 13 == 0, text("x", k)).otherwise(text("s", k)), F.when(k % 17 == 0, "f9").otherwise(text("f", k % 3)), F.when(k % 19 == 0, "12.5").otherwise(F.lit("12.005"))))
    theirs = o.where("k % 23 > 0").select(*control(k % 10 + F.when(k % 31 == 0, 1).otherwise(0)))
    pages = o.select("pair_id").distinct().select("pair_id", F.lit("body").alias("story"), F.explode(F.array(F.lit("p0"), F.lit("p1"))).alias("part"), F.explode(F.expr("sequence(0L, 10L)")).alias("paragraph"))
    registry = s.createDataFrame([("f0", "text"), ("f1", "text"), ("f2", "image"), ("f9", "text")], "field_id string, content_type string")
    return gold, actual, o.where("k % 7 > 0").select(*control(k % 10)), theirs.unionByName(theirs.where("control_no % 29 = 0")), pages.withColumn("text", F.lit("Name:abcd end")), pages.withColumn("text", F.when(F.col("paragraph") == 3, "Nam: abcd end").otherwise("Name:abcd end")), registry


QUERIES["jn16_evaluate_slots"] = lambda s, d: C.evaluate_slots(*slot_tables(s, d))
ORACLES["jn16_evaluate_slots"] = """WITH o AS (SELECT o_custkey AS pair_id, o_orderkey AS k, o_orderkey % 2 = 0 AS required FROM orders),
g AS (SELECT *, k % 11 > 0 AS there, CASE WHEN k % 23 = 0 OR (k % 4 > 0 AND k % 31 = 0) THEN 0 WHEN k % 29 = 0 THEN 2 ELSE 1 END AS n FROM o WHERE k % 7 > 0),
st AS (SELECT *, CASE WHEN NOT there OR n = 0 THEN 'MISSING' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status FROM g),
m AS (SELECT *, k % 10 + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END AS p FROM st WHERE status = 'MATCHED'),
checks AS (
SELECT pair_id, 's' || k AS slot_id, 'inventory' AS "check", 'slot.inventory' AS dimension, true AS good, required, NULL AS code FROM m
UNION ALL SELECT pair_id, 's' || k, 'location', 'slot.location_boundary', k % 31 <> 0, required, 'wrong_structural_location' FROM m
UNION ALL SELECT pair_id, 's' || k, 'boundary', 'slot.location_boundary', NOT (p = 3 AND k % 3 = 0), required, 'slot_overlaps_protected' FROM m
UNION ALL SELECT pair_id, 's' || k, 'field_id', 'slot.field_mapping', k % 17 <> 0 AND k % 3 <> 2, required, 'slot_field_mapping_invalid' FROM m
UNION ALL SELECT pair_id, 's' || k, 'value_style', 'slot.value_style', k % 19 <> 0, required, NULL FROM m
UNION ALL SELECT pair_id, 's' || k, 'inventory', 'slot.inventory', false, required, CASE WHEN status = 'MISSING' AND NOT there THEN CASE WHEN required THEN 'required_slot_missing' ELSE 'optional_slot_missing' END ELSE 'template_contract_marker_mismatch' END FROM st WHERE status <> 'MATCHED'
UNION ALL SELECT pair_id, 's' || k, 'prerequisite', d, false, required, CASE WHEN required THEN 'required_slot_prerequisite_missing' ELSE 'optional_slot_prerequisite_missing' END FROM st, (VALUES ('slot.location_boundary'), ('slot.field_mapping'), ('slot.value_style')) v(d) WHERE status <> 'MATCHED'
UNION ALL SELECT pair_id, CASE WHEN k % 13 = 0 THEN 'x' ELSE 's' END || k, 'inventory.extra', 'slot.inventory', false, true, 'extra_slot' FROM o WHERE k % 11 > 0 AND (k % 13 = 0 OR k % 7 = 0)
UNION ALL SELECT pair_id, 't' || k, 'inventory.broken', 'slot.inventory', false, true, 'template_contract_marker_mismatch' FROM o, (VALUES (1), (2)) v(i) WHERE k % 11 = 0 AND k % 23 > 0 AND (i = 1 OR k % 29 = 0))
SELECT pair_id, slot_id, "check", dimension, CASE WHEN good THEN 'PASS' ELSE 'FAIL' END AS status, required, CASE WHEN NOT good THEN code END AS code FROM checks"""


def region_tables(s, d):
    """A region for each order over eleven paragraphs of its customer, and objects; some anchors and texts are gone on the other side."""
    o = X.table(s, d, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("k"))
    k, none = F.col("k"), F.lit(None).cast("int")
    regions = o.select(
        "pair_id", F.concat(F.lit("r"), k.cast("string")).alias("region_id"), (k % 4 > 0).alias("required"), F.lit("body").alias("story"), F.lit("p").alias("part"), none.alias("section"), F.when(k % 2 == 0, k % 12).alias("paragraph"), none.alias("table_index"), none.alias("row"), F.when(k % 13 == 0, 1).alias("cell"),
        F.when(k % 3 == 0, F.concat(F.lit("w"), (k % 5).cast("string"))).alias("left_anchor"), F.when(k % 11 == 0, "tail").alias("right_anchor"), F.when(k % 5 == 0, 2).alias("occurrence"), F.when(k % 17 == 0, 2).otherwise(1).alias("expected"), F.when(k % 9 > 0, F.lit("body")).alias("text"),
        F.when(k % 7 == 0, F.when(k % 14 == 0, "unsupported").otherwise(F.when(k % 3 == 0, "none").otherwise("image"))).alias("object_kind"), F.when(k % 6 == 1, F.concat(F.lit("h"), (F.col("pair_id") % 5).cast("string"))).alias("object_sha256"),
    )
    i = F.col("paragraph")
    run = lambda start, stop, size: F.struct(F.lit(start).alias("start"), F.lit(stop).alias("stop"), style(size, F.lit("red")).alias("style"))
    facts = o.select("pair_id").distinct().select("pair_id", F.lit("body").alias("story"), F.lit("p").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("paragraph")).select("*", F.floor(i / 4).cast("int").alias("section"), none.alias("table_index"), none.alias("row"), F.when(i % 2 == 0, 1).alias("cell"))
    gold = facts.withColumn("text", F.concat(F.lit("w"), (i % 5).cast("string"), F.lit(" body tail"))).withColumn("runs", F.array(run(0, 3, F.lit("10")), run(3, 12, F.lit("12"))))
    actual = facts.withColumn("text", F.when(i == 4, "gone").otherwise(F.concat(F.lit("w"), (i % 5).cast("string"), F.when(i == 6, " soul tail").otherwise(F.lit(" body tail"))))).withColumn("runs", F.array(run(0, 3, F.lit("10")), run(3, 12, F.when(i == 8, "13").otherwise(F.lit("12.004")))))
    pair = F.col("pair_id")
    thing = lambda sha: o.select("pair_id").distinct().select("pair_id", F.lit(1).alias("object_no"), F.lit("image").alias("kind"), F.lit(False).alias("unsupported"), F.concat(F.lit("h"), sha.cast("string")).alias("content_sha256"), F.lit("media/a.png").alias("target"), F.lit("ok").alias("status"), F.lit("<x/>").alias("xml"))
    return regions, gold, actual, thing(pair % 5), thing(F.when(pair % 8 == 0, 9).otherwise(pair % 5)).where("pair_id % 10 > 0")


QUERIES["jn38_evaluate_regions"] = lambda s, d: C.evaluate_regions(*region_tables(s, d))
ORACLES["jn38_evaluate_regions"] = """WITH r AS (SELECT o_custkey AS pair_id, o_orderkey AS k, o_orderkey % 4 > 0 AS required, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 12 END AS par, CASE WHEN o_orderkey % 13 = 0 THEN 1 END AS cell, CASE WHEN o_orderkey % 3 = 0 THEN 'w' || o_orderkey % 5 END AS la, CASE WHEN o_orderkey % 11 = 0 THEN 'tail' END AS ra, CASE WHEN o_orderkey % 5 = 0 THEN 2 END AS occ, CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS expected, CASE WHEN o_orderkey % 9 > 0 THEN 'body' END AS text FROM orders),
p AS (SELECT i, CASE WHEN i % 2 = 0 THEN 1 END AS cell, unnest(['g', 'a']) AS side FROM (SELECT unnest(range(11)) AS i)),
pt AS (SELECT *, CASE WHEN side = 'a' AND i = 4 THEN 'gone' WHEN side = 'a' AND i = 6 THEN 'w' || i % 5 || ' soul tail' ELSE 'w' || i % 5 || ' body tail' END AS t FROM p),
c AS (SELECT r.k, r.pair_id, side, i, t, (la IS NULL OR contains(t, la)) AND (ra IS NULL OR contains(t, ra)) AS anchored FROM r JOIN pt ON (r.par IS NULL OR r.par = i) AND (r.cell IS NULL OR r.cell = pt.cell) WHERE k % 7 <> 0),
c2 AS (SELECT *, sum(anchored::INT) OVER (PARTITION BY k, side ORDER BY i) AS place FROM c),
n AS (SELECT r.k, s.side, count(*) FILTER (anchored AND (occ IS NULL OR occ = place)) AS n, min(i) FILTER (anchored AND (occ IS NULL OR occ = place)) AS one, count(i) AS m, min(i) AS sole FROM r CROSS JOIN (VALUES ('g'), ('a')) s(side) LEFT JOIN c2 ON c2.k = r.k AND c2.side = s.side WHERE r.k % 7 <> 0 GROUP BY ALL),
l AS (SELECT n.*, CASE WHEN n = 1 AND expected = 1 THEN 'PASS' WHEN n > 0 THEN 'UNKNOWN' WHEN (par IS NULL AND r.cell IS NULL) OR m = 0 THEN CASE WHEN required THEN 'FAIL' ELSE 'NOT_APPLICABLE' END WHEN m <> expected OR m <> 1 THEN 'UNKNOWN' ELSE 'PASS' END AS located, CASE WHEN n = 1 THEN one ELSE sole END AS spot FROM n JOIN r ON r.k = n.k),
b AS (SELECT r.*, CASE WHEN g.located <> 'PASS' THEN g.located ELSE a.located END AS base, g.spot AS ga, a.spot AS aa FROM r JOIN l g ON g.k = r.k AND g.side = 'g' JOIN l a ON a.k = r.k AND a.side = 'a'),
v AS (SELECT pair_id, k, required, d, base, ga, aa, text, par, cell, CASE WHEN base <> 'PASS' THEN CASE WHEN d = 'object' THEN 'NOT_APPLICABLE' ELSE base END
 WHEN d = 'content' THEN CASE WHEN text IS NULL THEN 'NOT_APPLICABLE' WHEN aa IN (4, 6) THEN 'FAIL' ELSE 'PASS' END
 WHEN d = 'structure' THEN CASE WHEN par IS NOT NULL AND ga <> aa THEN 'FAIL' WHEN cell IS NOT NULL AND ga % 2 <> aa % 2 THEN 'FAIL' ELSE 'PASS' END
 WHEN d = 'style' THEN CASE WHEN (CASE WHEN text IS NULL THEN 10 ELSE 12 END) <> (CASE WHEN text IS NULL OR aa IN (4, 6) THEN 10 WHEN aa = 8 THEN 13 ELSE 12 END) THEN 'FAIL' ELSE 'PASS' END
 ELSE 'NOT_APPLICABLE' END AS status FROM b, (VALUES ('content'), ('structure'), ('style'), ('object')) x(d)),
things AS (SELECT o_custkey AS pair_id, o_orderkey AS k, o_orderkey % 4 > 0 AS required, d, CASE WHEN d <> 'object' THEN 'NOT_APPLICABLE' WHEN o_orderkey % 14 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 3 = 0 OR o_custkey % 10 = 0 OR o_custkey % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM orders, (VALUES ('content'), ('structure'), ('style'), ('object')) x(d) WHERE o_orderkey % 7 = 0)
SELECT pair_id, 'r' || k AS region_id, 'protected.' || d AS dimension, status, CASE WHEN d = 'object' AND base = 'PASS' THEN false ELSE required END AS required, CASE WHEN status = 'FAIL' THEN CASE WHEN base <> 'PASS' OR d = 'content' THEN 'required_protected_content_missing_or_changed' WHEN d = 'structure' THEN 'wrong_structural_location' END END AS code FROM v
UNION ALL SELECT pair_id, 'r' || k, 'protected.' || d, status, d = 'object' AND required, CASE WHEN status = 'FAIL' THEN 'required_protected_object_missing_or_broken' END FROM things"""
