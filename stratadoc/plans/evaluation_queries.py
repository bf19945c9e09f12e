"""Queries of evaluation: items of documents against perturbed copies of them, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content as C
from ..operators import evaluation as E
from ..sources import fixtures as X
from .content_queries import HIERARCHY
from .text_queries import norm_sql

QUERIES, ORACLES = {}, {}


def both(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH RECURSIVE {X.GOLD}{sql}"


both(
    "jn04_compare_coverage",
    lambda s, d: E.compare_coverage(X.items(s, d).where("(doc_id + block) % 13 > 0"), X.gold(s, d)),
    " SELECT doc_id, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (g IS NULL AND a) AS correctly_excluded, count(*) FILTER (g IS NULL AND NOT a) AS unexpected FROM (SELECT doc_id, object_id, status = 'layout_only' AS a FROM items WHERE (doc_id + block) % 13 > 0) FULL JOIN (SELECT doc_id, object_id, true AS g FROM gold) USING (doc_id, object_id) GROUP BY doc_id",
)
both(
    "jn05_compare_fields",
    lambda s, d: E.compare_fields(X.items(s, d).where("block % 11 > 0"), X.gold(s, d)).groupBy("doc_id", "result").agg(F.count("*").alias("n")),
    " SELECT g.doc_id, CASE WHEN i.object_id IS NULL THEN 'missing' WHEN i.field_id IS NOT DISTINCT FROM g.field_id THEN 'exact' ELSE 'mismatch' END AS result, count(*) AS n FROM gold g LEFT JOIN (SELECT * FROM items WHERE block % 11 > 0) i USING (doc_id, object_id) GROUP BY ALL",
)
both(
    "jn05_field_deltas",
    lambda s, d: E.field_deltas(X.items(s, d), X.gold(s, d)),
    ", a AS (SELECT doc_id, field_id, count(*) AS actual FROM items WHERE field_id IS NOT NULL GROUP BY ALL), g AS (SELECT doc_id, field_id, count(*) AS gold FROM gold GROUP BY ALL) SELECT doc_id, field_id, coalesce(actual, 0) AS actual, coalesce(gold, 0) AS gold, coalesce(actual, 0) - coalesce(gold, 0) AS delta FROM a FULL JOIN g USING (doc_id, field_id)",
)
both(
    "jn06_compare_values",
    lambda s, d: E.compare_values(X.items(s, d).withColumn("value", F.when(F.col("block") % 8 == 0, F.upper("value")).otherwise(F.col("value"))), X.gold(s, d), T.norm_text).groupBy("doc_id", "result").agg(F.count("*").alias("n")),
    f" SELECT g.doc_id, CASE WHEN i.object_id IS NULL THEN 'no_key' WHEN {norm_sql('g.value')} IS NOT DISTINCT FROM {norm_sql('CASE WHEN i.block % 8 = 0 THEN upper(i.value) ELSE i.value END')} THEN 'exact' ELSE 'mismatch' END AS result, count(*) AS n FROM gold g LEFT JOIN items i ON i.doc_id = g.doc_id AND i.object_id = g.object_id AND i.field_id = g.field_id GROUP BY ALL",
)


def value_groups(s, d):
    """Gold items of up to two blocks of a field, some with their first block's value alone; actual ones, some of which are single blocks, lack one or have another value."""
    rows = X.items(s, d).where("field_id is not null").withColumn("g", F.floor(F.col("block") / 14))
    pieces = F.array_sort(F.collect_list(F.struct("block", "object_id", F.col("value").alias("text"))))
    of = rows.groupBy("doc_id", "g", "field_id").agg(pieces.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "")
    gold = of.select("doc_id", F.concat_ws(":", "g", "field_id").alias("item_id"), "field_id", F.when(F.col("g") % 3 == 2, F.col("p")[0]["text"]).otherwise(joined).alias("value"), F.transform("p", lambda x: F.struct(x["object_id"].alias("object_id"), x["text"].alias("text"))).alias("pieces"))
    whole = of.where("(doc_id + g) % 2 = 0").select("doc_id", F.col("g").alias("seq"), F.transform("p", lambda x: x["object_id"]).alias("sources"), "field_id", F.when(F.col("g") % 5 == 1, F.concat(F.upper(joined), F.lit(" "))).when(F.col("g") % 5 == 2, "other").otherwise(joined).alias("value"))
    single = rows.where("(doc_id + g) % 2 = 1 and block % 9 > 0").select("doc_id", F.col("block").alias("seq"), F.array("object_id").alias("sources"), "field_id", F.when(F.col("block") % 4 == 1, F.concat(F.lit(" "), "value")).when(F.col("block") % 4 == 2, F.concat("value", F.lit("?"))).otherwise(F.col("value")).alias("value"))
    return whole.unionByName(single), gold


both(
    "jn06_compare_item_values",
    lambda s, d: E.compare_item_values(*value_groups(s, d), T.norm_text).groupBy("doc_id", "item_id", "result").agg(F.count("*").alias("n"), F.count("object_id").alias("by_source")),
    f""", r AS (SELECT *, block // 14 AS g FROM items WHERE field_id IS NOT NULL), o AS (SELECT doc_id, g, field_id, list(object_id ORDER BY block) AS src, list(value ORDER BY block) AS txt, string_agg(value, '' ORDER BY block) AS j FROM r GROUP BY ALL),
    gd AS (SELECT doc_id, g || ':' || field_id AS item_id, g, field_id, src, txt, CASE WHEN g % 3 = 2 THEN txt[1] ELSE j END AS v FROM o),
    wh AS (SELECT doc_id, src, field_id, CASE WHEN g % 5 = 1 THEN upper(j) || ' ' WHEN g % 5 = 2 THEN 'other' ELSE j END AS v FROM o WHERE (doc_id + g) % 2 = 0),
    si AS (SELECT doc_id, object_id, field_id, CASE WHEN block % 4 = 1 THEN ' ' || value WHEN block % 4 = 2 THEN value || '?' ELSE value END AS v FROM r WHERE (doc_id + g) % 2 = 1 AND block % 9 > 0),
    every AS (SELECT doc_id, src, field_id, v FROM wh UNION ALL SELECT doc_id, [object_id], field_id, v FROM si),
    grp AS (SELECT gd.doc_id, gd.item_id, CAST(NULL AS VARCHAR) AS object_id, {norm_sql('e.v')} = {norm_sql('gd.v')} AS same FROM gd JOIN every e ON e.doc_id = gd.doc_id AND e.src = gd.src AND e.field_id = gd.field_id),
    pc AS (SELECT doc_id, item_id, field_id, v, j = 1 AS frag, unnest(src) AS object_id, unnest(txt) AS t FROM (SELECT *, CASE WHEN {norm_sql('v')} = {norm_sql("array_to_string(txt, '')")} THEN 1 ELSE 0 END AS j FROM gd) WHERE item_id || '@' || doc_id NOT IN (SELECT item_id || '@' || doc_id FROM grp)),
    sr AS (SELECT doc_id, unnest(src) AS object_id, field_id, v FROM every),
    res AS (SELECT * FROM grp UNION ALL SELECT pc.doc_id, pc.item_id, pc.object_id, {norm_sql('sr.v')} = {norm_sql('CASE WHEN pc.frag THEN pc.t ELSE pc.v END')} FROM pc JOIN sr USING (doc_id, object_id, field_id))
    SELECT doc_id, item_id, CASE WHEN same THEN 'exact' ELSE 'mismatch' END AS result, count(*) AS n, count(object_id) AS by_source FROM res GROUP BY ALL""",
)


def bindings(df, again):
    own = df.withColumn("binding", E.binding(F.array("object_id"), F.col("field_id"), F.lit("classified")))
    return own.unionByName(own.where(again))


both(
    "jn07_compare_grouping",
    lambda s, d: E.compare_grouping(bindings(X.items(s, d).drop("source"), "block % 40 = 0"), bindings(X.gold(s, d).withColumnRenamed("pos", "block"), "doc_id % 50 = 1")).groupBy("doc_id", "result").agg(F.count("*").alias("n"), F.max("copies").alias("copies")),
    ", a AS (SELECT doc_id, object_id || '|' || coalesce(field_id, '<classified>') AS b, CASE WHEN block % 40 = 0 THEN 2 ELSE 1 END AS a FROM items), g AS (SELECT doc_id, object_id || '|' || coalesce(field_id, '<classified>') AS b, CASE WHEN doc_id % 50 = 1 THEN 2 ELSE 1 END AS g FROM gold) SELECT doc_id, CASE WHEN a IS NULL THEN 'missing' WHEN g IS NULL THEN 'unexpected' ELSE 'exact' END AS result, count(*) AS n, CAST(max(greatest(coalesce(a, 0), coalesce(g, 0))) AS BIGINT) AS copies FROM a FULL JOIN g USING (doc_id, b) GROUP BY ALL",
)
KEYED = ", a AS (SELECT doc_id, object_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS n FROM items WHERE status = 'classified'), g AS (SELECT doc_id, object_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY pos, object_id) AS n FROM gold)"


def sequences(s, d):
    a = X.items(s, d).where("status = 'classified'").select("doc_id", F.struct("block", "object_id").alias("pos"), F.col("object_id").alias("key"))
    g = X.gold(s, d).select("doc_id", F.struct("pos", "object_id").alias("pos"), F.col("object_id").alias("key"))
    return a, g


both(
    "jn08_compare_order",
    lambda s, d: E.compare_order(*sequences(s, d)).withColumn("first_mismatch", F.col("first_mismatch").cast("long")),
    KEYED + ", f AS (SELECT doc_id, n, a.key AS ak, g.key AS gk FROM a FULL JOIN g USING (doc_id, n)), c AS (SELECT a.doc_id, a.n AS an, g.n AS gn FROM a JOIN g USING (doc_id, key)), o AS (SELECT doc_id, coalesce(lag(gn) OVER (PARTITION BY doc_id ORDER BY an) < gn, true) AS ok FROM c), k AS (SELECT doc_id, bool_and(ok) AS relative_order FROM o GROUP BY doc_id) SELECT f.doc_id, bool_and(ak IS NOT DISTINCT FROM gk) AS equal, min(n) FILTER (ak IS DISTINCT FROM gk) AS first_mismatch, any_value(relative_order) AS relative_order FROM f LEFT JOIN k USING (doc_id) GROUP BY f.doc_id",
)


def hierarchies(s, d):
    actual = C.bind_hierarchy(X.items(s, d))
    expected = C.bind_hierarchy(X.items(s, d).where("block % 9 > 0"))
    return E.compare_hierarchy(actual, expected, C.bind_captions(X.items(s, d))).groupBy("doc_id", "result").agg(F.count("*").alias("n"))


def hierarchy_sql(table: str, where: str) -> str:
    return HIERARCHY.replace(" h AS", f" h{table} AS").replace(" h a", f" h{table} a").replace(" h b", f" h{table} b").replace(" h c", f" h{table} c").replace("o AS", f"o{table} AS").replace("JOIN o ", f"JOIN o{table} ").replace("o.pb", f"o{table}.pb").replace("p AS", f"p{table} AS").replace("FROM items)", f"FROM items WHERE {where})").replace("FROM items i", f"FROM (SELECT * FROM items WHERE {where}) i")


both(
    "jn09_compare_hierarchy",
    hierarchies,
    hierarchy_sql("1", "true") + hierarchy_sql("2", "block % 9 > 0")
    + ", i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS n FROM items), bc AS (SELECT c.doc_id, c.object_id, arg_min(t.object_id, abs(t.block - c.block) * 1000000 + (CASE WHEN t.n < c.n THEN 0 ELSE 1 END) * 100000 + abs(t.n - c.n)) AS target FROM i c JOIN i t ON t.doc_id = c.doc_id AND c.field_id = t.field_id || '.caption' AND abs(t.block - c.block) <= 2 GROUP BY ALL)"
    " SELECT p2.doc_id, CASE WHEN p2.parent_id IS NULL AND p1.parent_id IS NULL THEN 'root' WHEN p2.parent_id = p1.parent_id THEN 'direct' WHEN bc.target = p2.parent_id THEN 'relation' ELSE 'mismatch' END AS result, count(*) AS n FROM p2 JOIN p1 ON p1.doc_id = p2.doc_id AND p1.object_id = p2.object_id LEFT JOIN bc ON bc.doc_id = p2.doc_id AND bc.object_id = p2.object_id GROUP BY ALL",
)
def provenance(s, d):
    """Items of both sides, some missing, moved or bound otherwise; heads of documents of which some differ; references to each item's object."""
    i, doc, block = X.items(s, d).where("status = 'classified'"), F.col("doc_id"), F.col("block")
    key = doc + block
    sha = lambda c: F.sha2(c.cast("string"), 256)
    heads = X.table(s, d, "documents").select("doc_id", sha(doc).alias("inventory_sha256"), sha(F.when(doc % 5 == 0, -1).otherwise(doc)).alias("actual_sha256"), sha(doc).alias("gold_sha256"), F.lit("fields@1").alias("actual_registry"), F.when(doc % 7 > 0, "fields@1").otherwise("fields@2").alias("gold_registry"), F.lit("h").alias("actual_registry_sha256"), F.when(doc % 11 > 0, "h").alias("gold_registry_sha256"))
    item = lambda df, spot: df.select("doc_id", block.alias("pos"), F.col("object_id").alias("item_id"), spot.alias("block"), "inline", F.array("object_id").alias("object_ids"), F.array(F.concat(F.lit("/p["), spot.cast("string"), F.lit("]"))).alias("locators"))
    locators = F.array(*[F.concat(F.lit(x), block.cast("string"), F.lit("]")) for x in ("/p[", "/body/p[")])
    objects = i.where(block % 13 > 0).select("doc_id", "object_id", locators.alias("locators"))
    refs = i.where(doc % 3 > 0).select("doc_id", "object_id", F.when(block % 2 == 0, sha(F.when(key % 31 == 0, 0).otherwise(doc))).alias("document_sha256"), F.when(block % 3 == 0, F.concat(F.lit("/body/p["), F.when(key % 37 == 0, -1).otherwise(block).cast("string"), F.lit("]"))).alias("locator"))
    return heads, item(i.where(key % 101 > 0), F.when(key % 103 == 0, block + 1).otherwise(block)), item(i, block), refs, objects


PROVENANCE = """, it AS (SELECT doc_id, block, doc_id + block AS key FROM items WHERE status = 'classified'), pl AS (SELECT doc_id, bool_and(key % 101 > 0) AS item_ids, bool_and(key % 101 > 0 AND key % 103 > 0) AS orders FROM it GROUP BY doc_id),
bad AS (SELECT doc_id, sha256(doc_id || '-' || block) AS object_id, block % 13 > 0 AS present, block % 13 > 0 AND (block % 2 = 1 OR key % 31 > 0 OR doc_id = 0) AS document, block % 13 > 0 AND (block % 3 > 0 OR key % 37 > 0) AS located FROM it WHERE doc_id % 3 > 0), bd AS (SELECT * FROM bad WHERE NOT (present AND document AND located))"""
both(
    "jn03_compare_provenance",
    lambda s, d: E.compare_provenance(*provenance(s, d))[0],
    PROVENANCE + " SELECT d.doc_id, d.doc_id % 5 > 0 AS source, d.doc_id % 7 > 0 AS registry_identity, d.doc_id % 11 > 0 AS registry_hash, coalesce(item_ids, true) AS item_ids, coalesce(orders, true) AS orders, coalesce(orders, true) AS bindings, coalesce(m, 0) = 0 AS source_references, coalesce(m, 0) AS mismatches FROM documents d LEFT JOIN pl USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM bd GROUP BY doc_id) USING (doc_id)",
)
both("jn03_reference_mismatches", lambda s, d: E.compare_provenance(*provenance(s, d))[1], PROVENANCE + " SELECT * FROM bd")


def walked(s, d):
    objects = X.items(s, d).select("doc_id", "object_id", F.concat(F.lit("/p["), (F.col("block") - F.col("block") % 3 * (F.col("doc_id") % 2)).cast("string"), F.lit("]")).alias("locator"))
    refs = objects.join(X.gold(s, d).select("doc_id", "object_id", "pos"), ["doc_id", "object_id"]).select("doc_id", F.when(F.col("pos") % 4 > 0, F.col("object_id")).otherwise(F.concat(F.lit("old-"), "object_id")).alias("object_id"), F.when(F.col("pos") % 8 == 0, "/gone").otherwise(F.col("locator")).alias("locator"))
    return E.crosswalk(refs, objects).groupBy("doc_id", "how").agg(F.count("*").alias("n"), F.count("resolved").alias("resolved"))


def pictured(s, d):
    """References to pictures by their place in a host of three blocks, with ids of another run."""
    block, host = F.col("block"), F.concat(F.lit("/body/tbl["), F.floor(F.col("block") / 3).cast("string"), F.lit("]"))
    objects = X.items(s, d).select("doc_id", "object_id", block.alias("seq"), F.concat(host, F.lit("/r["), block.cast("string"), F.lit("]")).alias("locator"), F.when(block % 2 == 0, "picture").otherwise("text").alias("kind"))
    refs = X.items(s, d).where("block % 2 = 0").select("doc_id", F.concat(F.lit("old-"), "object_id").alias("object_id"), F.concat(host, F.lit("/image["), (1 + block % 5).cast("string"), F.lit("]")).alias("locator"))
    return E.crosswalk(refs, objects)



both(
    "jn02_crosswalk",
    walked,
    ", ob AS (SELECT doc_id, object_id, '/p[' || (block - block % 3 * (doc_id % 2)) || ']' AS locator FROM items), rf AS (SELECT doc_id, CASE WHEN pos % 4 > 0 THEN g.object_id ELSE 'old-' || g.object_id END AS object_id, CASE WHEN pos % 8 = 0 THEN '/gone' ELSE locator END AS locator FROM gold g JOIN ob USING (doc_id, object_id)), al AS (SELECT doc_id, locator, count(*) AS n FROM ob GROUP BY ALL),"
    " x AS (SELECT rf.doc_id, CASE WHEN o.object_id IS NOT NULL THEN 'id' WHEN n = 1 THEN 'locator' WHEN n > 1 THEN 'locator_ambiguous' ELSE 'locator_missing' END AS how FROM rf LEFT JOIN ob o ON o.doc_id = rf.doc_id AND o.object_id = rf.object_id LEFT JOIN al ON al.doc_id = rf.doc_id AND al.locator = rf.locator) SELECT doc_id, how, count(*) AS n, count(*) FILTER (how IN ('id', 'locator')) AS resolved FROM x GROUP BY ALL",
)


def report(s, d):
    fields = E.compare_fields(X.items(s, d), X.gold(s, d)).groupBy("doc_id").agg(F.bool_and(F.col("result") == "exact").alias("passed"))
    order = E.compare_order(*sequences(s, d)).select("doc_id", F.col("relative_order").alias("passed"))
    cover = E.compare_coverage(X.items(s, d), X.gold(s, d)).select("doc_id", (F.col("unexpected") == 0).alias("passed"))
    return E.content_report({"coverage": cover, "fields": fields, "order": order})


both(
    "ag11_content_report",
    report,
    KEYED + ", c AS (SELECT a.doc_id, a.n AS an, g.n AS gn FROM a JOIN g USING (doc_id, key)), od AS (SELECT doc_id, bool_and(ok) AS p FROM (SELECT doc_id, coalesce(lag(gn) OVER (PARTITION BY doc_id ORDER BY an) < gn, true) AS ok FROM c) GROUP BY doc_id), fl AS (SELECT g.doc_id, bool_and(i.field_id = g.field_id) AS p FROM gold g JOIN items i USING (doc_id, object_id) GROUP BY ALL), cv AS (SELECT i.doc_id, count(*) FILTER (g.object_id IS NULL AND i.status = 'classified') = 0 AS p FROM items i LEFT JOIN gold g USING (doc_id, object_id) GROUP BY i.doc_id),"
    " z AS (SELECT doc_id, list_filter([CASE WHEN NOT cv.p THEN 'coverage' END, CASE WHEN NOT coalesce(fl.p, true) THEN 'fields' END, CASE WHEN NOT coalesce(od.p, true) THEN 'order' END], lambda v: v IS NOT NULL) AS blockers FROM cv LEFT JOIN fl USING (doc_id) LEFT JOIN od USING (doc_id)) SELECT doc_id, blockers, CASE WHEN len(blockers) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM z",
)
both(
    "jn12_guard_binding",
    lambda s, d: E.guard_binding(X.items(s, d).select("doc_id", "block", F.sha2(F.col("doc_id").cast("string"), 256).alias("snapshot")), X.table(s, d, "documents").where("doc_id % 6 > 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("doc_id").cast("string")), 256).alias("snapshot")), "doc_id", "snapshot").groupBy("code").agg(F.count("*").alias("n")),
    " SELECT CASE WHEN doc_id % 6 = 0 THEN 'absent' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'current' END AS code, count(*) AS n FROM items GROUP BY ALL",
)
both(
    "jn02_image_aliases",
    pictured,
    ", ob AS (SELECT doc_id, object_id, block, block // 3 AS h FROM items), im AS (SELECT doc_id, h, object_id, row_number() OVER (PARTITION BY doc_id, h ORDER BY block) AS n FROM ob WHERE block % 2 = 0) SELECT o.doc_id, 'old-' || o.object_id AS object_id, im.object_id AS resolved, CASE WHEN im.n IS NULL THEN 'locator_missing' ELSE 'locator' END AS how FROM ob o LEFT JOIN im ON im.doc_id = o.doc_id AND im.h = o.h AND im.n = 1 + o.block % 5 WHERE o.block % 2 = 0",
)


def registry(s, d):
    """A registry with a field for each part: some lack their id, repeat one, or name no parent, no sources or an odd policy."""
    p = F.col("p_partkey")
    field = F.struct(
        F.when(p % 41 > 0, F.concat(F.lit("f."), F.when(p % 50 == 7, 1).otherwise(p).cast("string"))).alias("field_id"),
        F.when(p % 7 == 0, F.concat(F.lit("f."), F.floor(p / 7).cast("string"))).when(p % 90 == 3, "f.none").alias("parent_field_id"),
        F.col("p_name").alias("label"),
        F.concat("p_type", F.lit(" "), "p_brand").alias("meaning"),
        F.when(p % 37 == 0, F.array().cast("array<string>")).when(p % 43 == 0, F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"))).alias("value_sources"),
        F.when(p % 61 == 0, "maybe").when(p % 2 == 0, "required").otherwise("optional").alias("student_extraction_policy"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("notes"),
        F.lit("blue").alias("colour"),
    )
    return E.load_registry(X.table(s, d, "part").select(p.cast("long").alias("seq"), F.to_json(field).alias("json")))


REGISTRY = ", reg AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 41 > 0 THEN 'f.' || CASE WHEN p_partkey % 50 = 7 THEN 1 ELSE p_partkey END END AS field_id, CASE WHEN p_partkey % 7 = 0 THEN 'f.' || p_partkey // 7 WHEN p_partkey % 90 = 3 THEN 'f.none' END AS parent_field_id, p_name AS label, p_type || ' ' || p_brand AS meaning, 'size ' || p_size AS notes, p_partkey % 37 = 0 OR p_partkey % 43 = 0 AS bare, p_partkey % 61 = 0 AS maybe FROM part)"
both(
    "src03_check_registry",
    lambda s, d: E.check_registry(registry(s, d)),
    REGISTRY + " SELECT field_id, 'field_id_missing' AS code FROM reg WHERE field_id IS NULL UNION ALL SELECT field_id, 'field_id_duplicate' FROM reg WHERE field_id IS NOT NULL GROUP BY field_id HAVING count(*) > 1 UNION ALL SELECT field_id, 'parent_unknown' FROM reg WHERE parent_field_id IS NOT NULL AND parent_field_id NOT IN (SELECT field_id FROM reg WHERE field_id IS NOT NULL) UNION ALL SELECT field_id, 'value_sources_empty' FROM reg WHERE bare UNION ALL SELECT field_id, 'policy_invalid' FROM reg WHERE maybe",
)
both(
    "jn34_integrity",
    lambda s, d: E.integrity(C.bind_hierarchy(X.items(s, d)), X.items(s, d).where("physical_type = 'text' and field_id is not null").select("field_id").distinct(), X.items(s, d).where("block % 8 > 0")).groupBy("doc_id", "code").agg(F.count("*").alias("n")),
    HIERARCHY + ", known AS (SELECT DISTINCT field_id FROM items WHERE physical_type = 'text' AND field_id IS NOT NULL) SELECT doc_id, code, count(*) AS n FROM (SELECT doc_id, 'field_unregistered' AS code FROM items WHERE field_id NOT IN (SELECT field_id FROM known) UNION ALL SELECT doc_id, 'source_stale' FROM items WHERE block % 8 = 0 UNION ALL SELECT p.doc_id, 'parent_stale' FROM p JOIN items q ON q.doc_id = p.doc_id AND q.object_id = p.parent_id WHERE q.block % 8 = 0) GROUP BY ALL",
)


def placed(s, d):
    slots = X.table(s, d, "documents").select("doc_id", F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("slot_id"), F.lit(f).alias("field_id"), F.lit(i % 2 == 0).alias("required")) for i, f in enumerate(("body.figure", "body.heading.outline1", "body.figure.caption"))])).alias("x")).select("doc_id", "x.*")
    return E.place(slots, X.items(s, d))


PLACED = ", sl(slot_id, field_id, required) AS (VALUES ('s0', 'body.figure', true), ('s1', 'body.heading.outline1', false), ('s2', 'body.figure.caption', true)), pl AS (SELECT d.doc_id, slot_id, sl.field_id, required, count(i.block) AS n, coalesce(string_agg(i.value, chr(10) ORDER BY i.block), '') AS text, CASE WHEN count(i.block) > 0 THEN 'filled' ELSE 'missing' END AS status FROM documents d CROSS JOIN sl LEFT JOIN items i ON i.doc_id = d.doc_id AND i.field_id = sl.field_id AND i.status = 'classified' GROUP BY ALL)"
both("jn11_place", placed, PLACED + " SELECT * FROM pl")
both("ag27_placement_status", lambda s, d: E.placement_status(placed(s, d)), PLACED + " SELECT doc_id, count(*) FILTER (required AND status = 'missing') AS missing_required, CASE WHEN count(*) FILTER (required AND status = 'missing') > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM pl GROUP BY doc_id")


def slots_of(s, d):
    o = X.table(s, d, "orders").select(F.col("o_custkey").alias("pair_id"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slot_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 5).cast("string")).alias("tag"), (F.col("o_orderkey") % 2).alias("part"), "o_orderkey")
    return o.where("o_orderkey % 7 > 0").drop("o_orderkey"), o.where("o_orderkey % 3 > 0").drop("o_orderkey")


SLOTS = ", os AS (SELECT o_custkey AS pair_id, 's' || o_orderkey AS slot_id, 't' || o_orderkey % 5 AS tag, o_orderkey % 2 AS part, o_orderkey AS k FROM orders), go AS (SELECT * FROM os WHERE k % 7 > 0), ac AS (SELECT * FROM os WHERE k % 3 > 0)"
both(
    "jn13_align_slots",
    lambda s, d: E.align_slots(*slots_of(s, d)),
    SLOTS + ", x AS (SELECT g.pair_id, g.slot_id, (SELECT count(*) FROM ac a WHERE a.pair_id = g.pair_id AND a.slot_id = g.slot_id) AS ni, (SELECT count(*) FROM ac a WHERE a.pair_id = g.pair_id AND a.tag = g.tag AND a.part = g.part) AS nt, (SELECT min(slot_id) FROM ac a WHERE a.pair_id = g.pair_id AND a.tag = g.tag AND a.part = g.part) AS ts FROM go g) SELECT pair_id, slot_id, CASE WHEN ni = 1 THEN slot_id WHEN ni = 0 AND nt = 1 THEN ts END AS actual_slot, CASE WHEN ni > 0 THEN CASE WHEN ni > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END WHEN nt = 0 THEN 'MISSING' WHEN nt > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status FROM x",
)
both(
    "jn17_check_markers",
    lambda s, d: E.check_markers(*slots_of(s, d)),
    SLOTS + ", dc AS (SELECT pair_id, tag, count(*) AS d FROM go GROUP BY ALL), pr AS (SELECT pair_id, tag, count(*) AS p FROM ac GROUP BY ALL) SELECT pair_id, tag, CASE WHEN p IS NULL THEN 'missing' WHEN d IS NULL THEN 'undeclared' WHEN p > 1 THEN 'repeated' ELSE 'fine' END AS code FROM dc FULL JOIN pr USING (pair_id, tag)",
)


def located(s, d):
    p = X.blocks(s, d).select("doc_id", "block", (F.col("block") % 3).alias("level"), "text")
    loc = X.table(s, d, "documents").select("doc_id", F.col("doc_id").alias("locator_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3).alias("l_level"), F.when(F.col("doc_id") % 3 > 0, "th").alias("anchor"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 4).alias("occurrence"))
    return E.locate_paragraphs(p, loc).select("locator_id", "block")


both(
    "jn15_locate_paragraphs",
    located,
    ", c AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS n FROM blocks WHERE (doc_id % 2 = 1 OR block % 3 = doc_id % 3) AND (doc_id % 3 = 0 OR contains(text, 'th'))) SELECT doc_id AS locator_id, block FROM c WHERE doc_id % 5 = 0 OR n = doc_id % 4",
)
both(
    "jn20_residue_scan",
    lambda s, d: E.residue_scan(X.table(s, d, "benchmark").select(F.col("item_id").alias("region_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.when(F.col("item_id") % 9 > 0, F.substring("text", 1, 30)).alias("forbidden")), X.table(s, d, "documents").select("doc_id", "source", "text")),
    " SELECT doc_id, item_id AS region_id, CASE WHEN item_id % 9 = 0 THEN 'UNKNOWN' WHEN contains(d.text, substr(b.text, 1, 30)) THEN 'FAIL' ELSE 'PASS' END AS status FROM documents d JOIN benchmark b ON d.source = 'src' || item_id % 20",
)


def asked(s, d):
    return X.table(s, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.element_at(F.array(*[F.lit(x) for x in ("Cold Widget", "widget", "promo", "small promo", "brand#1", "nothing here", "size 2", "size small")]), (F.col("n_nationkey") % 8 + 1).cast("int")).alias("query")).withColumn("terms", F.split("query", " "))


TERM = "CASE WHEN contains(lower(field_id), lower(t)) THEN 110 WHEN contains(replace(lower(label), ' ', ''), lower(t)) THEN 90 WHEN contains(replace(lower(meaning), ' ', ''), lower(t)) THEN 40 WHEN contains(replace(lower(notes), ' ', ''), lower(t)) THEN 20 ELSE 0 END"
both(
    "tk01_search_registry",
    lambda s, d: E.search_registry(asked(s, d), registry(s, d).where("field_id is not null"), T.norm_text, 3),
    REGISTRY + f""", qs AS (SELECT n_nationkey AS query_id, ['Cold Widget', 'widget', 'promo', 'small promo', 'brand#1', 'nothing here', 'size 2', 'size small'][n_nationkey % 8 + 1] AS q FROM nation), nq AS (SELECT *, replace(lower(q), ' ', '') AS x, replace(lower(label), ' ', '') AS l, replace(lower(meaning), ' ', '') AS m, replace(lower(notes), ' ', '') AS o FROM qs, reg WHERE field_id IS NOT NULL),
    sc AS (SELECT *, CASE WHEN x = field_id OR x = l THEN 1000 WHEN contains(field_id, x) OR contains(l, x) THEN 800 WHEN contains(m, x) THEN 500 WHEN contains(o, x) THEN 200 ELSE CAST((SELECT sum({TERM}) FROM (SELECT unnest(string_split(q, ' ')) AS t)) AS BIGINT) END AS score FROM nq)
    SELECT query_id, field_id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3""",
)


def evidence(s, d):
    """Conversations as runs of the document of their number; those of a multiple of three turns lack evidence."""
    return X.table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.count("*") % 3 == 0).alias("lacks"))


#: Of each comparison of documents: rows that count, how often, and the measure.
MEASURED = [
    ("jn03_compare_provenance", "not (source and registry_identity and registry_hash and item_ids and orders and bindings and source_references)", "1", "provenance_mismatch"),
    ("jn04_compare_coverage", "missing > 0", "missing", "missing_mapped_source"),
    ("jn04_compare_coverage", "unexpected > 0", "unexpected", "unexpected_actual_source"),
    ("jn05_compare_fields", "result = 'missing'", "n", "missing_source_field"),
    ("jn05_compare_fields", "result = 'mismatch'", "n", "field_mismatch"),
    ("jn05_field_deltas", "delta <> 0", "1", "field_count_difference"),
    ("jn06_compare_values", "result = 'mismatch'", "n", "value_mismatch"),
    ("jn07_compare_grouping", "result = 'missing'", "n", "missing_binding_group"),
    ("jn07_compare_grouping", "result = 'unexpected'", "n", "unexpected_binding_group"),
    ("jn07_compare_grouping", "copies > 1", "n", "duplicate_binding"),
    ("jn08_compare_order", "not equal", "1", "sequence_mismatch"),
    ("jn09_compare_hierarchy", "result = 'mismatch'", "n", "parent_mismatch"),
]


def dimensions(s, d):
    rows = evidence(s, d).where("lacks").select("doc_id", F.lit("evidence_incomplete").alias("measure"), F.lit(1).cast("long").alias("n"))
    for name in dict.fromkeys(m[0] for m in MEASURED):
        found = [F.when(F.expr(which), F.struct(F.lit(measure).alias("measure"), F.expr(n).cast("long").alias("n"))) for of, which, n, measure in MEASURED if of == name]
        rows = rows.unionByName(QUERIES[name](s, d).select("doc_id", F.inline(F.array_compact(F.array(*found)))))
    return E.dimension_report(X.table(s, d, "documents"), rows)


def dimensions_sql() -> str:
    parts = [f"SELECT doc_id, '{measure}' AS measure, {n} AS n FROM ({ORACLES[name]}) WHERE {which}" for name, which, n, measure in MEASURED]
    parts.append("SELECT conv_id, 'evidence_incomplete', 1 FROM conversations GROUP BY conv_id HAVING count(*) % 3 = 0")
    failed = lambda group: "coalesce(list_has_any(ms, [" + ", ".join(f"'{m}'" for m in group) + "]), false)"
    blockers = ", ".join(f"CASE WHEN {failed(group)} THEN '{code}' END" for code, group in E.BLOCKERS.items())
    columns = ", ".join(f"CASE WHEN {failed(group)} THEN 'FAIL' ELSE 'PASS' END AS {name}" for name, group in E.DIMENSIONS.items())
    return f"WITH m AS ({' UNION ALL '.join(parts)}), f AS (SELECT doc_id, list(DISTINCT measure) AS ms FROM m WHERE n > 0 GROUP BY doc_id), r AS (SELECT d.doc_id, list_filter([{blockers}], lambda v: v IS NOT NULL) AS blockers, {columns} FROM documents d LEFT JOIN f USING (doc_id)) SELECT *, CASE WHEN len(blockers) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r"


QUERIES["ag11_dimension_report"], ORACLES["ag11_dimension_report"] = dimensions, dimensions_sql()


def placement(s, d):
    """First blocks as titles, second ones as abstracts, the others as body; slots of each document, not all of which have items."""
    block = F.col("block")
    rows = X.items(s, d).withColumn("field_id", F.when(block == 1, "title").when((block == 2) & (F.col("doc_id") % 4 > 0), "abstract").otherwise(F.col("field_id")))
    kinds = [("title", "title", True), ("abstract", "abstract", False), ("keywords", "keywords", True), ("figure", "body.figure", False), ("text", "body.paragraph", True)]
    slot = F.array(*[F.struct(F.lit(k).alias("slot_no"), F.lit(n).alias("slot_id"), F.lit(f).alias("field_id"), F.lit(f"tag.{n}").alias("tag"), F.lit(r).alias("required")) for k, (n, f, r) in enumerate(kinds)])
    slots = X.table(s, d, "documents").select("doc_id", F.inline(slot)).where("slot_id <> 'keywords' or doc_id % 5 = 0")
    registry = s.createDataFrame([("title", "text"), ("keywords", "text"), ("abstract", "blocks"), ("body.paragraph", "text")], "field_id string, content_type string")
    return E.build_placement(slots, rows, registry, ["body.paragraph", "body.figure"])


PLACED = """, it AS (SELECT doc_id, block, object_id, value, CASE WHEN block = 1 THEN 'title' WHEN block = 2 AND doc_id % 4 > 0 THEN 'abstract' ELSE field_id END AS field_id FROM items),
sl AS (SELECT doc_id, * FROM documents, (VALUES ('title', 'title', true), ('abstract', 'abstract', false), ('keywords', 'keywords', true), ('figure', 'body.figure', false), ('text', 'body.paragraph', true)) v(slot_id, field_id, required)),
og AS (SELECT doc_id, field_id, list(object_id ORDER BY block) AS ids, string_agg(value, chr(10) ORDER BY block) AS txt FROM it WHERE field_id IS NOT NULL GROUP BY ALL),
pl AS (SELECT s.doc_id, s.slot_id, s.field_id, 'tag.' || s.slot_id AS tag, s.required, CASE WHEN ids IS NULL THEN 'missing' WHEN s.field_id LIKE 'body.%' THEN 'filled_by_body_items' ELSE 'filled' END AS status, CASE WHEN ids IS NOT NULL AND s.field_id NOT LIKE 'body.%' THEN CASE WHEN s.field_id = 'abstract' THEN 'replace_block_content_control' ELSE 'replace_text_content_control' END END AS action, CASE WHEN s.field_id IN ('title', 'keywords') THEN txt END AS value, CASE WHEN s.field_id NOT LIKE 'body.%' THEN ids END AS sources FROM sl s LEFT JOIN og USING (doc_id, field_id) WHERE s.slot_id <> 'keywords' OR s.doc_id % 5 = 0
UNION ALL SELECT doc_id, 'slot.body.aggregate', 'body.ordered_items', 'tag.figure', false, 'filled', 'replace_block_content_control', NULL, list(object_id ORDER BY block) FROM it WHERE field_id LIKE 'body.%' GROUP BY doc_id)"""
both("jn11_build_placement", placement, PLACED + " SELECT * FROM pl")
both(
    "ag27_placement_report",
    lambda s, d: E.placement_report(placement(s, d), X.items(s, d).select("doc_id", F.concat(F.lit("r"), F.col("block").cast("string")).alias("region_id"), ((F.col("doc_id") + F.col("block")) % 11 == 0).alias("required")), X.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 > 0, "accepted").alias("status"))),
    PLACED + ", ms AS (SELECT doc_id, list_sort(list(slot_id)) AS m FROM pl WHERE required AND status = 'missing' GROUP BY doc_id), rg AS (SELECT doc_id, list_sort(list('r' || block)) AS u FROM items WHERE (doc_id + block) % 11 = 0 GROUP BY doc_id), z AS (SELECT doc_id, coalesce(m, []) AS missing_required, coalesce(u, []) AS unresolved_regions, list_filter([CASE WHEN doc_id % 7 = 0 THEN 'template_fill_contract_not_human_accepted' END, CASE WHEN m IS NOT NULL THEN 'required_slots_missing' END, CASE WHEN u IS NOT NULL THEN 'generated_regions_not_materialized' END], lambda v: v IS NOT NULL) AS reasons FROM documents LEFT JOIN ms USING (doc_id) LEFT JOIN rg USING (doc_id)) SELECT *, CASE WHEN len(reasons) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM z",
)
