"""Queries of the content model over items of documents, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content as C
from ..sources import fixtures as X
from ..sources.blocks import read_blocks
from .text_queries import SHAPE_SQL, norm_sql

QUERIES, ORACLES = {}, {}


def both(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def with_items(sql: str) -> str:
    return f"WITH RECURSIVE {X.ITEMS}{sql}"


# the stack rule, told another way: the parent of a row is its last heading of a lower level that no heading of a lower or equal level follows
HIERARCHY = """, h AS (SELECT *, CASE WHEN field_id LIKE 'body.heading.outline%' THEN CAST(right(field_id, 1) AS INT) END AS lv FROM items),
o AS (SELECT a.doc_id, a.block, max(b.block) AS pb FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.block < a.block AND b.lv IS NOT NULL AND b.lv < coalesce(a.lv, 9)
 AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.block > b.block AND c.block < a.block AND c.lv <= b.lv)
 WHERE a.field_id LIKE 'body.%' GROUP BY a.doc_id, a.block),
p AS (SELECT i.*, q.object_id AS parent_id FROM items i LEFT JOIN o USING (doc_id, block) LEFT JOIN items q ON q.doc_id = i.doc_id AND q.block = o.pb)"""


def heading_tree(spark, sf):
    """Per document: how many items each heading holds directly, and its text."""
    rows = C.bind_hierarchy(X.items(spark, sf))
    held = rows.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("object_id")).agg(F.count("*").alias("held"))
    return rows.where(F.col("field_id").rlike(C.HEADING)).join(held, ["doc_id", "object_id"], "left").select("doc_id", "block", "field_id", "parent_id", F.coalesce("held", F.lit(0)).alias("held"))


both("heading_tree", heading_tree, with_items(HIERARCHY + " SELECT p.doc_id, p.block, p.field_id, p.parent_id, (SELECT count(*) FROM p k WHERE k.doc_id = p.doc_id AND k.parent_id = p.object_id) AS held FROM p WHERE p.field_id LIKE 'body.heading%'"))
both("wn02_hierarchy", lambda s, d: C.bind_hierarchy(X.items(s, d)).select("doc_id", "block", "field_id", "parent_id"), with_items(HIERARCHY + " SELECT doc_id, block, field_id, parent_id FROM p"))
both(
    "ag01_field_results",
    lambda s, d: C.field_results(X.items(s, d)),
    with_items(" SELECT doc_id, field_id, count(*) AS item_count, list(object_id ORDER BY block, \"inline\") AS content_ids FROM items WHERE status = 'classified' GROUP BY doc_id, field_id"),
)


def objects(spark, sf):
    """Hosts and, below each, up to three runs; the host's item is mapped unless its block is a multiple of five."""
    rows = X.items(spark, sf)
    host = rows.select("doc_id", "block", "object_id", F.lit(None).cast("string").alias("host"), F.when(F.col("block") % 11 == 0, "table").otherwise("paragraph").alias("kind"), F.col("value").alias("text"))
    runs = rows.select("doc_id", "block", F.explode(F.sequence(F.lit(1), F.col("block") % 3)).alias("k"), "object_id", "value").where("k <= block % 3 and k > 0")
    runs = runs.select("doc_id", "block", F.concat("object_id", F.lit("/"), F.col("k").cast("string")).alias("object_id"), F.col("object_id").alias("host"), F.lit("run").alias("kind"), F.col("value").alias("text"))
    return host.unionByName(runs)


OBJECTS = """, hosts AS (SELECT doc_id, block, object_id, NULL::VARCHAR AS host, CASE WHEN block % 11 = 0 THEN 'table' ELSE 'paragraph' END AS kind, value AS text FROM items),
runs AS (SELECT i.doc_id, i.block, i.object_id || '/' || k AS object_id, i.object_id AS host, 'run' AS kind, value AS text FROM items i, range(1, 3) t(k) WHERE k <= i.block % 3),
objects AS (SELECT * FROM hosts UNION ALL SELECT * FROM runs), mapped AS (SELECT * FROM items WHERE status = 'classified' AND block % 5 > 0),
cov AS (SELECT o.doc_id, o.object_id, CASE WHEN m.object_id IS NOT NULL THEN 'mapped' WHEN h.object_id IS NOT NULL THEN 'dependency' WHEN o.kind = 'paragraph' AND trim(o.text) = '' THEN 'layout_only' ELSE 'unsupported' END AS coverage
FROM objects o LEFT JOIN mapped m ON m.doc_id = o.doc_id AND m.object_id = o.object_id LEFT JOIN mapped h ON h.doc_id = o.doc_id AND h.object_id = o.host)"""


def coverage(spark, sf):
    mapped = X.items(spark, sf).where("status = 'classified' and block % 5 > 0")
    return C.source_coverage(objects(spark, sf), mapped)


both("ag02_source_coverage", lambda s, d: C.histogram(coverage(s, d), "coverage"), with_items(OBJECTS + " SELECT doc_id, coverage, count(*) AS n FROM cov GROUP BY ALL"))
both(
    "ag03_doc_status",
    lambda s, d: C.doc_status(X.items(s, d).withColumn("status", F.when(F.col("block") % 37 == 0, "ambiguous").otherwise(F.col("status"))), coverage(s, d).where("doc_id % 3 = 0")),
    with_items(OBJECTS + " SELECT i.doc_id, CASE WHEN max(CASE WHEN i.doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM cov c WHERE c.doc_id = i.doc_id AND c.coverage = 'unsupported') THEN 1 ELSE 0 END) = 1 THEN 'UNSUPPORTED' WHEN max(CASE WHEN i.block % 37 = 0 THEN 1 ELSE 0 END) = 1 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status FROM items i GROUP BY i.doc_id"),
)
both(
    "ag04_shape_histogram",
    lambda s, d: C.histogram(X.lines(s, d).withColumn("shape", T.numbering_shape(F.col("text"))), "shape"),
    f"WITH {X.LINES} SELECT doc_id, {SHAPE_SQL} AS shape, count(*) AS n FROM lines GROUP BY ALL",
)


def shaped(spark, sf):
    shape = F.element_at(F.array(*[F.lit(x) for x in ("decimal_1_component", "decimal_2_component", "none")]), (F.col("doc_id") % 3 + 1).cast("int"))
    outlier = F.col("block") % 6 == F.col("doc_id") % 7
    return X.items(spark, sf).where("block % 2 = 0 and status = 'classified'").withColumn("shape", shape).withColumn("field_id", F.when(outlier, "body.heading.outline2").otherwise("body.heading.outline1"))


both(
    "ag05_repair_headings",
    lambda s, d: C.repair_headings(shaped(s, d)).select("doc_id", "block", "field_id", "repaired"),
    with_items(""", s AS (SELECT doc_id, block, ['decimal_1_component', 'decimal_2_component', 'none'][doc_id % 3 + 1] AS shape, CASE WHEN block % 6 = doc_id % 7 THEN 'body.heading.outline2' ELSE 'body.heading.outline1' END AS field_id FROM items WHERE block % 2 = 0 AND status = 'classified'),
    g AS (SELECT doc_id, shape, count(*) AS n, mode(field_id) AS top, max(c) AS same FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, shape, field_id) AS c FROM s) GROUP BY ALL)
    SELECT doc_id, block, CASE WHEN n >= 3 AND same / n >= 0.8 AND shape <> 'none' THEN top ELSE field_id END AS field_id, n >= 3 AND same / n >= 0.8 AND shape <> 'none' AND field_id <> top AS repaired FROM s JOIN g USING (doc_id, shape)"""),
)
both(
    "jn10_bind_captions",
    lambda s, d: C.bind_captions(X.items(s, d).where("block % 13 > 0")),
    with_items(""", i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS n FROM items WHERE block % 13 > 0)
    SELECT c.doc_id, c.object_id AS caption_id, arg_min(t.object_id, abs(t.block - c.block) * 1000000 + (CASE WHEN t.n < c.n THEN 0 ELSE 1 END) * 100000 + abs(t.n - c.n)) AS target_id
    FROM i c JOIN i t ON t.doc_id = c.doc_id AND c.field_id = t.field_id || '.caption' AND abs(t.block - c.block) <= 2 GROUP BY ALL"""),
)
both(
    "wn03_neighbours",
    lambda s, d: C.neighbours(X.items(s, d)).select("doc_id", "block", "previous_text", "next_text"),
    with_items(" SELECT doc_id, block, last_value(CASE WHEN trim(value) <> '' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_text, first_value(CASE WHEN trim(value) <> '' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_text FROM items"),
)


def words_of_blocks(spark, sf):
    rows = X.blocks(spark, sf).select("doc_id", "block", F.col("text").alias("block_text"), F.posexplode(F.split("text", " ")).alias("k", "value"))
    return rows.select("doc_id", "block", "block_text", "value", (F.col("k") == 2).alias("structural"), F.lit(None).cast("string").alias("field_id"), F.lpad(F.col("k").cast("string"), 6, "0").alias("object_id"))


both(
    "wn01_source_order",
    lambda s, d: C.assign_order(words_of_blocks(s, d)).select("doc_id", "block", "object_id", "inline"),
    f"WITH {X.BLOCKS}, w AS (SELECT doc_id, block, text, unnest(string_split(text, ' ')) AS value, unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS k FROM blocks) SELECT doc_id, block, lpad(CAST(k AS VARCHAR), 6, '0') AS object_id, row_number() OVER (PARTITION BY doc_id, block ORDER BY CASE WHEN k = 2 THEN 0 ELSE 1 END, instr(text, value), k) - 1 AS \"inline\" FROM w",
)
both(
    "wn04_unique_ids",
    lambda s, d: C.unique_ids(X.items(s, d).where("field_id is not null").withColumn("base", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "field_id")), "base", "block").select("doc_id", "block", "unique_id"),
    with_items(" SELECT doc_id, block, doc_id || ':' || field_id || CASE WHEN row_number() OVER w > 1 THEN '#' || (row_number() OVER w - 1) ELSE '' END AS unique_id FROM items WHERE field_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id, field_id ORDER BY block)"),
)


def runs(spark, sf):
    rows = X.blocks(spark, sf).select("doc_id", "block", F.posexplode(F.split("text", " ")).alias("run", "text"))
    return rows.withColumn("run", F.col("run") + 1).withColumn("ends_section", F.col("block") % 4 == 0)


both(
    "wn05_offsets",
    lambda s, d: C.offsets(runs(s, d)).select("doc_id", "block", F.col("run").cast("long").alias("run"), "start", "stop", "section"),
    f"WITH {X.BLOCKS}, r AS (SELECT doc_id, block, unnest(string_split(text, ' ')) AS w, unnest(generate_series(1, len(string_split(text, ' ')))) AS run FROM blocks) SELECT doc_id, block, run, CAST(coalesce(sum(length(w)) OVER (PARTITION BY doc_id, block ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(w)) OVER (PARTITION BY doc_id, block ORDER BY run) AS BIGINT) AS stop, CAST((block - 1) // 4 AS BIGINT) AS section FROM r",
)
both(
    "wn11_toc",
    lambda s, d: C.toc(X.items(s, d)),
    with_items(" SELECT doc_id, string_agg(repeat('  ', CAST(right(field_id, 1) AS INT) - 1) || value, chr(10) ORDER BY block) AS outline, count(*) AS entries FROM items WHERE field_id LIKE 'body.heading.outline%' GROUP BY doc_id"),
)
both(
    "wn12_plan_batches",
    lambda s, d: C.plan_batches(X.items(s, d), 8, 900).select("doc_id", "block", "size", "batch"),
    with_items(""", n AS (SELECT doc_id, block, octet_length(encode(value)) AS size FROM items),
    f(doc_id, block, size, batch, n, bytes) AS (SELECT doc_id, block, size, 0::BIGINT, 1::BIGINT, size FROM n WHERE block = 1 UNION ALL
    SELECT n.doc_id, n.block, n.size, CASE WHEN f.n >= 8 OR f.bytes + n.size > 900 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 8 OR f.bytes + n.size > 900 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 8 OR f.bytes + n.size > 900 THEN n.size ELSE f.bytes + n.size END FROM f JOIN n ON n.doc_id = f.doc_id AND n.block = f.block + 1)
    SELECT doc_id, block, size, batch FROM f"""),
)
both(
    "wn13_batch_context",
    lambda s, d: C.batch_context(X.items(s, d).withColumn("batch", F.floor((F.col("block") - 1) / 5).cast("long"))),
    with_items(""", b AS (SELECT doc_id, block, (block - 1) // 5 AS batch FROM items), g AS (SELECT doc_id, batch, min(block) AS lo, max(block) AS hi, count(*) AS "primary" FROM b GROUP BY ALL)
    SELECT g.doc_id, g.batch, g."primary", (SELECT count(*) FROM b WHERE b.doc_id = g.doc_id AND b.batch <> g.batch AND b.block BETWEEN g.lo - 3 AND g.hi + 3) AS context FROM g"""),
)


def batched(spark, sf):
    """Items in batches of five, and relations of each with the third after it, some told by a batch that has neither."""
    rows = X.items(spark, sf).select("doc_id", "block", "object_id", F.floor((F.col("block") - 1) / 5).cast("long").alias("batch"))
    nxt = rows.select("doc_id", (F.col("block") - 3).alias("block"), F.col("object_id").alias("target_id"))
    relations = rows.join(nxt, ["doc_id", "block"]).select("doc_id", (F.col("batch") + F.col("block") % 3).alias("batch"), F.col("object_id").alias("source_id"), "target_id", F.lit("same_fact_as").alias("relation"))
    return rows, relations.unionByName(relations)


def merged(spark, sf):
    rows, relations = batched(spark, sf)
    again = rows.where("block % 5 = 1 and batch > 0").withColumn("batch", F.col("batch") - 1)
    own, kept = C.merge_batches(rows.unionByName(again), relations, rows)
    return own.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum("batch").alias("batches")).join(kept.groupBy("doc_id").agg(F.count("*").alias("relations")), "doc_id", "left")


both(
    "wn14_merge_batches",
    merged,
    with_items(""", r AS (SELECT doc_id, block, object_id, (block - 1) // 5 AS batch FROM items), k AS (SELECT a.doc_id, a.object_id AS s, b.object_id AS t FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.block = a.block + 3 WHERE a.batch + a.block % 3 IN (a.batch, b.batch))
    SELECT r.doc_id, count(*) AS items, CAST(sum(CASE WHEN block % 5 = 1 AND batch > 0 THEN batch - 1 ELSE batch END) AS BIGINT) AS batches, (SELECT nullif(count(*), 0) FROM k WHERE k.doc_id = r.doc_id) AS relations FROM r GROUP BY r.doc_id"""),
)


both(
    "wn14_dropped_relations",
    lambda s, d: C.dropped_relations(*reversed(batched(s, d))),
    with_items(", r AS (SELECT doc_id, block, (block - 1) // 5 AS batch FROM items), k AS (SELECT a.doc_id, a.batch + a.block % 3 AS batch, a.batch AS x, b.batch AS y FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.block = a.block + 3) SELECT doc_id, batch, 2 * count(*) AS relations, 2 * count(*) FILTER (batch NOT IN (x, y)) AS dropped FROM k GROUP BY ALL"),
)


def located(spark, sf):
    rows = X.items(spark, sf).where("block % 4 > 0").select("doc_id", F.concat(F.lit("/body/p["), F.col("block").cast("string"), F.lit("]")).alias("locator"))
    every = X.items(spark, sf).select("doc_id", F.concat(F.lit("/body/p["), F.col("block").cast("string"), F.lit("]/r["), (F.col("block") % 3).cast("string"), F.lit("]/t")).alias("locator"))
    return every, rows.unionByName(rows.where("doc_id % 2 = 0").withColumn("locator", F.concat("locator", F.lit("/r[1]"))))


both(
    "jn01_attach_to_host",
    lambda s, d: C.attach_to_host(*located(s, d)).select("doc_id", "locator", "host_locator"),
    with_items(""", c AS (SELECT doc_id, '/body/p[' || block || ']/r[' || block % 3 || ']/t' AS locator FROM items), h AS (SELECT doc_id, '/body/p[' || block || ']' AS host FROM items WHERE block % 4 > 0 UNION ALL SELECT doc_id, '/body/p[' || block || ']/r[1]' FROM items WHERE block % 4 > 0 AND doc_id % 2 = 0)
    SELECT c.doc_id, locator, arg_max(host, length(host)) AS host_locator FROM c JOIN h ON h.doc_id = c.doc_id AND starts_with(locator, host || '/') GROUP BY ALL"""),
)
both(
    "fn25_inline_components",
    lambda s, d: C.inline_components(X.blocks(s, d).withColumn("children", F.filter(F.array(F.lit("image"), F.lit("table")), lambda x, i: i < F.col("block") % 3))).withColumn("inline", F.col("inline").cast("long")),
    f"WITH {X.BLOCKS}, p AS (SELECT doc_id, block, list_concat(['image', 'table'][1:block % 3], CASE WHEN trim(text) <> '' THEN [text] ELSE [] END) AS c FROM blocks) SELECT doc_id, block, unnest(generate_series(0, len(c) - 1)) AS \"inline\", unnest(c) AS component FROM p",
)


def units(spark, sf):
    rows = X.table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("u"))
    return rows.select(F.col("doc_id").alias("unit_doc"), F.col("u").cast("long").alias("unit_id"), (F.col("u") * 6).alias("block_start"), (F.col("u") * 6 + 4 + F.col("doc_id") % 3).alias("block_end"))


both(
    "jn37_assign_units",
    lambda s, d: C.assign_units(X.blocks(s, d), units(s, d)),
    f"WITH {X.BLOCKS} SELECT doc_id, block, min(u) AS unit_id, count(u) AS units FROM blocks LEFT JOIN range(0, 10) t(u) ON block BETWEEN u * 6 AND u * 6 + 4 + doc_id % 3 GROUP BY ALL",
)
both(
    "st01_lost_content",
    lambda s, d: C.lost_content(X.blocks(s, d), X.blocks(s, d).where("(doc_id + block) % 7 > 0").select("doc_id", F.when(F.col("block") % 9 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))),
    f"WITH {X.BLOCKS} SELECT doc_id, count(*) AS lost FROM (SELECT doc_id, text FROM blocks EXCEPT ALL SELECT doc_id, CASE WHEN block % 9 = 0 THEN upper(text) ELSE text END FROM blocks WHERE (doc_id + block) % 7 > 0) GROUP BY doc_id",
)
both(
    "st03_set_closure",
    lambda s, d: C.set_closure(X.items(s, d).select("object_id"), X.gold(s, d).select(F.when(F.col("doc_id") % 31 == 0, F.upper("object_id")).otherwise(F.col("object_id")).alias("object_id")), "object_id"),
    f"WITH {X.GOLD}, b AS (SELECT CASE WHEN doc_id % 31 = 0 THEN upper(object_id) ELSE object_id END AS object_id FROM gold) (SELECT object_id, 'missing' AS code FROM (SELECT object_id FROM items EXCEPT SELECT object_id FROM b)) UNION ALL (SELECT object_id, 'extra' FROM (SELECT object_id FROM b EXCEPT SELECT object_id FROM items))",
)


def patches(spark, sf):
    return X.blocks(spark, sf).select("doc_id", "block", F.lit("th").alias("old"), F.lit("TH").alias("new"), (F.col("block") % 4).alias("expected"))


both(
    "fn22_apply_patches",
    lambda s, d: C.apply_patches(X.blocks(s, d), patches(s, d)),
    f"WITH {X.BLOCKS}, n AS (SELECT *, (length(text) - length(replace(text, 'th', ''))) // 2 AS found FROM blocks) SELECT doc_id, block, found, CASE WHEN found = block % 4 THEN 'applied' ELSE 'count_differs' END AS code, sha256(text) AS before_sha256, CASE WHEN found = block % 4 THEN sha256(replace(text, 'th', 'TH')) END AS after_sha256 FROM n",
)
both(
    "src06_verify_hashes",
    lambda s, d: C.verify_hashes(X.table(s, d, "documents").where("doc_id % 7 > 0").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.sha2("text", 256).alias("sha256")), X.table(s, d, "documents").where("doc_id % 5 > 0").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))),
    "SELECT 'doc-' || doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'undeclared' WHEN doc_id % 3 = 0 THEN 'mismatch' ELSE 'verified' END AS status FROM documents WHERE doc_id % 35 > 0",
)
both(
    "jn35_audit_presence",
    lambda s, d: C.audit_presence(X.blocks(s, d), X.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 50, 100_000_000)).otherwise(F.upper("text")).alias("final_text")), T.norm_text),
    f"WITH {X.BLOCKS} SELECT b.doc_id, b.block FROM blocks b JOIN documents d USING (doc_id) WHERE NOT contains({norm_sql('CASE WHEN d.doc_id % 3 = 0 THEN substr(d.text, 50) ELSE upper(d.text) END')}, {norm_sql('b.text')})",
)


def surfaces(spark, sf):
    return X.table(spark, sf, "documents").select(F.lit("documents").alias("surface"), "text").unionByName(X.table(spark, sf, "conversations").select(F.lit("conversations").alias("surface"), "text"))


def complex_counts(s, d, seen):
    kinds = {"images": F.col("block") % 7 == 6, "equations": F.col("block") % 11 == 3, "tables": F.col("block") % 13 == 5}
    return X.blocks(s, d).groupBy("doc_id").agg(*[F.count_if(which & seen).alias(c) for c, which in kinds.items()])


COUNTED = "SELECT doc_id, count(*) FILTER (block % 7 = 6 AND {0}) AS images, count(*) FILTER (block % 11 = 3 AND {0}) AS equations, count(*) FILTER (block % 13 = 5 AND {0}) AS tables FROM blocks {1} GROUP BY doc_id"
both(
    "jn35_audit_shortfalls",
    lambda s, d: C.audit_shortfalls(complex_counts(s, d, F.lit(True)), complex_counts(s, d, F.col("block") % 4 > 0).where("doc_id % 9 > 0").withColumn("tables", F.col("tables") + 1)),
    f"WITH {X.BLOCKS}, a AS ({COUNTED.format('true', '')}), b AS ({COUNTED.format('block % 4 > 0', 'WHERE doc_id % 9 > 0')}), x AS (SELECT a.doc_id, greatest(0, a.images - coalesce(b.images, 0)) AS missing_images, greatest(0, a.equations - coalesce(b.equations, 0)) AS missing_equations, greatest(0, a.tables - coalesce(b.tables + 1, 0)) AS missing_tables FROM a LEFT JOIN b USING (doc_id)) SELECT *, missing_images + missing_equations + missing_tables AS missing_complex FROM x",
)
both(
    "jn36_leak_scan",
    lambda s, d: C.leak_scan(X.table(s, d, "benchmark").select(F.col("item_id").alias("canary_id"), F.substring("text", 1, 60).alias("text")), surfaces(s, d), ["documents", "conversations"]),
    "WITH s AS (SELECT 'documents' AS surface, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) SELECT item_id AS canary_id, u.surface, (SELECT count(*) FROM s WHERE s.surface = u.surface AND contains(s.text, substr(b.text, 1, 60))) AS hits FROM benchmark b, (VALUES ('documents'), ('conversations')) u(surface)",
)
both(
    "src01_html_blocks",
    lambda s, d: read_blocks(X.table(s, d, "pages").select("page_id", "html"), "html", "html"),
    "WITH e AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h1|p|li)\\b[^>]*>(.*?)</(h1|p|li)>', 0) AS x FROM pages), r AS (SELECT page_id, unnest(generate_series(1, len(x))) AS block, unnest(x) AS el FROM e) SELECT page_id, block, lower(regexp_extract(el, '(?is)<(h1|p|li)\\b[^>]*>(.*?)</(h1|p|li)>', 1)) AS tag, regexp_replace(regexp_extract(el, '(?is)<(h1|p|li)\\b[^>]*>(.*?)</(h1|p|li)>', 2), '<[^>]*>', '', 'g') AS text FROM r",
)
