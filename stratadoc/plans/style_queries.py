"""Queries of styles, graphs and pages over parts, order lines and page words, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content as C
from ..operators import pages as P
from ..operators import styles as S
from ..sources import fixtures as X
from ..sources.blocks import read_blocks
from .text_queries import norm_sql

QUERIES, ORACLES = {}, {}


def both(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def styles(s, d):
    """Styles made of parts: the parent is a third of the key; two form a cycle, one lacks its parent, some change type."""
    k = F.col("p_partkey")
    return X.table(s, d, "part").select(k.alias("style_id"), F.when(k == 10, F.lit(11)).when(k == 11, F.lit(10)).when(k == 20, F.lit(-5)).when(k > 3, F.floor(k / 3)).cast("long").alias("based_on"), F.when(k % 41 == 40, "character").otherwise("paragraph").alias("style_type"))


STYLES = """WITH RECURSIVE st AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey = 10 THEN 11 WHEN p_partkey = 11 THEN 10 WHEN p_partkey = 20 THEN -5 WHEN p_partkey > 3 THEN p_partkey // 3 END AS based_on, CASE WHEN p_partkey % 41 = 40 THEN 'character' ELSE 'paragraph' END AS style_type FROM part),
ch(style_id, ancestor, depth, nxt, type, path, reason) AS (SELECT style_id, style_id, 0, based_on, style_type, [style_id], NULL::VARCHAR FROM st UNION ALL
SELECT c.style_id, c.nxt, c.depth + 1, CASE WHEN list_contains(c.path, c.nxt) OR s.style_id IS NULL OR s.style_type <> c.type THEN NULL ELSE s.based_on END, c.type, list_append(c.path, c.nxt), CASE WHEN list_contains(c.path, c.nxt) THEN 'cycle' WHEN s.style_id IS NULL THEN 'missing' WHEN s.style_type <> c.type THEN 'wrong_type' END
FROM ch c LEFT JOIN st s ON s.style_id = c.nxt WHERE c.nxt IS NOT NULL AND c.reason IS NULL)"""
both("rc01_style_chain", lambda s, d: S.style_chain(styles(s, d)), STYLES + " SELECT style_id, ancestor, depth, reason FROM ch")


def props(s, d):
    p = X.table(s, d, "part")
    return p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("style_id"), F.lit("size").alias("path"), F.col("p_size").cast("string").alias("value")).unionByName(p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("style_id"), F.lit("brand").alias("path"), F.col("p_brand").alias("value")))


both(
    "rc03_resolve_chain",
    lambda s, d: S.resolve_chain(S.style_chain(styles(s, d)), props(s, d)),
    STYLES + ", pr AS (SELECT p_partkey AS style_id, 'size' AS path, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 = 0) SELECT c.style_id, pr.path, arg_min(value, depth) AS value, arg_min(ancestor, depth) AS source FROM ch c JOIN pr ON pr.style_id = c.ancestor WHERE reason IS NULL AND c.style_id NOT IN (SELECT style_id FROM ch WHERE reason = 'cycle') GROUP BY c.style_id, pr.path",
)


def outlined(s, d):
    """Blocks with styles of parts; every fifth says its own level, every fourth part has one, and some are named as headings."""
    key, block = F.col("p_partkey"), F.col("block")
    own = X.table(s, d, "part").select(key.alias("style_id"), F.when(key % 4 == 0, F.when(key % 12 == 8, "x").otherwise((key % 5).cast("string"))).alias("outline"), F.when(key % 3 == 1, F.concat(F.lit("Heading "), (key % 5).cast("string"))).otherwise(F.lit("plain")).alias("name"))
    rows = X.blocks(s, d).select("doc_id", "block", F.lit(0).alias("inline"), F.col("text").alias("value"), F.when(block % 5 == 0, (block % 4).cast("string")).alias("outline"), (F.col("doc_id") + block).alias("style_id"))
    return S.outline_levels(rows, styles(s, d).join(own, "style_id"))


OUTLINED = STYLES + """, oz AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 12 = 8 THEN 'x' ELSE CAST(p_partkey % 5 AS VARCHAR) END END AS o, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 5 BETWEEN 1 AND 3 THEN p_partkey % 5 - 1 END AS named FROM part),
    ih AS (SELECT c.style_id, TRY_CAST(arg_min(o, depth) FILTER (o IS NOT NULL) AS INT) AS lv, max(named) FILTER (depth = 0) AS named FROM ch c JOIN oz ON oz.id = c.ancestor WHERE c.reason IS NULL AND c.style_id NOT IN (SELECT style_id FROM ch WHERE reason = 'cycle') GROUP BY c.style_id),
    """ + X.BLOCKS + """, lv AS (SELECT doc_id, block, text, CASE WHEN block % 5 = 0 THEN block % 4 ELSE coalesce(ih.lv, ih.named) END AS level, CASE WHEN block % 5 = 0 THEN 'paragraph_outline_level' WHEN ih.lv IS NOT NULL THEN 'paragraph_style_outline_level' ELSE 'built_in_heading_style' END AS source FROM blocks LEFT JOIN ih ON ih.style_id = doc_id + block)"""
both("wn11_outline_levels", lambda s, d: outlined(s, d).select("doc_id", "block", F.col("level").cast("long").alias("level"), "source"), OUTLINED + " SELECT doc_id, block, level, source FROM lv WHERE level BETWEEN 0 AND 2")
both("wn11_outline_tree", lambda s, d: C.outline_tree(outlined(s, d).withColumn("level", F.col("level") + 1)), OUTLINED + " SELECT doc_id, string_agg(repeat('  ', CAST(level AS INT)) || text, chr(10) ORDER BY block) AS outline, count(*) AS entries FROM lv WHERE level BETWEEN 0 AND 2 GROUP BY doc_id")


def preset_values(s, d):
    p, key = X.table(s, d, "part"), F.col("p_partkey")
    size = F.when(key % 5 == 0, "${size}").when(key % 5 == 1, "none").otherwise(F.col("p_size").cast("string"))
    row = lambda of, path, value: p.where(of).select(key.alias("role_id"), (key % 4 == 0).alias("overrides"), F.lit(path).alias("path"), value.alias("value"))
    return row("p_partkey % 2 = 0", "font.size", size).unionByName(row("p_partkey % 3 = 0", "font.name", F.col("p_brand")))


def presets(s, d):
    """Roles of parts, of two types of which one has no profile."""
    roles = styles(s, d).select(F.col("style_id").alias("role_id"), F.col("style_type").alias("role_type"), "based_on")
    profiles = s.createDataFrame([("paragraph", "font.size", "10"), ("paragraph", "font.name", "N/A")], "role_type string, path string, value string")
    required = s.createDataFrame([("paragraph", "font.size"), ("paragraph", "font.name"), ("character", "font.size")], "role_type string, path string")
    return S.resolve_roles(roles, preset_values(s, d), profiles, required, s.createDataFrame([("size", "12")], "name string, value string"))


both(
    "rc03_resolve_roles",
    lambda s, d: presets(s, d)[0].select("role_id", "path", "state", "value"),
    STYLES + """, pv AS (SELECT p_partkey AS role_id, p_partkey % 4 = 0 AS ov, 'font.size' AS path, CASE p_partkey % 5 WHEN 0 THEN '12' WHEN 1 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_partkey % 4 = 0, 'font.name', p_brand FROM part WHERE p_partkey % 3 = 0),
    rk AS (SELECT c.style_id AS role_id, v.path, arg_min(v.value, 2 * c.depth + CASE WHEN v.ov THEN 0 ELSE 1 END) AS value FROM ch c JOIN pv v ON v.role_id = c.ancestor WHERE c.reason IS NULL GROUP BY ALL),
    ok AS (SELECT style_id AS role_id FROM st WHERE style_type = 'paragraph' AND style_id NOT IN (SELECT style_id FROM ch WHERE reason IS NOT NULL)),
    a AS (SELECT role_id, path, coalesce(rk.value, base) AS v FROM ok CROSS JOIN (VALUES ('font.size', '10'), ('font.name', 'N/A')) x(path, base) LEFT JOIN rk USING (role_id, path))
    SELECT role_id, path, CASE v WHEN 'N/A' THEN 'N/A' WHEN 'none' THEN 'NONE' ELSE 'VALUE' END AS state, CASE WHEN v NOT IN ('N/A', 'none') THEN v END AS value FROM a""",
)
both(
    "rc03_role_violations",
    lambda s, d: presets(s, d)[1].select("role_id", "code", "detail"),
    STYLES + " SELECT style_id AS role_id, CASE reason WHEN 'cycle' THEN 'role_cycle' WHEN 'missing' THEN 'role_missing' ELSE 'type_mismatch' END AS code, CAST(ancestor AS VARCHAR) AS detail FROM ch WHERE reason IS NOT NULL UNION ALL SELECT style_id, 'profile_missing', 'character' FROM st WHERE style_type = 'character'",
)


def layers(s, d):
    return X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("occurrence_id"), F.when(F.col("l_suppkey") % 2 == 0, "bold").otherwise("size").alias("path"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).cast("long").alias("rank"), F.when(F.col("l_suppkey") % 2 == 0, F.when(F.col("l_partkey") % 3 > 0, "true").otherwise("false")).otherwise(F.col("l_quantity").cast("long").cast("string")).alias("value"), (F.col("l_suppkey") % 2 == 0).alias("toggle"), (F.col("l_partkey") % 7 == 0).alias("direct"))


def in_effect(s, d):
    """Orders as occurrences of their customer's number as a style; styles of parts, a default size, and what some orders say themselves."""
    key = F.col("style_id")
    own = lambda rows, owner, layer, path, value, toggle: rows.select(F.lit(layer).alias("layer"), owner.cast("long").alias("owner"), F.lit("run").alias("part"), F.lit(path).alias("path"), value.alias("value"), F.lit(toggle).alias("toggle"), F.lit(None).cast("map<int,string>").alias("tabs"))
    st, orders = styles(s, d), X.table(s, d, "orders")
    sizes = X.table(s, d, "part").select(F.col("p_partkey").alias("style_id"), "p_size")
    order = F.col("o_orderkey")
    properties = own(sizes.where("style_id % 2 = 0"), key, "style", "run.size", F.col("p_size").cast("string"), False).unionByName(own(st.where("style_id % 3 = 0"), key, "style", "run.bold", F.lit("true"), True))
    properties = properties.unionByName(own(orders.where("o_orderkey % 5 = 0"), order, "run_direct", "run.size", F.lit("99"), False)).unionByName(own(orders.where("o_orderkey % 7 = 0"), order, "paragraph_mark_direct", "run.bold", F.lit("false"), True))
    properties = properties.unionByName(own(s.range(1), F.lit(None), "doc_defaults", "run.size", F.lit("11"), False))
    occurrences = orders.select(order.alias("occurrence_id"), F.col("o_custkey").alias("paragraph_style"), F.lit(None).cast("long").alias("character_style"))
    return S.effective_styles(occurrences, st, properties)


both(
    "rc02_effective_styles",
    lambda s, d: in_effect(s, d).where("path in ('run.size', 'run.bold', 'run.color')").select("occurrence_id", "path", "value", F.size("trail").cast("long").alias("steps")),
    STYLES + """, good AS (SELECT c.* FROM ch c JOIN st ON st.style_id = c.style_id WHERE c.reason IS NULL AND st.style_type = 'paragraph' AND c.style_id NOT IN (SELECT style_id FROM ch WHERE reason = 'cycle')),
    z AS (SELECT g.style_id, arg_min(CAST(p_size AS VARCHAR), depth) FILTER (ancestor % 2 = 0) AS size, count(*) FILTER (ancestor % 2 = 0) AS sized, count(*) FILTER (ancestor % 3 = 0) AS bolds FROM good g JOIN part ON p_partkey = ancestor GROUP BY ALL),
    o AS (SELECT o_orderkey AS k, size, coalesce(sized, 0) AS sized, coalesce(bolds, 0) AS bolds FROM orders LEFT JOIN z ON z.style_id = o_custkey)
    SELECT k AS occurrence_id, 'run.size' AS path, CASE WHEN k % 5 = 0 THEN '99' ELSE coalesce(size, '11') END AS value, 1 + sized + CAST(k % 5 = 0 AS INT) AS steps FROM o
    UNION ALL SELECT k, 'run.bold', CASE WHEN k % 7 > 0 AND bolds % 2 = 1 THEN 'true' ELSE 'false' END, greatest(bolds + CAST(k % 7 = 0 AS INT), 1) FROM o
    UNION ALL SELECT k, 'run.color', 'auto', 1 FROM o""",
)
both(
    "rc02_cascade",
    lambda s, d: S.cascade(layers(s, d)).select("occurrence_id", "path", "value"),
    """WITH RECURSIVE l0 AS (SELECT DISTINCT l_orderkey AS occurrence_id, CASE WHEN l_suppkey % 2 = 0 THEN 'bold' ELSE 'size' END AS path, l_linenumber * 100000 + l_partkey AS rank, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_partkey % 3 > 0 THEN 'true' ELSE 'false' END ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value, l_suppkey % 2 = 0 AS toggle, l_partkey % 7 = 0 AS direct, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
    l AS (SELECT *, row_number() OVER (PARTITION BY occurrence_id, path ORDER BY rank, value) AS n FROM l0),
    f(occurrence_id, path, n, value) AS (SELECT occurrence_id, path, 0::BIGINT, NULL::VARCHAR FROM l GROUP BY ALL UNION ALL SELECT f.occurrence_id, f.path, l.n, CASE WHEN toggle AND NOT direct AND l.value = 'true' THEN CASE WHEN coalesce(f.value, 'false') = 'true' THEN 'false' ELSE 'true' END WHEN toggle AND NOT direct THEN coalesce(f.value, l.value) ELSE l.value END FROM f JOIN l ON l.occurrence_id = f.occurrence_id AND l.path = f.path AND l.n = f.n + 1)
    SELECT occurrence_id, path, arg_max(value, n) AS value FROM f GROUP BY ALL""",
)


def edges(s, d):
    li = X.table(s, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), (F.col("l_suppkey") % 9 == 0).alias("external"))
    sn = X.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit(False).alias("external"))
    nr = X.table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit(False).alias("external"))
    return li.unionByName(sn).unionByName(nr)


EDGES = "WITH RECURSIVE ed AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_suppkey % 9 = 0 AS ext FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, false FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, false FROM nation)"


def seeds(s, d):
    return X.table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))


REACHED = EDGES + ", re(node) AS (SELECT 'p' || p_partkey FROM part UNION SELECT ed.dst FROM re JOIN ed ON ed.src = re.node WHERE NOT ext)"
both("rc05_reachable", lambda s, d: S.reachable(seeds(s, d), edges(s, d), edges(s, d).select(F.col("src").alias("node")))[0], REACHED + " SELECT node FROM re")
both("rc05_missing_targets", lambda s, d: S.reachable(seeds(s, d), edges(s, d), edges(s, d).select(F.col("src").alias("node")))[1], REACHED + " SELECT node FROM re WHERE node NOT IN (SELECT src FROM ed)")
both(
    "rc04_find_cycles",
    lambda s, d: S.find_cycles(styles(s, d).where("based_on is not null").select(F.col("style_id").alias("src"), F.col("based_on").alias("dst"))),
    STYLES + ", up(style_id, a) AS (SELECT style_id, based_on FROM st WHERE based_on IS NOT NULL UNION SELECT up.style_id, st.based_on FROM up JOIN st ON st.style_id = up.a WHERE st.based_on IS NOT NULL) SELECT DISTINCT style_id AS node FROM up WHERE a = style_id",
)


def role_tables(s, d):
    p = X.table(s, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("role"), F.sha2(F.col("p_name"), 256).alias("digest"), F.split("p_name", " ").alias("properties"), "p_partkey")
    return p.select("role"), p.where("p_partkey % 2 = 0").withColumn("complete", F.col("p_partkey") % 4 == 0), p.where("p_partkey % 3 = 0").withColumn("complete", F.col("p_partkey") % 9 > 0).withColumn("digest", F.upper("digest"))


both(
    "jn21_select_roles",
    lambda s, d: S.select_roles(*role_tables(s, d)).select("role", "origin", "digest", F.when(F.col("origin") != "none", F.col("properties")).cast("long").alias("properties")),
    "SELECT 'r' || p_partkey AS role, CASE WHEN p_partkey % 4 = 0 THEN 'school' WHEN p_partkey % 3 = 0 AND p_partkey % 9 > 0 THEN 'preset' ELSE 'none' END AS origin, CASE WHEN p_partkey % 4 = 0 THEN sha256(p_name) WHEN p_partkey % 3 = 0 AND p_partkey % 9 > 0 THEN upper(sha256(p_name)) END AS digest, CASE WHEN p_partkey % 4 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 9 > 0) THEN len(string_split(p_name, ' ')) END AS properties FROM part",
)


def closures(s, d):
    r = X.table(s, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("role"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("path"), "p_partkey")
    p = r.where("p_partkey % 3 > 0 or path <> 'b'").select("role", "path", F.when(F.col("p_partkey") % 4 == 0, "NONE").otherwise("VALUE").alias("state"))
    return p, r.where("p_partkey % 5 > 0 or path <> 'c'").select("role", "path", (F.col("path") == "a").alias("allow_none"))


both(
    "jn22_check_closure",
    lambda s, d: S.check_closure(*closures(s, d)),
    "WITH r AS (SELECT 'r' || p_partkey AS role, unnest(['a', 'b', 'c']) AS path, p_partkey AS k FROM part), x AS (SELECT role, path, CASE WHEN NOT (k % 3 > 0 OR path <> 'b') THEN 'missing' WHEN NOT (k % 5 > 0 OR path <> 'c') THEN 'extra' WHEN k % 4 = 0 AND path <> 'a' THEN 'state_not_allowed' END AS code FROM r) SELECT * FROM x WHERE code IS NOT NULL",
)


def occurrences(s, d):
    f = X.items(s, d).where("status = 'classified'").select("doc_id", "block", F.when(F.col("block") % 5 == 0, "references").otherwise(F.col("field_id")).alias("role"))
    refs = s.createDataFrame([("body.figure", "st1"), ("body.paragraph", "st2"), ("references", "st3")], "role string, style_ref string")
    return S.build_occurrences(f, f.where("block % 5 = 0 or block % 7 = 6"), refs)


both(
    "jn24_build_occurrences",
    occurrences,
    f"WITH {X.ITEMS}, f AS (SELECT doc_id, block, CASE WHEN block % 5 = 0 THEN 'references' ELSE field_id END AS role FROM items WHERE status = 'classified'), o AS (SELECT doc_id, role, 'fill:' || block AS occurrence_id FROM f WHERE role <> 'references' UNION ALL SELECT doc_id, role, 'projection:' || role || ':' || row_number() OVER (PARTITION BY doc_id, role ORDER BY block) FROM f WHERE block % 5 = 0 OR block % 7 = 6) SELECT doc_id, role, occurrence_id, CASE role WHEN 'body.figure' THEN 'st1' WHEN 'body.paragraph' THEN 'st2' WHEN 'references' THEN 'st3' END AS style_ref FROM o",
)
both(
    "jn25_fill_missing_roles",
    lambda s, d: S.fill_missing_roles(X.items(s, d).where("field_id is not null").select("doc_id", F.col("field_id").alias("role"), F.lit("OBSERVED").alias("state")).distinct(), X.table(s, d, "documents").select("doc_id", F.explode(F.array(F.lit("body.figure"), F.lit("body.heading.outline3"))).alias("role"))),
    f"WITH {X.ITEMS}, o AS (SELECT DISTINCT doc_id, field_id AS role FROM items WHERE field_id IS NOT NULL) SELECT doc_id, role, 'OBSERVED' AS state FROM o UNION ALL SELECT e.doc_id, e.role, 'MISSING' FROM (SELECT doc_id, unnest(['body.figure', 'body.heading.outline3']) AS role FROM documents) e ANTI JOIN o ON o.doc_id = e.doc_id AND o.role = e.role",
)
both(
    "ag28_actual_roles",
    lambda s, d: S.actual_roles({"content": X.items(s, d).where("block % 3 = 0 and field_id is not null").select("doc_id", F.col("field_id").alias("role")), "retained": X.items(s, d).where("block % 2 = 0 and field_id is not null").select("doc_id", F.col("field_id").alias("role"))}),
    f"WITH {X.ITEMS}, r AS (SELECT doc_id, field_id AS role, 'content' AS source FROM items WHERE block % 3 = 0 AND field_id IS NOT NULL UNION ALL SELECT doc_id, field_id, 'retained' FROM items WHERE block % 2 = 0 AND field_id IS NOT NULL) SELECT doc_id, role, list_sort(list(DISTINCT source)) AS sources FROM r GROUP BY ALL",
)
both(
    "fn26_canonical_props",
    lambda s, d: S.canonical_props(X.table(s, d, "part").select(F.col("p_partkey").alias("owner"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("font_a"), F.when(F.col("p_partkey") % 5 > 0, F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise("other")).alias("font_b"), F.substring(F.md5(F.col("p_name")), 1, (F.col("p_partkey") % 2 + 5).cast("int")).alias("colour"), F.element_at(F.array(F.lit("auto"), F.lit("exact"), F.lit("atLeast")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("line_rule"), (F.col("p_size").cast("int") * 60).alias("line"), (F.col("p_size").cast("int") % 12).alias("outline"))),
    "WITH p AS (SELECT p_partkey AS owner, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS a, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'other' END END AS b, substr(md5(p_name), 1, p_partkey % 2 + 5) AS c, ['auto', 'exact', 'atLeast'][p_partkey % 3 + 1] AS r, CAST(p_size AS INT) * 60 AS l, CAST(p_size AS INT) % 12 AS o FROM part) SELECT owner, CASE WHEN a = b THEN a END AS font, CASE WHEN a <> b THEN 'conflict' WHEN a IS NULL THEN 'missing' ELSE 'value' END AS font_state, CASE WHEN length(c) = 6 THEN '#' || upper(c) END AS colour, CASE WHEN r = 'auto' THEN CASE WHEN l = 240 THEN 'single' ELSE 'multiple' END WHEN r = 'exact' THEN 'exact_pt' ELSE 'at_least_pt' END AS spacing, CASE WHEN r = 'auto' THEN l / 240 ELSE l / 20 END AS spacing_value, CASE WHEN o < 9 THEN o + 1 END AS outline_level FROM p",
)


def words(s, d):
    rows = read_blocks(X.table(s, d, "pages").select("page_id", "html"), "html", "html")
    each = rows.select("page_id", "block", F.posexplode(F.split("text", " ")).alias("k", "text"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("block", "k"))
    return each.withColumn("word_no", n.cast("long")).select("page_id", "word_no", "text", (F.col("word_no") % 10 * 50).cast("double").alias("x0"), (F.col("word_no") % 10 * 50 + 5 * F.length("text")).cast("double").alias("x1"))


WORDS = "WITH e AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h1|p|li)\\b[^>]*>(.*?)</(h1|p|li)>', 2) AS x FROM pages), bl AS (SELECT page_id, unnest(generate_series(1, len(x))) AS block, regexp_replace(unnest(x), '<[^>]*>', '', 'g') AS text FROM e), wd AS (SELECT page_id, block, unnest(generate_series(1, len(string_split(text, ' ')))) AS k, unnest(string_split(text, ' ')) AS text FROM bl), w AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block, k) AS word_no, text FROM wd), wx AS (SELECT *, (word_no % 10 * 50)::DOUBLE AS x0, (word_no % 10 * 50 + 5 * length(text))::DOUBLE AS x1 FROM w)"


def targets(s, d):
    w = words(s, d).where("word_no in (7, 8, 9)")
    between = F.when(F.col("page_id") % 2 == 0, " ").otherwise("")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"])
    return w.groupBy("page_id").agg(texts.alias("t")).select("page_id", F.array_join(F.transform("t", lambda x: F.concat(x, between)), "").alias("target"), F.lit(1).alias("target_id"))


SPANS = WORDS + f", n AS (SELECT *, {norm_sql('text')} AS nm FROM wx), tg AS (SELECT page_id, string_agg(nm, '' ORDER BY word_no) AS goal, page_id % 2 = 1 AS tight, string_agg(text, '' ORDER BY word_no) AS raw FROM n WHERE word_no IN (7, 8, 9) GROUP BY page_id), ru AS (SELECT a.page_id, a.word_no AS first_word, b.word_no AS last_word FROM n a JOIN n b ON b.page_id = a.page_id AND b.word_no BETWEEN a.word_no AND a.word_no + 12 WHERE b.nm <> ''), sp AS (SELECT ru.page_id, first_word, last_word, string_agg(nm, '' ORDER BY word_no) AS joined, string_agg(text, '' ORDER BY word_no) AS said, min(x0) AS \"left\", max(x1) AS \"right\" FROM ru JOIN n ON n.page_id = ru.page_id AND n.word_no BETWEEN first_word AND last_word GROUP BY ALL)"
both("jn31_locate_text", lambda s, d: P.locate_text(words(s, d), targets(s, d), T.norm_text), SPANS + " SELECT page_id, 1 AS target_id, first_word, last_word, \"left\", \"right\", CASE WHEN tight AND said = raw THEN 'exact_text' ELSE 'normalized_text' END AS quality FROM sp JOIN tg USING (page_id) WHERE joined = goal AND goal <> ''")


def repeated(s, d):
    hits = words(s, d).where("text <> ''").withColumn("target_id", F.lower("text")).select("page_id", "target_id", F.col("word_no").alias("first_word"), F.col("word_no").alias("last_word"))
    context = words(s, d).where("word_no in (3, 40)").select("page_id", F.when(F.col("word_no") == 3, "before").otherwise("after").alias("side"), F.col("word_no").alias("context_word"))
    return P.disambiguate(hits, hits.select("page_id", "target_id").distinct().join(context, "page_id"))


both(
    "jn32_disambiguate",
    repeated,
    WORDS + ", h AS (SELECT page_id, lower(text) AS target_id, word_no FROM w WHERE text <> ''), sc AS (SELECT h.*, (SELECT count(*) FROM w c WHERE c.page_id = h.page_id AND ((c.word_no = 3 AND 3 < h.word_no) OR (c.word_no = 40 AND 40 > h.word_no))) AS score FROM h), b AS (SELECT *, max(score) OVER (PARTITION BY page_id, target_id) AS top FROM sc) SELECT page_id, target_id, word_no AS first_word, word_no AS last_word, score FROM b WHERE score = top AND score > 0 QUALIFY count(*) OVER (PARTITION BY page_id, target_id) = 1",
)
def gaps(s, d):
    """An object of each page between its words 3 and 40, wherever such words are; lines of five words."""
    w = words(s, d).withColumn("y0", F.floor((F.col("word_no") - 1) / 5).cast("double")).withColumn("y1", F.col("y0") + 1)
    side = lambda n, name: w.where(F.col("word_no") == n).select("page_id", F.col("text").alias("said"), F.lit(name).alias("side"))
    context = side(3, "before").unionByName(side(40, "after"))
    boxes = w.join(context, "page_id").where("text = said").select(F.col("page_id").alias("object_id"), (F.col("word_no") > 60).cast("int").alias("page"), "side", "x0", "y0", "x1", "y1")
    return P.locate_gaps(X.table(s, d, "pages").select(F.col("page_id").alias("object_id")), boxes)


both(
    "jn32_locate_gaps",
    gaps,
    WORDS + ", y AS (SELECT *, (word_no - 1) // 5 AS y0, CAST(word_no > 60 AS INT) AS page FROM wx), c AS (SELECT page_id, text, word_no FROM w WHERE word_no IN (3, 40)), b AS (SELECT y.* FROM y JOIN c USING (page_id, text) WHERE c.word_no = 3), a AS (SELECT y.* FROM y JOIN c USING (page_id, text) WHERE c.word_no = 40), g AS (SELECT b.page_id, b.page, least(b.x0, a.x0) AS x0, b.y0 + 1.0 AS y0, greatest(b.x1, a.x1) AS x1, a.y0::DOUBLE AS y1 FROM b JOIN a ON a.page_id = b.page_id AND a.page = b.page AND b.y0 + 1 <= a.y0), o AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY page_id) = 1) SELECT p.page_id AS object_id, o.page, o.x0, o.y0, o.x1, o.y1 FROM pages p LEFT JOIN o USING (page_id)",
)
both(
    "jn33_objects_on_page",
    lambda s, d: P.objects_on_page(X.items(s, d).select("doc_id", F.concat(F.lit("/p["), F.floor(F.col("block") / 4).cast("string"), F.lit("]/r["), F.col("block").cast("string"), F.lit("]")).alias("locator")), X.table(s, d, "documents").select("doc_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("page")).withColumn("locator", F.concat(F.lit("/p["), F.col("page").cast("string"), F.lit("]"))), 3),
    f"WITH {X.ITEMS}, o AS (SELECT doc_id, block // 4 AS page, '/p[' || block // 4 || ']/r[' || block || ']' AS locator FROM items WHERE block // 4 IN (1, 2)) SELECT doc_id, page, locator, count(*) OVER (PARTITION BY doc_id, page) > 3 AS overflow FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY locator) <= 3",
)
both(
    "ag30_page_coverage",
    lambda s, d: P.page_coverage(X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 5 + 1).alias("page"), (F.col("l_suppkey") % 13 == 0).alias("blocking")), X.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4 + 1).alias("pages"))),
    "WITH r AS (SELECT o_orderkey AS doc_id, o_custkey % 4 + 1 AS pages, list(DISTINCT l_partkey % 5 + 1) FILTER (l_partkey IS NOT NULL) AS seen, bool_or(l_suppkey % 13 = 0) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT doc_id, CAST(len(list_filter(generate_series(1, pages), lambda p: NOT coalesce(list_contains(seen, p), false))) AS BIGINT) AS unseen, CAST(coalesce(len(list_filter(seen, lambda p: p > pages)), 0) AS BIGINT) AS unknown, coalesce(b, false) AS blocked FROM r",
)
