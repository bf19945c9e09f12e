"""Queries of the text functions over lines of documents, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures as X

#: Words that a search passes over; fixed values.
STOP_WORDS = ["all", "available", "cover", "current", "field", "fields", "fillable", "list", "object", "page", "template"]
#: Search words and what they mean; fixed values.
ALIASES = {
    "college": "department", "student": "author", "supervisor": "advisor", "teacher": "advisor", "topic": "title", "作者": "author", "学生": "author", "学院": "department",
    "院系": "department", "指导教师": "advisor", "导师": "advisor", "职称": "advisor.title", "论文题目": "thesis.title", "题目": "title", "学号": "author.student_id", "专业": "author.major",
}


def trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{T.WS}+', ''), '{T.WS}+$', '')"


def norm_sql(x: str) -> str:
    return f"replace(lower(regexp_replace({x}, '{T.WS}', '', 'g')), 'ß', 'ss')"


def over_lines(columns):
    """A query over lines(): columns gives named columns of the text column."""
    return lambda spark, sf: X.lines(spark, sf).select("doc_id", "block", *[c.alias(k) for k, c in columns(F.col("text")).items()])


def lines_sql(**columns: str) -> str:
    return f"WITH {X.LINES} SELECT doc_id, block, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM lines"


QUERIES, ORACLES = {}, {}


def both(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


both("src01_blocks", lambda s, d: X.blocks(s, d).select("doc_id", "block", "text", F.sha2("text", 256).alias("text_sha256")), f"WITH {X.BLOCKS} SELECT doc_id, block, text, sha256(text) AS text_sha256 FROM blocks")
both("fn01_norm_text", over_lines(lambda t: dict(out=T.norm_text(t))), lines_sql(out=norm_sql("text")))
both("fn02_match_norm", over_lines(lambda t: dict(out=T.match_norm(t))), lines_sql(out=f"regexp_replace(replace(replace(text, '：', ':'), '□', ''), '{T.WS}', '', 'g')"))
both("fn03_leader_norm", over_lines(lambda t: dict(out=T.leader_norm(F.concat(t, F.lit("....… 9··· x……"))))), lines_sql(out="regexp_replace(" + norm_sql("text || '....… 9··· x……'") + r", '\.{3,}|…{2,}|·{3,}', '', 'g')"))
both(
    "fn04_values_equal",
    over_lines(lambda t: dict(same=T.values_equal(F.when(F.col("block") % 5 > 0, t), F.when(F.col("block") % 3 > 0, F.upper(t)).otherwise(F.when(F.col("block") % 2 == 0, F.concat(t, F.lit("x"))))))),
    lines_sql(same=f"{norm_sql('CASE WHEN block % 5 > 0 THEN text END')} IS NOT DISTINCT FROM {norm_sql('CASE WHEN block % 3 > 0 THEN upper(text) WHEN block % 2 = 0 THEN text || chr(120) END')}"),
)
SHAPE_SQL = (
    f"CASE WHEN regexp_matches({trim_sql('text')}, '{T.CHAPTER}') THEN 'chinese_chapter' WHEN regexp_matches({trim_sql('text')}, '{T.PARENTHESIZED}') THEN 'parenthesized_integer' "
    f"WHEN regexp_matches({trim_sql('text')}, '{T.ENUMERATION}') THEN 'chinese_enumeration' WHEN regexp_matches({trim_sql('text')}, '{T.DECIMAL}') "
    f"THEN 'decimal_' || least(4, 1 + len(regexp_extract_all(regexp_extract({trim_sql('text')}, '{T.DECIMAL}', 1), '\\.'))) || '_component' ELSE 'none' END"
)
both("fn05_numbering_shape", over_lines(lambda t: dict(shape=T.numbering_shape(t))), lines_sql(shape=SHAPE_SQL))
both(
    "fn06_script_lang",
    over_lines(lambda t: dict(a=T.script_lang(t), b=T.script_lang(F.when(F.col("block") % 4 == 0, F.concat(t, F.lit("\x0bx"))).otherwise(t), "vertical_tab"))),
    lines_sql(
        a=f"CASE WHEN regexp_matches(text, '{T.CJK}') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '{T.CJK}') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END",
        b=f"CASE WHEN block % 4 = 0 THEN 'mixed' WHEN regexp_matches(text, '{T.CJK}') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END",
    ),
)
both(
    "fn07_strip_label",
    over_lines(lambda t: dict(**{k: T.strip_label(t, k) for k in T.LABELS})),
    lines_sql(**{k: trim_sql(f"regexp_replace(text, '{v}', '')") for k, v in T.LABELS.items()}),
)
both(
    "fn08_caption",
    over_lines(lambda t: dict(title=T.caption_title(F.concat(t, F.lit("\x0b图 2 x"))), number=T.caption_number(t))),
    lines_sql(
        title=trim_sql(f"regexp_replace({trim_sql('text')}, '{T.CAPTION_PREFIX}', '')") + " || chr(11) || 'x'",
        number=f"CASE WHEN regexp_matches(text, '{T.CAPTION_NUMBER}') THEN trim(regexp_replace(regexp_extract(text, '{T.CAPTION_NUMBER}', 3), '\\s*[-－—–]\\s*', '-', 'g')) END",
    ),
)
both(
    "fn09_classify_block",
    over_lines(lambda t: dict(label=T.classify_block(t, F.when(F.col("block") % 31 == 0, "table").otherwise("paragraph"), F.when(F.col("block") % 17 == 0, "equation").otherwise("text")))),
    lines_sql(
        label=f"CASE WHEN block % 31 = 0 THEN 'body.table' WHEN block % 17 = 0 THEN 'body.equation' WHEN {trim_sql('text')} = '' THEN NULL WHEN regexp_matches({trim_sql('text')}, '{T.FIGURE}') THEN 'body.figure.caption' "
        f"WHEN regexp_matches({trim_sql('text')}, '{T.TABLE}') THEN 'body.table.caption' WHEN regexp_matches({trim_sql('text')}, '{T.CHAPTER}') THEN 'body.heading.level1' "
        f"WHEN length({trim_sql('text')}) <= 100 AND regexp_matches({trim_sql('text')}, '{T.THIRD}') THEN 'body.heading.level3' WHEN length({trim_sql('text')}) <= 80 AND regexp_matches({trim_sql('text')}, '{T.SECOND}') THEN 'body.heading.level2' "
        f"WHEN regexp_matches({trim_sql('text')}, '{T.PARENTHESIZED}') THEN 'body.numbered_list_item' ELSE 'body.paragraph' END"
    ),
)
both(
    "fn10_stable_id",
    over_lines(lambda t: dict(id=T.stable_id("content-", doc=F.col("doc_id"), block=F.col("block")))),
    lines_sql(id="""'content-' || substr(sha256('{"block":' || block || ',"doc":' || doc_id || '}'), 1, 24)"""),
)
both(
    "fn11_semantic_digest",
    over_lines(lambda t: dict(digest=T.semantic_digest(n=F.col("block") % 10, tags=T.as_set(F.array(F.lit("b"), F.lit("a"), (F.col("block") % 3).cast("string"), F.lit("b")))))),
    lines_sql(digest="""sha256('{"n":' || block % 10 || ',"tags":["' || block % 3 || '","a","b"]}')"""),
)
both(
    "fn12_office_units",
    lambda s, d: X.table(s, d, "part").select("p_partkey", T.half_points(F.col("p_size").cast("string")).alias("points"), T.twips(F.substring("p_name", 1, 3)).alias("none"), T.twips(F.col("p_partkey").cast("string")).alias("distance"), T.on_off(F.col("p_size") % 3 > 0, F.element_at(F.array(F.lit("0"), F.lit("OFF"), F.lit("on"), F.lit(None)), (F.col("p_size") % 4 + 1).cast("int"))).alias("flag")),
    "SELECT p_partkey, try_cast(p_size AS INT) / 2 AS points, try_cast(substr(p_name, 1, 3) AS INT) / 20 AS none, p_partkey / 20 AS distance, CASE WHEN p_size % 3 > 0 THEN CASE p_size % 4 WHEN 0 THEN false WHEN 1 THEN false ELSE true END END AS flag FROM part",
)
both(
    "fn15_contains_in_order",
    over_lines(lambda t: dict(found=T.contains_in_order(t, F.array(F.lit("an"), F.lit("th"), F.lit("er"))))),
    lines_sql(found="regexp_matches(text, '(?s)an.*?th.*?er')"),
)
both(
    "fn16_span_overlaps",
    over_lines(lambda t: dict(hit=T.span_overlaps(F.col("block") % 7, F.col("block") % 7 + F.col("block") % 3, F.col("doc_id") % 5, F.col("doc_id") % 5 + F.col("doc_id") % 4))),
    "WITH " + X.LINES + ", s AS (SELECT doc_id, block, block % 7 AS a, block % 7 + block % 3 AS b, doc_id % 5 AS c, doc_id % 5 + doc_id % 4 AS d FROM lines) SELECT doc_id, block, CASE WHEN a = b THEN c <= a AND a <= d WHEN c = d THEN a <= c AND c <= b ELSE a < d AND c < b END AS hit FROM s",
)
MIGRATED = {"body.figure": "body.image", "body.heading.outline1": "body.heading.level1"}
both(
    "fn20_migrate_fields",
    lambda s, d: X.items(s, d).select("doc_id", "block", T.migrated(F.col("field_id"), MIGRATED).alias("field_id"), F.transform(F.array("field_id", F.lit("body.figure")), lambda x: T.migrated(x, MIGRATED)).alias("listed")),
    f"WITH {X.ITEMS}, m AS (SELECT *, CASE field_id WHEN 'body.figure' THEN 'body.image' WHEN 'body.heading.outline1' THEN 'body.heading.level1' ELSE field_id END AS new FROM items) SELECT doc_id, block, new AS field_id, [new, 'body.image'] AS listed FROM m",
)
both(
    "fn21_search_terms",
    over_lines(lambda t: dict(terms=F.array_join(T.search_terms(F.concat(F.lit("Field 论文题目 Teacher "), t), STOP_WORDS, ALIASES), " "))),
    "WITH " + X.LINES + f", w AS (SELECT doc_id, block, list_filter(regexp_extract_all(lower('Field 论文题目 Teacher ' || text), '[a-z0-9]+|{T.CJK}+'), lambda x: x NOT IN ({', '.join(repr(x) for x in STOP_WORDS)})) AS raw FROM lines), "
    "e AS (SELECT doc_id, block, unnest(raw) AS term, unnest(generate_series(1, len(raw))) AS i FROM w), "
    "a(src, dst, n) AS (VALUES " + ", ".join(f"('{k}', '{v}', {n})" for n, (k, v) in enumerate(sorted(ALIASES.items(), key=lambda x: -len(x[0])))) + "), "
    f"r AS (SELECT doc_id, block, i, coalesce(n, 0) AS n, coalesce(dst, term) AS term FROM e LEFT JOIN a ON CASE WHEN regexp_full_match(term, '{T.CJK}+') THEN contains(term, src) ELSE term = src END), "
    "f AS (SELECT doc_id, block, term, min(i * 1000 + n) AS ord FROM r GROUP BY ALL) SELECT l.doc_id, l.block, coalesce((SELECT string_agg(term, ' ' ORDER BY ord) FROM f WHERE f.doc_id = l.doc_id AND f.block = l.block), '') AS terms FROM lines l",
)
both(
    "fn23_redact",
    over_lines(lambda t: dict(out=T.redacted(t, ["the", "and ", ""]))),
    lines_sql(out="replace(replace(text, 'the', '<redacted>'), 'and ', '<redacted>')"),
)
both(
    "fn24_placeholder_scan",
    lambda s, d: X.lines(s, d).groupBy("doc_id").agg(*[F.sum(T.occurrences(F.col("text"), F.lit(p))).alias(f"n{i}") for i, p in enumerate(T.PLACEHOLDERS)]).withColumn("blocking", F.expr("n0 + n1 + n2 + n3 > 0")),
    "WITH " + X.LINES + ", c AS (SELECT doc_id, " + ", ".join(f"CAST(sum((length(text) - length(replace(text, '{p}', ''))) // {len(p)}) AS BIGINT) AS n{i}" for i, p in enumerate(T.PLACEHOLDERS)) + " FROM lines GROUP BY doc_id) SELECT *, n0 + n1 + n2 + n3 > 0 AS blocking FROM c",
)
