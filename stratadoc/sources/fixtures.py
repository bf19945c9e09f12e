"""Derived tables over the given ones, each with its DuckDB text, so that operators have inputs of the right shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import read_blocks

#: What lines() puts before a block's text, by block number.
PREFIXES = ("第三章 ", "1.2.3 ", "（4）", "二、", "图 1-2 ", "Table 3 ", "关键词：", "Abstract: ", "", "2、", "Figure 2 - 5 ", "3.1 TODO ")

BLOCKS = "blocks AS (SELECT doc_id, source, lang, unnest(generate_series(1, len(p))) AS block, unnest(p) AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents))"
LINES = BLOCKS + ", lines AS (SELECT doc_id, block, [" + ", ".join(f"'{p}'" for p in PREFIXES) + "][block % 12 + 1] || text AS text FROM blocks)"
FIELD = "CASE block % 7 WHEN 0 THEN 'body.heading.outline1' WHEN 1 THEN 'body.heading.outline2' WHEN 3 THEN 'body.heading.outline3' WHEN 5 THEN 'body.figure.caption' WHEN 6 THEN 'body.figure' ELSE 'body.paragraph' END"
ITEMS = (
    BLOCKS
    + f", items AS (SELECT doc_id, source, block, 0 AS \"inline\", sha256(doc_id || '-' || block) AS object_id, CASE WHEN block % 7 = 6 THEN 'image' ELSE 'text' END AS physical_type, CASE WHEN trim(text) = '' THEN NULL ELSE {FIELD} END AS field_id, CASE WHEN trim(text) = '' THEN 'layout_only' ELSE 'classified' END AS status, text AS value FROM blocks)"
)
GOLD = ITEMS + (
    ", gold AS (SELECT doc_id, CASE WHEN (doc_id + block) % 29 = 0 THEN block + 1 WHEN (doc_id + block - 1) % 29 = 0 THEN block - 1 ELSE block END AS pos, object_id, CASE WHEN (doc_id + block) % 17 = 0 THEN 'body.changed' ELSE field_id END AS field_id, CASE WHEN (doc_id + block) % 23 = 0 THEN value || '!' ELSE value END AS value FROM items WHERE status = 'classified' AND (doc_id + block) % 19 <> 0)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "text", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.array(*[F.lit(p) for p in PREFIXES])
    return blocks(spark, sf_dir).select("doc_id", "block", F.concat(F.get(prefix, F.col("block") % 12), "text").alias("text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.trim("text") == ""
    return blocks(spark, sf_dir).select(
        "doc_id",
        "source",
        "block",
        F.lit(0).alias("inline"),
        F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("block").cast("string")), 256).alias("object_id"),
        F.when(F.col("block") % 7 == 6, "image").otherwise("text").alias("physical_type"),
        F.when(~blank, F.expr(FIELD)).alias("field_id"),
        F.when(blank, "layout_only").otherwise("classified").alias("status"),
        F.col("text").alias("value"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id") + F.col("block")
    return (
        items(spark, sf_dir)
        .where((F.col("status") == "classified") & (key % 19 != 0))
        .select(
            "doc_id",
            F.when(key % 29 == 0, F.col("block") + 1).when((key - 1) % 29 == 0, F.col("block") - 1).otherwise(F.col("block")).alias("pos"),
            "object_id",
            F.when(key % 17 == 0, "body.changed").otherwise(F.col("field_id")).alias("field_id"),
            F.when(key % 23 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"),
        )
    )
