"""Queries of alignment over blocks of pages; their ratios have no SQL form, so tests check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..sources import fixtures as X
from ..sources.blocks import read_blocks

ORACLES: dict[str, str] = {}


def versions(s, d):
    """Blocks of pages, and another version without some, with some changed and one in front."""
    rows = read_blocks(X.table(s, d, "pages").select("page_id", "html"), "html", "html").select(F.col("page_id").alias("doc_id"), "block", "text")
    key = F.col("doc_id") + F.col("block")
    changed = rows.where(key % 7 > 0).select("doc_id", (F.col("block") + 1).alias("block"), F.when(key % 5 == 0, F.concat(F.lit("x "), "text")).when(key % 5 == 1, F.upper("text")).otherwise(F.col("text")).alias("text"))
    front = rows.where("block = 1").select("doc_id", "block", F.lit("a new first block").alias("text"))
    return rows, changed.unionByName(front)


def slotted(df):
    """Blocks with slots in their masked texts, some in table cells, and runs of which those around slots are protected."""
    key = F.col("doc_id") + F.col("block")
    masked = F.when(F.length("text") < 30, F.col("text")).when(F.col("block") % 11 == 3, F.concat(F.substring("text", 1, 12), F.lit("<SLOT>"), F.col("text").substr(F.lit(20), F.length("text")))).when(F.col("block") % 11 == 7, "<SLOT>").otherwise(F.col("text"))
    cut = F.least(F.lit(12), F.length("text"))
    style = lambda size: F.create_map(F.lit("font.size_pt"), size.cast("string"), F.lit("font.bold"), (F.col("block") % 2 == 0).cast("string"))
    run = lambda start, stop, own, size: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.col("text").substr(start + 1, stop - start).alias("text"), own.alias("protected"), style(size).alias("style"))
    runs = F.array(run(F.lit(0), cut, F.lit(True), F.lit(12.0) + F.when(key % 9 == 0, 0.004).when(key % 9 == 1, 1.0).otherwise(0.0)), run(cut, F.length("text"), ~F.col("masked").contains("<SLOT>"), F.lit(10.5)))
    cell = lambda c: F.when(F.col("block") % 6 == 5, c)
    return df.withColumn("masked", masked).withColumn("runs", runs).withColumn("table_index", cell(F.lit(1))).withColumn("row", cell(F.col("block") % 4).cast("int")).withColumn("cell", cell(F.lit(1)))


def masked_texts(df):
    return slotted(df).withColumn("text", F.col("masked")).drop("masked", "runs")


def similarity(s, d):
    gold, actual = map(masked_texts, versions(s, d))
    other = actual.select("doc_id", "block", F.col("text").alias("other"), F.col("table_index").alias("t"), F.col("row").alias("r"), F.col("cell").alias("c"))
    pairs = gold.join(other, ["doc_id", "block"])
    same = F.col("t").isNotNull() & F.col("table_index").isNotNull() & (F.col("r") == F.col("row")) & (F.col("c") == F.col("cell"))
    rows = A.with_similarity(pairs, "text", "other", same, F.col("t").isNull() != F.col("table_index").isNull())
    return rows.select("doc_id", "block", F.round("similarity", 6).alias("similarity"), "method")


def verdicts(s, d):
    gold, actual = map(slotted, versions(s, d))
    plain = lambda df: df.withColumn("text", F.col("masked"))
    return A.evaluate_aligned(A.align_paragraphs(plain(gold), plain(actual)), gold, actual)


def pages(df):
    return df.select("doc_id", F.col("block").alias("page"), "text")


QUERIES = {
    "ud01_similarity": similarity,
    "ud02_align_paragraphs": lambda s, d: A.align_paragraphs(*map(masked_texts, versions(s, d))),
    "ud03_evaluate_aligned": verdicts,
    "ud04_align_pages": lambda s, d: A.align_pages(*map(pages, versions(s, d))),
}
