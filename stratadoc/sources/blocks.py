"""Sources of blocks: texts and HTML as rows in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are blocks of a page.
HTML_BLOCK = r"(?is)<(h1|p|li)\b[^>]*>(.*?)</(h1|p|li)>"
TAG = r"<[^>]*>"


def read_blocks(df: DataFrame, text_col: str, fmt: str = "text") -> DataFrame:
    """One row per block, numbered from 1: lines of a text, or h1, p and li elements of HTML without inner tags."""
    rest = [c for c in df.columns if c != text_col]
    if fmt == "text":
        return df.select(*rest, F.posexplode(F.split(text_col, "\n")).alias("pos", "text")).select(*rest, (F.col("pos") + 1).cast("long").alias("block"), "text")
    found = F.regexp_extract_all(text_col, F.lit(HTML_BLOCK), F.lit(0))
    rows = df.select(*rest, F.posexplode(found).alias("pos", "element"))
    return rows.select(
        *rest,
        (F.col("pos") + 1).cast("long").alias("block"),
        F.lower(F.regexp_extract("element", HTML_BLOCK, 1)).alias("tag"),
        F.regexp_replace(F.regexp_extract("element", HTML_BLOCK, 2), TAG, "").alias("text"),
    )
