"""Cutting the lineage of iterated frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session in one process takes a temporary folder; a cluster's fails."""
    if base := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="stratadoc-")


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, lost executors cost no earlier work.

    A checkpoint would work out df twice and hand on the constraints of its plan, which double with each join of a loop.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stratadoc-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
