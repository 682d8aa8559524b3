"""Snapshots of query results: Parquet in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veldt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/snapshot-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, *paths: str) -> DataFrame:
    """df as it is now; later changes of its inputs don't show. Rows keep their order; columns are named c0, c1, ...

    With paths, df is written to the last of them, and what the others hold stands before it."""
    spark = df.sparkSession
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    paths = paths or (new_path(spark),)
    named.write.parquet(paths[-1])
    return spark.read.schema(named.schema).parquet(*paths)
