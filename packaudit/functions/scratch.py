"""Intermediate tables in a folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths that this driver has given out.
MADE: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where the setting is missing, a temporary folder is taken on one machine (tests); with
    executors elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    MADE.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return MADE[-1]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared scratch folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
