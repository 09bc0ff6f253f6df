"""Tables that a plan writes once and reads more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from twinspark.operators.store import Store


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='twinspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its plan ends there, and a lost executor loses nothing of it."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_store(spark: SparkSession) -> Store:
    """An empty store in the shared folder."""
    return Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}")
