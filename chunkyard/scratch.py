"""Tables written to the folder that driver and executors share: what a plan reads more than once is made once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder, as in tests.
LOCAL = "/tmp/checkpoints"


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a local folder where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of this application: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
