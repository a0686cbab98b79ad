"""Parquet tables as input of heavy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A single file of at most so many bytes may be one row group, which one task reads whatever the size of splits.
SPREAD_BYTES = 1 << 30


def read_table(spark: SparkSession, path: str, spread: bool = True) -> DataFrame:
    """A Parquet table. If ``spread``, the rows of one small file are dealt to all cores before anything is computed from them.

    Folders of files, and files that are larger, are read split by split, without an exchange. Filters and the choice of
    columns still reach the scan.
    """
    rows = spark.read.parquet(path)
    if not spread:
        return rows
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    if found.isFile() and found.getLen() <= SPREAD_BYTES:
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows
