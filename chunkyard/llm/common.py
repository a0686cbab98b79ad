"""What the operators of this subpackage share: reading tables, scratch tables, Arrow columns, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from chunkyard.sources.tables import read_table

#: Used for scratch tables where the session names no folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark can read. The rows of a small single file are dealt to all cores."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_SCRATCH).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's folder in :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables. Call it when results that read them are written."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a string column holds about ``max_bytes`` in each (one row at least): bounded working memory."""
    for batch in batches:
        n = batch.num_rows
        if batch.nbytes <= max_bytes:
            if n:
                yield batch
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + max_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Powers of an odd number and of its inverse modulo 2**64, for hashes of words by position.
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the multiplier, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)):
            x = np.full(max(n, 5 << 20), base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[:] = both
    return _POWERS


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of some texts, each text's first word and its number of words, and where words begin and end in the joined bytes.

    Null counts as empty; texts may be strings or bytes.
    """
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    offsets, data = texts.buffers()[1:]
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    ink = ~_SPACE[raw]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    begins[at[:-1][at[:-1] < len(raw)]] |= ink[at[:-1][at[:-1] < len(raw)]]  # words end with their document
    ends[at[1:][at[1:] > 0] - 1] |= ink[at[1:][at[1:] > 0] - 1]
    begin, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    bounds = np.searchsorted(begin, at)
    return mixed((sums[end] - sums[begin]) * inverse[begin]), bounds[:-1], np.diff(bounds), begin, end


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, from the words' hashes."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return out
