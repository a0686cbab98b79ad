"""Exact cosine top-k: a block of queries runs over every vector, whole matrices at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.operators.best import Best
from chunkyard.scratch import written

#: Queries sent to every task at once; a larger set takes several passes over the vectors.
BLOCK = 2048


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def top_k(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k chunks (chunk_id, vector) nearest to each query (query_id, vector).

    Scores are cosines rounded to 6 places; ties go to the smaller chunk_id. Vectors that are null, hold nulls or NaN take
    no part, and vectors meet queries of their own length only; a zero vector scores 0. A task scores few vectors at a time,
    keeps its k best for a query and passes on those alone. The driver holds one block of queries at a time.
    """
    usable = lambda d: d.where("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x))").withColumn("dims", F.size("vector"))
    asked = usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")))
    kinds = (queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    sizes = {r["dims"]: r["count"] for r in asked.groupBy("dims").count().collect()}
    blocks = [(dims, max(1, -(-n // BLOCK)), i) for dims, n in sorted(sizes.items()) for i in range(max(1, -(-n // BLOCK)))]
    if not blocks:
        return chunks.sparkSession.createDataFrame([], f"{schema}, rank int").select("query_id", "rank", "chunk_id", "score")
    if len(blocks) > 1:
        asked = written(asked, "queries")
    every = usable(chunks.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")))

    def block(dims: int, n: int, i: int) -> DataFrame:
        own = asked.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("query_id", "vector"), F.lit(n)) == i)).select("query_id", "vector").collect()
        names = [r["query_id"] for r in own]
        held = chunks.sparkSession.sparkContext.broadcast(_unit(np.array([r["vector"] for r in own], np.float64).reshape(len(own), dims)))  # about BLOCK queries

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(names), 6)
            for batch in batches:
                for start in range(0, batch.num_rows, best.rows()):
                    own = batch.slice(start, best.rows())
                    best.add(_unit(_matrix(own.column(1), dims)) @ held.value.T, own.column(0))
            if (found := best.taken()) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in found[0]]), found[2], pa.array(found[1])], names=["query_id", "chunk_id", "score"])

        found = every.where(F.col("dims") == dims).select("chunk_id", "vector").mapInArrow(search, schema)
        if len(blocks) == 1:
            return found
        found = written(found, "nearest")
        held.unpersist()
        return found

    found = reduce(DataFrame.unionByName, [block(*b) for b in blocks])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
