"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Components are quantised to integers. A block of rows is indexed by dimension, sign and quantised impact: each posting
segment lists the rows whose component has that sign and size. A query takes the segments in falling order of what they
can add to or take from a score, and keeps for every row what it has for certain. It stops once bounds prove that few rows can still be
among the best, or when nothing is left; those rows are scored exactly.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantised sizes of a component.
LEVELS = 16
#: Rows in an index block, and queries that a task runs over it, on average.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Segments taken between two looks at the bounds.
STRIDE = 96


class ImpactIndex:
    """The posting segments of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        rows, dims = vectors.shape
        size = np.abs(vectors)
        self.width = max(1, -(-int(size.max(initial=0) + 1) // LEVELS))
        level = size // self.width
        key = (np.arange(dims)[None, :] * 2 + (vectors < 0)) * LEVELS + level
        flat = key.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.rows = np.tile(np.arange(rows), dims)[order]
        keys, self.begins = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(flat))
        self.dim = keys // (2 * LEVELS)
        self.sign = np.where(keys // LEVELS % 2, -1, 1)
        self.low = keys % LEVELS * self.width

    def top(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of rows that hold the k best (ties included), rows marked in ``own`` left out."""
        n, dims = self.vectors.shape
        peak = int(np.abs(self.vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * dims
        error = 0.0 if peak < 1 << 53 else peak * 2.0**-44  # bounds are doubles; scores are whole numbers
        weight = (query[self.dim] * self.sign).astype(np.float64)
        least, most = weight * self.low, weight * (self.low + self.width - 1)
        least, most = np.minimum(least, most), np.maximum(least, most)
        order = np.argsort(-np.maximum(np.abs(least), np.abs(most)), kind="stable")
        sure = np.zeros(n)
        sure[own] = -np.inf
        slack = np.abs(query).astype(np.float64) * (self.width - 1)
        taken = np.zeros(len(order), bool)
        possible = None
        for i in range(0, len(order), STRIDE):
            step = order[i : i + STRIDE]
            rows = np.concatenate([self.rows[a:b] for a, b in zip(self.begins[step].tolist(), self.ends[step].tolist(), strict=True)])
            sure += np.bincount(rows, np.repeat(least[step], self.ends[step] - self.begins[step]), n)
            taken[step] = True
            # what the dimensions can still add: at most the width of a size where a row's segment is taken
            seen = np.zeros(dims, bool)
            seen[self.dim[taken]] = True
            upper = np.where(seen, slack, -np.inf)
            lower = np.where(seen, 0.0, np.inf)
            left = ~taken
            np.maximum.at(upper, self.dim[left], most[left])
            np.minimum.at(lower, self.dim[left], least[left])
            if n - own.sum() <= k:
                possible = np.nonzero(~own)[0]
                break
            best = np.partition(sure, n - k)[n - k] + lower.sum()
            possible = np.nonzero((sure + upper.sum() >= best - error) & ~own)[0]
            if len(possible) <= max(4 * k, n // 64):
                break
        if possible is None:  # vectors without components: all scores are 0
            possible = np.nonzero(~own)[0]
        return possible, self.vectors[possible] @ query


def _quantised(rows: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of lists of one length: longs, or whole numbers of any size where one needs more than 31 bits."""
    dims = len(rows[0]) if len(rows) else 0
    flat = rows.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0) * scale < 1 << 31:
        return np.floor(scale * flat).astype(np.int64).reshape(len(rows), dims)
    whole = [math.floor(Fraction(x) * scale) for x in flat.tolist()]
    return np.array(whole, object).reshape(len(rows), dims)


def _every_score(vectors: np.ndarray, query: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :meth:`ImpactIndex.top`, of all rows, in whole numbers of any size; what no long holds becomes the nearest long."""
    rows = np.nonzero(~own)[0]
    scores = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in vectors[rows].astype(object) @ query.astype(object)] if vectors.shape[1] else [0] * len(rows)
    return rows, np.array(scores, np.int64)


def topk_search(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the row's id and its score: each query's k highest scores among all other rows of ``df``.

    Components become floor(scale * x) with x as double; scores are integer inner products; ties go to the smaller id,
    null ids last. A score beyond a long counts as the nearest long; blocks with components that large are scored whole, without
    the index. Rows and queries whose vector is null or holds null or non-finite components take no part, nor do rows
    of another length for a query. A query's own rows are those with its id. Rows repeated with their id are listed each;
    a query repeated with its vector is asked once, and one id with several vectors gets a ranking for each. Queries with
    null id are dropped. No rows or queries in, no rows out. Other columns are not read. Rows and queries meet in blocks:
    each index block is built once for each block of queries, and returns at most k rows and ties' best a query.
    """

    def valid(rows: DataFrame, name: str) -> DataFrame:
        vector = F.col(vector_col)
        rows = rows.select(F.col(id_col).cast("long").alias(name), vector.cast("array<double>").alias("v"))
        return rows.where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))").withColumn("dims", F.size("v"))

    rows = valid(df, "id")
    asked = valid(queries, "id").where("id IS NOT NULL").dropDuplicates(["id", "v"])
    row_blocks = max(1, math.ceil(df.count() / BLOCK_ROWS))
    query_blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", block(row_blocks)).withColumn("qb", every(query_blocks))
    right = asked.withColumn("qb", block(query_blocks)).withColumn("rb", every(row_blocks))

    def search(own: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if own.num_rows and ask.num_rows:
            vectors = _quantised(own.column("v"), scale)
            index = ImpactIndex(vectors) if vectors.dtype != object else None
            null = np.asarray(own.column("id").combine_chunks().is_null())
            ids = own.column("id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
            values = _quantised(ask.column("v"), scale)
            for number, (ident, query) in enumerate(zip(ask.column("id").to_pylist(), values, strict=True)):
                mine = (ids == ident) & ~null
                large = index is None or query.dtype == object or int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * vectors.shape[1] >= 1 << 62
                at, scores = _every_score(vectors, query, mine) if large else index.top(query, k, mine)
                best = np.lexsort((ids[at], null[at], ~scores))[:k]
                out[0] += [ident] * len(best)
                out[1] += [int.from_bytes(_digest(query), "little", signed=True)] * len(best)
                out[2] += [None if null[j] else int(ids[j]) for j in at[best]]
                out[3] += scores[best].tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "question", "id", "score"), out, strict=True)})

    found = left.groupBy("qb", "rb", "dims").cogroup(right.groupBy("qb", "rb", "dims")).applyInArrow(search, "query_id long, question long, id long, score long")
    order = Window.partitionBy("query_id", "question").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _digest(query: np.ndarray) -> bytes:
    """Tells a query's vector from others with its id."""
    import hashlib

    return hashlib.blake2b(query.tobytes() if query.dtype != object else repr(query.tolist()).encode(), digest_size=8).digest()
