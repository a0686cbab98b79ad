"""The best rows for each of a block of queries, gathered while rows stream through a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a matrix of scores (rows by queries) that a task fills at once.
CELLS = 1 << 20


class Best:
    """The ``k`` best rows for each of ``n`` queries by score rounded to ``places``; ties go to the smaller id.

    What is held grows with ``k * n``, not with the rows seen. Scores below ``least`` and NaN take no part.
    """

    def __init__(self, k: int, n: int, places: int, least: float = -np.inf) -> None:
        self.k, self.n, self.places = k, n, places
        self.floor = np.full(n, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def rows(self) -> int:
        """How many rows' scores to add at once."""
        return max(1, CELLS // max(1, self.n))

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores (rows by queries), not yet rounded, of the rows with these ids."""
        slack = 0.6 * 10.0**-self.places  # a score rounds up by half a place at most
        found = scores >= self.floor - slack
        if len(ids) > self.k and np.count_nonzero(found) > 4 * self.k * self.n:
            found &= scores >= np.partition(np.where(found, scores, -np.inf), len(ids) - self.k, axis=0)[len(ids) - self.k] - 2 * slack
        row, query = np.nonzero(found)
        score = np.round(scores[row, query], self.places) + 0.0
        kept = score >= self.floor[query]
        if kept.any():
            self.parts.append((query[kept], score[kept], ids.take(pa.array(row[kept]))))
            self.size += int(kept.sum())
            if self.size > max(CELLS // 8, 4 * self.k * self.n):
                self._prune()

    def _prune(self) -> None:
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        order = np.lexsort((pc.rank(ids, "ascending", null_placement="at_start").to_numpy(), -score, query))
        query, score = query[order], score[order]
        starts = np.searchsorted(query, np.arange(self.n))
        kept = np.arange(len(query)) - starts[query] < self.k
        query, score = query[kept], score[kept]
        self.parts, self.size = [(query, score, ids.take(pa.array(order[kept])))], len(query)
        counts = np.bincount(query, minlength=self.n)
        full = counts >= self.k
        last = np.cumsum(counts) - 1
        self.floor[full] = np.maximum(self.floor[full], score[last[full]])

    def taken(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """(query numbers, scores, ids) of the best rows seen; None for none."""
        if not self.parts:
            return None
        self._prune()
        return self.parts[0]
