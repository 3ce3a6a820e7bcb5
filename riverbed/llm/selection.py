"""The best few of each query, out of candidates that come a block at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


class Best:
    """The k best candidates of each of n queries: higher scores first, then smaller ids. What is held is bounded by n and k."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, max(1 << 18, 4 * n * k)
        self.score, self.ident = np.full(n, np.iinfo(np.int64).min), np.full(n, NO_ID)  # a query's k-th so far
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        least = self.score[query]
        keep = (score > least) | ((score == least) & (ident <= self.ident[query]))
        self.parts.append((query[keep], score[keep], ident[keep]))
        self.held += len(self.parts[-1][0])
        if self.held > self.limit:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of what is left, query by query, the best first."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        q, s, i = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = place == self.k - 1
        self.score[q[last]], self.ident[q[last]] = s[last], i[last]
        keep = place < self.k
        self.parts = [(q[keep], s[keep], i[keep])]
        self.held = int(keep.sum())
        return self.parts[0]

    def rows(self, names: pa.Array) -> pa.RecordBatch:
        """(query, id, score) of what is left, with the queries' names."""
        q, s, i = self.prune()
        return pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(i, mask=i == NO_ID), pa.array(s)], ["query", "id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query among (query, id, score), with rank, from 1: what tasks have left, a few for each query."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
