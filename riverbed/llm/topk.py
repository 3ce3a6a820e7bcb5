"""Exact nearest vectors by inner product: histograms of all scores locate each query's k-th value, then a filter takes the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, table
from .selection import NO_ID, Best, ranked

#: Queries of one pass over the vectors, at most about so many and of so many bytes: what a pass broadcasts.
QUERIES, QUERY_BYTES = 4096, 32 << 20
#: Bins of a query's histogram, scores that are computed at once, and rows in a bin (beyond k) that aren't worth another pass.
BINS, SCORES, SLACK = 512, 1 << 21, 64
_TOP = np.iinfo(np.int64).max


def _usable(v):
    """A vector without nulls and values that aren't finite."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(batch: pa.RecordBatch, scale: float):
    """(places, matrix) of the vectors of an Arrow batch (id, vector) by their length: whole numbers, rounded down; vectors
    that are null, or that hold what is null or not finite, are left out."""
    v = batch.column("vector")
    n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(n, 0))[:-1]]).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    for d in np.unique(n[n >= 0]).tolist():
        at = np.flatnonzero(n == d)
        m = values[starts[at][:, None] + np.arange(d)]
        fine = np.isfinite(m).all(1)
        yield at[fine], m[fine]


def _tiers(norms: np.ndarray):
    """Parts of the rows whose products are alike in size, so that one long vector doesn't slow all others down."""
    for low, high in ((-1.0, 2.0**12), (2.0**12, 2.0**26), (2.0**26, np.inf)):
        at = np.flatnonzero((norms > low) & (norms <= high))
        if len(at):
            yield at


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exactly: in floats while no partial sum can be rounded. Beyond 64
    bits they end at the bound."""
    out = np.empty((len(a), len(b)), np.int64)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for i in _tiers(na):
        for j in _tiers(nb):
            bound = na[i].max() * nb[j].max() * 1.001
            if bound < 2**24:
                part = a[i].astype(np.float32) @ b[j].astype(np.float32).T
            elif bound < 2**53:
                part = a[i] @ b[j].T
            else:
                whole_ = np.frompyfunc(int, 1, 1)
                part = np.clip(np.dot(whole_(a[i]).astype(object), whole_(b[j]).astype(object).T), -_TOP, _TOP)
            out[np.ix_(i, j)] = part
    return out


class Asked:
    """Queries of one pass, by the length of their vectors: ids, matrix, and the places of them in the pass."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, matrix: np.ndarray):
        self.ids, self.places, self.matrix = ids, places, matrix
        self.sorted = np.argsort(ids)

    def blocks(self, idents: np.ndarray, rows: np.ndarray):
        """(ids, scores, own) of blocks of rows: own are the places of (row, query) of one id."""
        step = max(16, SCORES // max(1, len(self.ids)))
        for s in range(0, len(rows), step):
            ids = idents[s : s + step]
            at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.sorted), len(self.ids) - 1)
            same = np.flatnonzero(self.ids[self.sorted[at]] == ids)
            yield ids, products(rows[s : s + step], self.matrix), (same, self.sorted[at[same]])


def _scored(batches, asked: dict[int, Asked], scale: float):
    for b in batches:
        idents = pc.fill_null(b.column("id").cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
        for at, m in whole(b, scale):
            if q := asked.get(m.shape[1]):
                for ids, scores, own in q.blocks(idents[at], m):
                    yield q, ids, scores, own


def _lengths(vectors: DataFrame, scale: float) -> dict[int, float]:
    """The greatest norm among the vectors of each length."""

    def run(batches):
        most: dict[int, float] = {}
        for b in batches:
            for _, m in whole(b, scale):
                if len(m):
                    most[m.shape[1]] = max(most.get(m.shape[1], 0.0), float(np.linalg.norm(m, axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["d", "norm"])
        release()

    return {r["d"]: r["norm"] for r in vectors.mapInArrow(run, "d long, norm double").groupBy("d").agg(F.max("norm").alias("norm")).collect()}


def _histograms(vectors: DataFrame, asked: dict[int, Asked], low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray, scale: float) -> dict[int, tuple[int, int, int]]:
    """Of each query that needs rows: the bin that its need-th score in [low, high] lies in, how many rows lie in that bin,
    and in those above it.

    A task counts all scores, and sends a query's bins from the top down to the one where its own rows are enough: the bin
    looked for can't lie below that of any task.
    """

    def run(batches):
        seen = np.zeros((len(need), BINS), np.int64)
        least, rows, again = low.copy(), 0, 1
        for q, _, scores, own in _scored(batches, asked, scale):
            at = q.places
            fits = (scores >= least[at]) & (scores <= high[at]) & (need[at] > 0)
            fits[own] = False
            r, c = np.nonzero(fits)
            c_ = at[c]
            bins = (scores[r, c].view(np.uint64) - low[c_].view(np.uint64)) // width[c_].view(np.uint64)
            np.add.at(seen, (c_, bins.astype(np.int64)), 1)
            rows += len(scores)
            if rows >= again:  # what lies below the bin where this task's own rows are enough needn't be counted any more
                enough = np.cumsum(seen[:, ::-1], 1)[:, ::-1] >= need[:, None]
                first = np.where(enough.any(1), BINS - 1 - np.argmax(enough[:, ::-1], 1), 0)
                least = np.maximum(least, (low.view(np.uint64) + first.astype(np.uint64) * width.view(np.uint64)).view(np.int64))
                again = 2 * rows
        above = np.cumsum(seen[:, ::-1], 1)[:, ::-1] - seen
        c, b = np.nonzero((seen > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(b), pa.array(seen[c, b])], ["q", "bin", "n"])
        release()

    counts = vectors.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    needs = vectors.sparkSession.createDataFrame([(int(i), int(n)) for i, n in enumerate(need) if n > 0], "q long, need long")
    found = counts.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(needs), "q").where("upto >= need and upto - n < need")
    return {r["q"]: (r["bin"], r["n"], r["upto"] - r["n"]) for r in found.collect()}  # a row for each query of the pass


def _thresholds(vectors: DataFrame, asked: dict[int, Asked], n: int, k: int, norms: dict[int, float], scale: float) -> np.ndarray:
    """A score of each query that at least k rows reach (all, if there are fewer), and few more than that, but for ties."""
    low, high, width, need = (np.zeros(n, np.int64) for _ in range(4))
    for d, q in asked.items():
        most = np.linalg.norm(q.matrix, axis=1) * norms.get(d, 0.0) * 1.001 + 1
        high[q.places], need[q.places] = np.where(most < 2.0**62, np.minimum(most, 2.0**62).astype(np.int64), _TOP), k if d in norms else 0
    low = -high
    while (need > 0).any():
        width = ((high.view(np.uint64) - low.view(np.uint64)) // np.uint64(BINS)).view(np.int64) + 1
        live = need > 0
        found = _histograms(vectors, {d: q for d, q in asked.items() if live[q.places].any()}, low, high, width, need, scale)
        for i in np.flatnonzero(live).tolist():
            if i not in found:  # fewer rows than k: the first pass has seen them all
                need[i] = 0
                continue
            b, here, above = found[i]
            start = int(low[i]) + b * int(width[i])
            low[i], high[i] = start, min(int(high[i]), start + int(width[i]) - 1)
            need[i] = 0 if here <= need[i] - above + SLACK or low[i] == high[i] else need[i] - above
    return low


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of vectors of the highest inner product, ties to smaller
    ids. Components count as floor(scale * x); a query's own id is no candidate.

    Vectors that are null or hold what is null or not finite take no part; those of another length than the query's aren't
    compared with it. A query id that repeats counts once, with its least vector; rows of vectors that repeat are candidates
    one by one. A row without an id is no query, and comes last among equal scores. Scores end at 64 bits. Without queries,
    or without candidates, there are no rows. Other columns are ignored.

    Queries go in parts of a bounded size, each broadcast for its passes: greatest norms once, histograms until the bin of
    the k-th value is narrow or holds few rows, then a filter in which a task keeps k rows a query at most.
    """
    if k <= 0:
        raise ValueError("k is one at least")
    vectors = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = queries.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    asked = cut(asked.groupBy("id").agg(F.min("vector").alias("vector")))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).first()
    parts = max(1, -(-n // QUERIES), -(-size // QUERY_BYTES))
    norms = _lengths(vectors, scale) if n else {}
    out = vectors.sparkSession.createDataFrame([], "query long, id long, score long")
    for p in range(parts if n else 0):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow().combine_chunks()  # a bounded part of the queries
        if len(rows):
            batch = rows.to_batches()[0]
            ids = batch.column("id").to_numpy()
            lengths = {m.shape[1]: Asked(ids[at], at, m) for at, m in whole(batch, scale) if len(at)}
            found = _filtered(vectors, lengths, ids, k, _thresholds(vectors, lengths, len(ids), k, norms, scale), scale)
            out = out.unionByName(cut(found)) if parts > 1 else found
    return ranked(out, k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _filtered(vectors: DataFrame, asked: dict[int, Asked], ids: np.ndarray, k: int, least: np.ndarray, scale: float) -> DataFrame:
    """(query, id, score): what of each task's rows may be among the k best."""

    def run(batches):
        best = Best(len(ids), k)
        for q, idents, scores, own in _scored(batches, asked, scale):
            fits = scores >= least[q.places]
            fits[own] = False
            r, c = np.nonzero(fits)
            best.add(q.places[c], scores[r, c], idents[r])
        yield best.rows(pa.array(ids))
        release()

    return vectors.mapInArrow(run, "query long, id long, score long")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for each one whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP11_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""
