"""Text quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, crc_mod, from_texts, mix64, release, table, utf8, words

#: Size of the weight vector; it alone bounds what the driver gathers and broadcasts (float32).
BUCKETS = 1 << 18
#: Labelled rows to train on at most: those of the smallest hash of doc_id. Further rows don't change the model.
TRAIN_ROWS = 20_000
#: Models that are trained side by side and then averaged.
SHARDS = 6
EPOCHS = 4
SCALE = 24.0
#: By byte: letter or byte of one, digit, mark at a word's edge, other.
KIND = np.full(256, 3, np.uint64)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
KIND[48:58] = 1
KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each text's word n-grams, and how many each text has.

    Words, pairs of words (a word that repeats the one before counts as one common pair), and singles, pairs and
    triples of the kinds of the words' first and last bytes; the last stand for n-grams of words that were never seen.
    """
    h, ends, counts = words(texts)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), counts * 5
    bounds = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    shape = KIND[ends[:, 0]] * U(4) + KIND[ends[:, 1]] + U(1)
    shape = np.where(KIND[ends[:, 1]] >= 2, shape + U(64) * ends[:, 1].astype(U), shape)
    first = np.ones(n, bool)
    first[bounds[counts > 0][:-1]] = True
    first[1:] = doc[1:] != doc[:-1]
    second = np.ones(n, bool)
    second[1:] = first[1:] | first[:-1]

    def before(x: np.ndarray, k: int, none: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        y[k:] = x[:-k] if k < n else 0
        y[none] = 0
        return y

    w1, s1, s2 = before(h, 1, first), before(shape, 1, first), before(shape, 2, second)
    pair = np.where(w1 == h, U(77), mix64(w1 * U(0x9E3779B97F4A7C15) + h))
    grams = np.stack([h + U(1), pair + U(2), shape * U(0x632BE59BD9B4E019) + U(3), shape * U(1 << 20) + s1 + U(4), (shape * U(1 << 20) + s1) * U(1 << 20) + s2 + U(5)], 1)
    return (mix64(grams.ravel()) & U(BUCKETS - 1)).astype(np.int64), counts * 5


def train(texts: list[bytes], labels: np.ndarray, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (the last one is the constant) after EPOCHS passes of per-coordinate updates, in the order given."""
    rows = []
    for text in texts:
        f, _ = features([text])
        index, count = np.unique(f, return_counts=True)
        rows.append((np.append(index, BUCKETS), np.append(count * (SCALE / max(1, len(f))), 1.0)))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weight(zi := z[i], ni := n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weight(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train on labelled documents. Labels that are null are left out; with none left, all weights are 0.

    The rows are dealt by a hash of doc_id to SHARDS tasks; each trains a model, and the mean of the models that saw
    rows is the result. The driver gets SHARDS models of BUCKETS + 1 weights, whatever the number of rows.
    """
    # labels of one document that differ count as their mean, rounded
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    data = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most max_rows pairs of numbers

    def run(batches):
        kept = [b for b in batches if len(b)]
        if kept:
            b = pd.concat(kept)
            text = [utf8(t) for t in b.text]
            order = np.argsort(mix64(b.doc_id.to_numpy(np.int64).astype(U)), kind="stable")
            w = train([text[i] for i in order], b["_y"].to_numpy(float)[order])
            found = pd.DataFrame({"n": [len(b)], "w": [w.tobytes()]})
            del kept, b, text
            yield found
        release()

    # a document may repeat: the least of its texts counts, so that reruns agree and no task gets more than its share
    data = data.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    dealt = data.repartition(SHARDS, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)))
    models = [(r["n"], np.frombuffer(r["w"], np.float32)) for r in dealt.mapInPandas(run, "n long, w binary").collect()]
    total = sum(n for n, _ in models)
    return np.sum([w * (n / total) for n, w in sorted(models, key=lambda m: (m[0], m[1].tobytes()))], axis=0).astype(np.float32) if models else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Adds out: the probability of label 1, a sparse dot product of each whole text with the weights.

    Null texts are empty; an empty text's score comes from the constant alone. A column of that name is replaced, all
    others stay; rows that repeat are scored each; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = held.value.astype(np.float64)

        def run(data: list[bytes]) -> np.ndarray:
            f, n = features(data)
            total = np.concatenate([[0.0], np.cumsum(w[f])])
            at = np.concatenate([[0], np.cumsum(n)])
            sums = (total[at[1:]] - total[at[:-1]]) * SCALE / np.maximum(n, 1)
            return 1 / (1 + np.exp(-np.clip(sums + w[BUCKETS], -30, 30)))

        return run

    return from_texts(docs, text, out, "double", make)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from the labels of those whose crc32 of doc_id modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 3) != 1)
    scored = score(docs, fit(docs, labels)).drop("text")
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
