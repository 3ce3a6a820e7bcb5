"""Mixing of sources to target weights: balanced sampling of documents by the cube method."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, cut, mix64, table

#: Documents of one source that one task balances together; it bounds a task's memory.
BLOCK = 4096
#: Undecided documents of a source that are left for the landing, which tries all their combinations.
LANDING = 12
#: Sources up to which their targets are broadcast (a row of a few numbers and a name each).
BROADCAST_SOURCES = 20_000


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size) adds sid and target: weights repeat over the sources by code point, null last; together
    the targets are share times all sizes; none is above most times its source's size, and what is cut off goes to the
    others by weight. One row a source passes one task, and nothing else does."""
    ranked = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    # sources reach their cap in the order of cap / weight; those before a source have, when it sets the level
    by = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    ranked = ranked.withColumn("_below", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("_left", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("_below")) / F.col("_left"))
    # the level holds from the first source on that doesn't reach its cap
    level = F.min(F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.struct("_i", "_level"))).over(everything)
    return ranked.withColumn("_i", F.row_number().over(by)).withColumn("_l", level["_level"]).select("source", "source_size", "sid", F.coalesce(F.least("cap", F.col("_l") * F.col("w")), F.col("cap")).alias("target"))


def flight(x: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int = 0) -> np.ndarray:
    """Move inclusion probabilities x to 0 or 1, at most max(2, keep) of them excepted, so that sum(x) and sum(x * size)
    stay as they are. Three documents at a time: two constraints leave one direction, (s1 - s2, s2 - s0, s0 - s1)."""
    x = x.copy()
    queue = np.flatnonzero((x > 0) & (x < 1)).tolist()
    stop = max(2, keep)
    queue.reverse()
    live: list[int] = []
    xs, sizes = x.tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(queue) + 1).tolist())
    while len(live) + len(queue) > stop:
        while len(live) < 3 and queue:
            live.append(queue.pop())
        i, j, k = live
        u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - xs[d]) / v if v > 0 else -xs[d] / v) for d, v in zip(live, u, strict=True) if v)
        down = min((xs[d] / v if v > 0 else (xs[d] - 1) / v) for d, v in zip(live, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        rest = []
        fixed = False
        for d, v in zip(live, u, strict=True):
            y = xs[d] + step * v
            if y < 1e-9 or y > 1 - 1e-9:
                y, fixed = float(y > 0.5), True
            else:
                rest.append(d)
            xs[d] = min(1.0, max(0.0, y))
        if not fixed:  # only rounding can do that
            d = rest.pop(0)
            xs[d] = float(xs[d] > 0.5)
        live = rest
    return np.array(xs)


def landing(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few: of all combinations the one whose words, then documents, are nearest to what is expected."""
    live = np.flatnonzero((x > 0) & (x < 1))
    if len(live):
        choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(live))))
        words = np.abs(choices @ size[live] - x[live] @ size[live])
        number = np.abs(choices.sum(1) - x[live].sum())
        x = x.copy()
        x[live] = choices[np.lexsort((number, words))[0]]
    return x


def choose(units: DataFrame, seed: int = 0, most: float = 2.0) -> DataFrame:
    """units: source, size, times (rows that are alike count as one unit, so that however many they are they are one number
    here) and further columns, doc_id among them, which together with source and size tell units apart. Adds source_size,
    target, and copies: how often the mix takes the unit's rows, all together.

    A row's expected copies are its source's target over its size, 0 to most; the whole part of a unit's is certain, the rest
    is decided by balanced sampling within the source: blocks of units first, then what each block leaves undecided (two
    units) in larger blocks, until one is left. Reruns over the same rows agree. A null source is one source.
    """
    units = cut(units)
    keys = [c for c in units.columns if c not in ("source", "size", "times")]
    per = cut(units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count(F.lit(1)).alias("_n")))
    wanted = targets(per.select("source", "source_size"), most=most).join(per.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    wanted = cut(wanted.withColumnRenamed("source", "_source"))
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_SOURCES else wanted
    rows = units.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    total = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("times")
    rows = rows.withColumn("_base", F.floor(total + 1e-12).cast("double")).withColumn("_x", F.greatest(F.lit(0.0), total - F.col("_base")))
    rows = rows.withColumn("_x", F.when(F.col("_x") < 1e-9, 0.0).otherwise(F.col("_x")))
    schema = rows.withColumn("_b", F.lit(0).cast("long")).schema
    done, level, n = [], 0, (per.agg(F.max("_n")).first()[0] or 0)

    def decide(last: bool, salt: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = [pdf[k] for k in keys]
            columns = [*(mix64(x.fillna(-1).astype("int64").to_numpy().astype(U) + U(salt)) for x in ids), *(x.isna().to_numpy() for x in ids), pdf["size"].to_numpy()]
            pdf = pdf.iloc[np.lexsort(columns[::-1])]
            x, size = pdf["_x"].to_numpy(float), pdf["size"].to_numpy(float)
            rng = np.random.default_rng([seed, salt, int(pdf.sid.iloc[0]), int(pdf["_b"].iloc[0])])
            x = flight(x, size, rng, LANDING if last else 2)
            return pdf.assign(_x=landing(x, size) if last else x)

        return run

    while True:
        blocks = F.ceil(F.col("_n") / F.lit(BLOCK))
        last = n <= BLOCK
        dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*keys, "size", F.lit(level)), blocks))
        out = cut(dealt.groupBy("sid", "_b").applyInPandas(decide(last, level + 1), schema))
        open_ = (F.col("_x") > 0) & (F.col("_x") < 1)
        done.append(out.where(~open_))
        if last:
            break
        left = out.where(open_)
        counts = left.groupBy("sid").agg(F.count(F.lit(1)).alias("_n"))
        rows = left.drop("_b", "_n").join(counts, "sid").select(*[c for c in schema.names if c != "_b"])
        n, level = counts.agg(F.max("_n")).first()[0] or 0, level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select(*keys, "source", "size", "times", "source_size", "target", (F.col("_base") + F.col("_x")).cast("long").alias("copies"))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as times says, with the number of the repeat (from 0) as _k; no array of all of them is built."""
    blocks = df.withColumn("_t", times).where("_t > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t") - 1) / F.lit(BLOCK)).cast("long"))))
    last = F.least(F.col("_t"), (F.col("_k") + 1) * BLOCK) - 1
    return blocks.withColumn("_k", F.explode(F.sequence(F.col("_k") * BLOCK, last))).drop("_t")


def sample(sized: DataFrame, seed: int = 0, most: float = 2.0) -> DataFrame:
    """sized: doc_id, source, size (null sizes are 0; other columns are ignored). For each row: doc_id, source, size,
    source_size, target and copies, how often the mix takes it.

    See choose(). Rows that repeat count each; what is taken of them all is dealt to them evenly. Documents without words
    aren't taken where their whole source has none. An empty table gives no rows.
    """
    units = sized.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    out = repeated(choose(units, seed, most), F.col("times"))
    copies = F.floor(F.col("copies") / F.col("times")).cast("long") + (F.col("_k") < F.col("copies") % F.col("times")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    out = sample(docs.select("doc_id", "source", words_in("text").alias("size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of docs, with all its columns and whatever their names, as often as it is taken (0, 1 or 2
    times). Rows that are alike in every column are one unit of the sample, so that a rerun takes the same rows; null and
    empty texts have the size 0. An empty table gives no rows."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def keys(df: DataFrame, *more: Column) -> DataFrame:
        r = F.col("row")
        return df.select(*more, r["doc_id"].alias("doc_id"), r["source"].alias("source"), words_in(r[text]).alias("size"), F.xxhash64("row").alias("unit"))

    units = keys(whole).groupBy("doc_id", "source", "size", "unit").agg(F.count(F.lit(1)).alias("times"))
    chosen = cut(choose(units).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("unit").alias("_u"), "times", "copies"))
    if not chosen.where("times > 1").isEmpty():  # rows that repeat fold before they are shuffled
        whole = whole.groupBy("row").agg(F.count(F.lit(1)).alias("_c")).select("row")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("unit") == F.col("_u"))
    taken = keys(whole, F.col("row")).join(chosen.where("copies > 0"), on).select("row", "copies")
    return repeated(taken, F.col("copies")).select("row.*")
