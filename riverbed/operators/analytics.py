"""Statistics that run along a stream, trending entries, prices weighted by volume, late data."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import sent
from . import order
from .joins import join_last
from .windows import Last


def running_outliers(df: DataFrame, cents: str, threshold: float, order_by: list[str]) -> DataFrame:
    """Rows whose size is above the running mean's plus threshold standard deviations, each over all rows so far, itself
    included; never the first. Sums are of whole hundredths, so they are exact whatever the partitioning."""
    c = F.col(cents)
    sums = order.running(df, {"_n": F.lit(1), "_s": c, "_q": (c * c).cast("decimal(38,0)")}, order_by)
    return beyond(sums, c, threshold).select(*df.columns, "limit")


def beyond(sums: DataFrame, c: Column, threshold: float) -> DataFrame:
    """Rows with running sums _n, _s and _q (of squares) whose c is out of bounds, with limit."""
    n, s, q = F.col("_n").cast("double"), F.col("_s").cast("double"), F.col("_q").cast("double")
    deviation = F.sqrt((q - s * s / n) / (n - 1))
    return sums.where(F.col("_n") > 1).withColumn("limit", (F.abs(s / n) + threshold * deviation) / 100).where(F.abs(c) / 100 > F.col("limit"))


def trending(df: DataFrame, entry: Column, n: int, k: int, order_by: list[str], every: int | None = None) -> DataFrame:
    """The k most frequent of the last n entries, ties by entry: once every so many entries (a whole part of n; by default n)
    and at the end. Blocks of that many are counted once, and their counts are added up for each window that holds them."""
    every = every or n
    if every <= 0 or n <= 0 or n % every:
        raise ValueError("a window holds a whole number of steps")
    entries = df.withColumn("entry", entry).where("entry is not null")
    bounds, total = order.measured(entries, order_by[0])
    rows = order.numbered(entries, order_by, "_g", bounds)
    counts = rows.groupBy(F.floor(F.col("_g") / every).cast("long").alias("block"), "entry").agg(F.count(F.lit(1)).alias("n"))
    if n > every:
        last = max(total - 1, 0) // every
        held = F.sequence(F.col("block"), F.least(F.col("block") + n // every - 1, F.lit(last)))
        counts = counts.select(F.explode(held).alias("block"), "entry", "n").groupBy("block", "entry").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("block").orderBy(F.col("n").desc(), "entry")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Leading:
    """The k most frequent of a changing bag of whole numbers, ties to smaller ones, kept up to date with a few steps a change.

    Held in order are the first 4k at most; whatever isn't held comes after the last of them. A rise or fall moves one number in
    that list, in or out of it; only when fewer than k are left is it filled anew, after 3k of them have gone.
    """

    def __init__(self, size: int, k: int):
        self.k, self.counts, self.different, self.first = k, [0] * size, 0, []

    def change(self, x: int, by: int) -> None:
        n, first = self.counts[x], self.first
        if n:
            at = bisect_left(first, (-n, x))
            if at < len(first) and first[at] == (-n, x):
                del first[at]
            elif by < 0 or not first:
                at = -1  # it wasn't held, and comes no nearer
        else:
            at = 0
        self.counts[x] = new = n + by
        self.different += (new > 0) - (n > 0)
        if new and (at >= 0 or by > 0) and (first and (-new, x) < first[-1] or self.different == len(first) + 1):
            insort(first, (-new, x))
            if len(first) > 4 * self.k:
                first.pop()
        if len(first) < min(self.k, self.different):
            self.first = heapq.nsmallest(4 * self.k, ((-c, i) for i, c in enumerate(self.counts) if c))

    def top(self) -> list[tuple[int, int]]:
        return [(x, -n) for n, x in self.first[: self.k]]


def trending_each(df: DataFrame, entry: Column, n: int, k: int, order_by: list[str], block: int | None = None) -> DataFrame:
    """df's order columns, entry, and top: the k most frequent of the last n entries at each one of them, as "entry:count" by blanks;
    ties by entry. Rows without an entry don't count. Entries go in blocks, each with the n - 1 before it; a task counts up and
    down from row to row."""
    if k <= 0:
        raise ValueError("a list of leaders holds one at least")
    rows = df.withColumn("entry", entry.cast("string")).where("entry is not null").select(*order_by, "entry")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_g", ignore_index=True)
        names = sorted(set(part["entry"]), key=lambda x: x.encode())
        number = {x: i for i, x in enumerate(names)}
        codes = [number[x] for x in part["entry"]]
        own = (part["_in"] == part["_block"]).to_numpy()
        leading, out = Leading(len(names), k), []
        for i, (c, mine) in enumerate(zip(codes, own.tolist(), strict=True)):
            leading.change(c, 1)
            if i >= n:
                leading.change(codes[i - n], -1)
            if mine:
                out.append(" ".join(f"{names[x]}:{m}" for x, m in leading.top()))
        return sent(part.loc[np.flatnonzero(own), [*order_by, "entry"]].assign(top=out))

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order_by), "entry string, top string"])
    return order.blocks(rows, n, order_by, block=block or max(4 * n, 50_000)).groupBy("_in").applyInPandas(run, schema)


def vwap(trades: DataFrame, n: int = 4, key: str = "ticker") -> DataFrame:
    """After each trade, of the last n of its key: least, greatest, mean price and volume-weighted price, trades without
    volume left out; no row if none is left. price_cents and volume are whole numbers."""
    traded = F.col("volume") != 0
    p = F.when(traded, F.col("price_cents"))
    out = Last(rows=n, keys=(key,)).aggregate(trades, low=F.min(p), high=F.max(p), _s=F.sum(p), _c=F.count(p), _pv=F.sum(F.when(traded, F.col("price_cents") * F.col("volume"))), _v=F.sum("volume"))
    out = out.where("_c > 0").withColumn("mean", F.col("_s") / F.col("_c") / 100).withColumn("vwap", F.col("_pv") / F.col("_v") / 100)
    return out.drop("_s", "_c", "_pv", "_v")


def index_of(vwap_: Column, ask: Column, size: Column) -> Column:
    return F.when(vwap_ > ask, size * F.exp(vwap_ - ask)).otherwise(0.0)


def bargains(trades: DataFrame, quotes: DataFrame, n: int = 4) -> DataFrame:
    """Each quote with its ticker's last vwap, and its index; quotes before the first vwap go."""
    out = join_last(quotes, vwap(trades, n).select("ticker", "us", "event_id", "vwap"), ["ticker"], ["vwap"], ["us", "event_id"])
    return out.where("vwap is not null").withColumn("index", index_of(F.col("vwap"), F.col("ask"), F.col("size")))


def accepted(df: DataFrame, arrival: list[str], pane: int, lag: int, discard_age: int, greatest_before: int | None = None) -> DataFrame:
    """Adds watermark (the greatest us among rows that came before this one or with it, less lag), pane (its start) and
    late (the watermark had passed the pane's end); rows go that come after the pane's end plus discard_age. A part of a
    stream is told the greatest us of what came before it."""
    parts = order.bucketed(df, arrival[0])
    greatest = parts.groupBy("_bucket").agg(F.max("us").alias("_m"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = greatest.select(F.col("_bucket").alias("_b"), F.greatest(F.max("_m").over(before), F.lit(greatest_before).cast("long")).alias("_c"))
    rows = parts.join(marks, F.col("_bucket") == F.col("_b"))
    w = order.by_bucket(arrival).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("watermark", F.greatest(F.max("us").over(w), "_c") - lag).withColumn("pane", F.floor(F.col("us") / pane) * pane)
    end = F.col("pane") + pane
    return rows.withColumn("late", F.col("watermark") >= end).where(F.col("watermark") < end + discard_age).select(*df.columns, "watermark", "pane", "late")
