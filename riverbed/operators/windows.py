"""Sliding, tumbling, triggered and marker-delimited windows over keyed streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import sent
from . import order


@dataclass(frozen=True)
class Last:
    """The last rows, or the last microseconds, of each key; emits at each row, or at each m-th of a key.

    Rows count in the order of order_by, which must be total. Windows that aren't full yet emit too, unless complete.
    A row exactly `micros` old has left. The same configuration may be used on several streams. With hot given, keys of more rows
    than that are dealt to many tasks, in blocks of that many; all others are sorted by key.
    """

    rows: int | None = None
    micros: int | None = None
    keys: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ("us", "event_id")
    every: int = 1
    complete: bool = False
    hot: int | None = None

    def __post_init__(self):
        if (self.rows is None) == (self.micros is None) or (self.rows if self.micros is None else self.micros) <= 0 or self.every <= 0:
            raise ValueError("a window needs a positive number of rows, or of microseconds")
        if self.complete and self.rows is None:
            raise ValueError("only a window of rows can be complete")
        if self.hot is not None and (self.rows is None or not self.keys or self.hot <= 0):
            raise ValueError("only keys of windows of rows can be hot")

    def partition(self, *keys: str) -> Last:
        return replace(self, keys=keys)

    def trigger(self, every: int) -> Last:
        return replace(self, every=every)

    def aggregate(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """Adds aggregates. Without keys the whole stream is one window, computed in blocks of rows or of time."""
        if not self.keys and self.micros:
            w = Window.partitionBy("_in").orderBy(self.order_by[0]).rangeBetween(-(self.micros - 1), 0)
            out = order.time_blocks(df, self.order_by[0], self.micros).withColumns({k: a.over(w) for k, a in aggregates.items()})
            out = out.where("_in = _block").select(*df.columns, *aggregates)
            return order.numbered(out, list(self.order_by), "_n").where((F.col("_n") + 1) % self.every == 0).drop("_n") if self.every > 1 else out
        if not self.keys:
            if self.every == 1 and not self.complete:
                return order.last_n(df, self.rows, aggregates, list(self.order_by))
            out = order.numbered(order.last_n(df, self.rows, aggregates, list(self.order_by)), list(self.order_by), "_n")
            kept = (F.col("_n") + 1) % self.every == 0
            return out.where(kept & (F.col("_n") + 1 >= self.rows) if self.complete else kept).drop("_n")
        if self.hot:
            many, few = order.heavy(df, list(self.keys), self.hot)
            out = order.last_n(many, self.rows, aggregates, list(self.order_by), self.hot, keys=list(self.keys), place="_n")
            return out.where(self._emits()).drop("_n").unionByName(replace(self, hot=None).aggregate(few, **aggregates))
        w = Window.partitionBy(*self.keys).orderBy(*self.order_by)
        if self.rows:
            frame = w.rowsBetween(-(self.rows - 1), 0)
        else:
            frame = Window.partitionBy(*self.keys).orderBy(self.order_by[0]).rangeBetween(-(self.micros - 1), 0)
        out = df.withColumns({k: a.over(frame) for k, a in aggregates.items()})
        if self.every > 1 or self.complete:
            out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % self.every == 0)
            out = (out.where(F.col("_n") >= self.rows) if self.complete and self.rows else out).drop("_n")
        return out

    def sums(self, df: DataFrame, **values: Column) -> DataFrame:
        """As aggregate with sums of whole-numbered expressions in a window of time, at each row; null if all are null. What a row
        costs doesn't grow with the rows of its window. Rows without a time are a window of their own."""
        if self.micros is None or self.every > 1:
            raise ValueError("sums are those of a window of time, at each row")
        at = self.order_by[0]
        return _entries(df, self.micros, list(self.keys), values, at).where("not _gone").select(*df.columns, *values)

    def _emits(self) -> Column:
        """Whether the row at the place _n (from 0) of its window's rows emits."""
        kept = (F.col("_n") + 1) % self.every == 0
        return kept & (F.col("_n") + 1 >= self.rows) if self.complete else kept

    def apply(self, df: DataFrame, function: Callable[[pd.DataFrame], tuple | None], output: str) -> DataFrame:
        """keys and order_by of each row that emits, with what function makes of its window's rows, oldest first (a tuple of the fields
        of output; None: no row). Windows of rows only. The function gets slices of one frame, of df's columns: a task holds a
        block of rows and the rows before it, of one key or of the whole stream, and no lists of windows are made."""
        if self.rows is None:
            raise ValueError("a function is applied to windows of rows")
        names, made = [*self.keys, *self.order_by], [f.name for f in T.StructType.fromDDL(output)]
        columns, n, every, complete = df.columns, self.rows, self.every, self.complete

        def run(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("_g", ignore_index=True)
            rows, place = block[columns], block["_g"].to_numpy()
            own = (block["_in"] == block["_block"]).to_numpy() & ((place + 1) % every == 0)
            at, out = [], []
            for i in np.flatnonzero(own & (place + 1 >= n) if complete else own).tolist():
                if (x := function(rows.iloc[max(0, i + 1 - n) : i + 1])) is not None:
                    at.append(i)
                    out.append(x)
            return sent(pd.concat([rows[names].iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=made)], axis=1))

        schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), output])
        dealt = order.blocks(df, n, list(self.order_by), list(self.keys), self.hot)
        return dealt.groupBy(*self.keys, "_in").applyInPandas(run, schema)


def slid(slices: DataFrame, ends: DataFrame, keys: list[str], at: str, width: int, **aggregates: Column) -> DataFrame:
    """Each different (keys, at) of ends with aggregates of the slices of its key whose at lies in [at - width, at): panes put
    together from what rows were summed up to before, so no row is copied to the panes that hold it. Nulls, if there are none;
    ends without at go."""
    if width <= 0:
        raise ValueError("a pane has a width")
    asked = ends.where(F.col(at).isNotNull()).select(*keys, at).distinct().withColumn("_end", F.lit(True))
    both = order.time_blocks(asked.unionByName(slices.where(F.col(at).isNotNull()), allowMissingColumns=True), at, width, F.col("_end").isNull())
    w = Window.partitionBy(*keys, "_in").orderBy(at).rangeBetween(-width, -1)
    return both.withColumns({k: a.over(w) for k, a in aggregates.items()}).where("_end").select(*keys, at, *aggregates)


def batch(df: DataFrame, size: int, keys: list[str], order_by: list[str], hot: int | None = None, **aggregates: Column) -> DataFrame:
    """Tumbling windows of size rows, by keys or of the whole stream; the last may be smaller. With hot given, keys of more rows are
    dealt to many tasks."""
    if size <= 0:
        raise ValueError("a batch holds one row at least")
    if keys and hot:
        many, few = order.heavy(df, keys, hot)
        ids = order.running(many, {"_g": F.lit(1)}, order_by, keys).withColumn("batch", F.floor((F.col("_g") - 1) / size).cast("long"))
        return ids.groupBy(*keys, "batch").agg(*(a.alias(k) for k, a in aggregates.items())).unionByName(batch(few, size, keys, order_by, **aggregates))
    if keys:
        ids = df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)) - 1) / size).cast("long"))
    else:
        ids = order.numbered(df, order_by, "_g").withColumn("batch", F.floor(F.col("_g") / size).cast("long"))
    return ids.groupBy(*keys, "batch").agg(*(a.alias(k) for k, a in aggregates.items()))


def _entries(df: DataFrame, micros: int, keys: list[str], values: dict[str, Column], at: str) -> DataFrame:
    """Each row as it enters its key's window of time and, micros later (_gone), as it leaves it: with _when, _live (rows inside) and the
    sums of values inside, null if all are null. They run over both, as what leaves is taken off again."""
    parts = {f"_ev_{n}": v for n, v in values.items()} | {f"_ec_{n}": v.isNotNull().cast("long") for n, v in values.items()} | {"_one": F.lit(1)}
    into = df.withColumns(parts | {"_when": F.col(at), "_gone": F.lit(False)})
    out = df.withColumns(parts).where(F.col(at).isNotNull())
    out = out.select(*keys, *((-F.col(p)).alias(p) for p in parts), (F.col(at) + micros).alias("_when"), F.lit(True).alias("_gone"))
    both = into.unionByName(out, allowMissingColumns=True).withColumn("_timeless", F.col("_when").isNull())
    sums = {n: F.col(f"_ev_{n}") for n in values} | {f"_n_{n}": F.col(f"_ec_{n}") for n in values} | {"_live": F.col("_one")}
    met = order.running(both, sums, ["_when"], [*keys, "_timeless"], peers=True)
    return met.withColumns({n: F.when(F.col(f"_n_{n}") > 0, F.col(n)) for n in values})


def time_evict_sums(df: DataFrame, micros: int, keys: list[str], **values: Column) -> DataFrame:
    """As time_evict with sums of whole-numbered expressions; what an entry costs doesn't grow with the rows of its window."""
    if micros <= 0:
        raise ValueError("a window lasts a microsecond at least")
    met = _entries(df.where("us is not null"), micros, keys, values, "us")
    return met.where("_live > 0").select(*keys, F.col("_when").alias("at"), F.col("_gone").alias("evicted"), *values)


def time_evict(df: DataFrame, micros: int, keys: list[str], **aggregates: Column) -> DataFrame:
    """As Last by time, emitted at each row and at each leaving; at a leaving that empties the window, nothing.

    Rows: keys, at (microseconds), evicted, and the aggregates, which see nulls for leavings.
    """
    if micros <= 0:
        raise ValueError("a window lasts a microsecond at least")
    columns = [c for c in df.columns if c not in keys]
    into = df.select(*keys, *columns, F.col("us").alias("at"), F.lit(False).alias("evicted"))
    out = df.select(*keys, *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns), (F.col("us") + micros).alias("at"), F.lit(True).alias("evicted"))
    both = into.unionByName(out)
    if not keys:  # the whole stream: blocks of time, with the rows of the block before
        both = order.time_blocks(both, "at", micros, ~F.col("evicted"))
    w = Window.partitionBy(*(keys or ["_in"])).orderBy("at").rangeBetween(-(micros - 1), 0)
    both = both.withColumns({k: a.over(w) for k, a in aggregates.items()}).withColumn("_live", F.count("us").over(w))
    return (both if keys else both.where("_in = _block")).where("_live > 0").select(*keys, "at", "evicted", *aggregates)


def ticks(df: DataFrame, emitted: list[str], period: int, keys: list[str]) -> DataFrame:
    """The last emitted values of each key at each multiple of period (microseconds) from its first row to its last."""
    if period <= 0:
        raise ValueError("a period is positive")
    ends = df.groupBy(*keys).agg(F.min("us").alias("_a"), F.max("us").alias("_z"))
    grid = ends.select(*keys, F.explode(F.sequence(F.ceil(F.col("_a") / period) * period, F.floor(F.col("_z") / period) * period + period, F.lit(period))).alias("us"), F.lit(1).alias("_tick"), *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in emitted))
    rows = df.select(*keys, "us", F.lit(0).alias("_tick"), *emitted)
    if not keys:  # the whole stream, bucket by bucket
        said = F.when(F.col("_tick") == 0, F.struct(*emitted))
        return order.carried(rows.unionByName(grid), said, "_s", ["us", "_tick"]).where("_tick = 1").select("us", *(F.col("_s")[c].alias(c) for c in emitted))
    w = Window.partitionBy(*keys).orderBy("us", "_tick").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(grid).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in emitted})
    return both.where("_tick = 1").select(*keys, "us", *emitted)


def punct_batch(df: DataFrame, marker: Column, where: str, order_by: list[str], keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Windows between markers. where: the marker stands "before" or "after" its row, or "replace"s it."""
    value = F.coalesce(marker.cast("int"), F.lit(0))
    rows = order.running(df.withColumn("_m", value), {"_g": F.col("_m")}, order_by, keys)
    if where == "after":
        rows = rows.withColumn("_g", F.col("_g") - F.col("_m"))
    elif where == "replace":
        rows = rows.where("_m = 0")
    elif where != "before":
        raise ValueError("a marker stands before, after or in place of a row")
    return rows.groupBy(*(keys or []), F.col("_g").alias("window")).agg(*(a.alias(k) for k, a in aggregates.items()))
