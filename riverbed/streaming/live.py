"""Operators on live streams that keep state by key, and a sink whose batches can be written again.

Within a micro-batch, rows of a key are put in the order of order_by; across micro-batches they count as they arrive. Keys are
dealt to GROUPS groups: a task holds one group's rows of one micro-batch, which the source bounds (files or offsets per batch), and
the group's state: a row for each key, n of them, or what a user's function keeps. Only stateful() calls Python for each key. In sums, null values count as 0. State lives in the query's checkpoint, so a restart goes on exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.frames import sent
from .timed import opened, packed


#: Keys are dealt to so many groups, each of which has one state. A checkpoint holds for this number only.
GROUPS = 256

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PLAIN = (*_WHOLE, T.StringType, T.BooleanType, T.DateType, T.TimestampType)


def _ordered(frames: Iterator[pd.DataFrame], order_by: list[str]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True).sort_values(order_by, kind="stable", ignore_index=True)


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def stateful_many(df: DataFrame, keys: list[str], order_by: list[str], function: Callable[[pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]], output: str) -> DataFrame:
    """A function of the user's with state by key, over many keys at once: it is called for each group of keys, not for each key.

    It gets one frame: key by key (_key, a number that holds in this frame only) the rows that it has kept of that key (_new is
    false), in their order, then the key's rows of the micro-batch by order_by. It returns rows (of the schema output) and what
    it keeps: a frame of the same columns, with others of its own as it likes (missing in new rows), of all keys that go on. Keys
    that are whole numbers come as Int64. A restart under other columns is an error."""
    whole = [k for k in keys if isinstance(df.schema[k].dataType, _WHOLE)]
    columns = df.columns
    plain = all(isinstance(df.schema[k].dataType, _PLAIN) for k in keys)
    ids = keys if plain else ["_id"]
    source = df if plain else df.withColumn("_id", F.to_json(F.struct(*keys)))
    for k in whole:  # as pandas makes floats of whole numbers with nulls among them
        source = source.withColumns({f"_null_{k}": F.col(k).isNull(), k: F.coalesce(k, F.lit(0).cast(df.schema[k].dataType))})

    def run(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames, ignore_index=True)
        for k in whole:
            rows[k] = rows[k].astype("Int64").mask(rows.pop(f"_null_{k}").astype(bool))
        rows["_new"] = True
        if held.exists:
            was, data = held.get
            if was.split("\n") != columns:
                raise ValueError(f"the state holds rows of {was.split()}, the stream brings {columns}: it takes a new checkpoint")
            if len(before := opened(data)):
                rows = pd.concat([before.assign(_new=False), rows], ignore_index=True)
        rows["_key"] = rows.groupby(ids, dropna=False, sort=False).ngroup() if keys else 0
        old = rows[~rows["_new"]].sort_values("_key", kind="stable")
        new = rows[rows["_new"]].sort_values(["_key", *order_by], kind="stable")
        every = pd.concat([old, new]).sort_values("_key", kind="stable", ignore_index=True)
        out, kept = function(every)
        held.update(("\n".join(columns), packed(kept.drop(columns=["_key", "_new"]).reset_index(drop=True))))
        yield sent(out)

    grouped = source.withColumn("_group", F.pmod(F.xxhash64(*(F.col(k) for k in ids)) if keys else F.lit(0), F.lit(GROUPS)).cast("int"))
    return grouped.groupBy("_group").applyInPandasWithState(run, output, "columns string, kept binary", "append", GroupStateTimeout.NoTimeout)


def _starts(key: np.ndarray) -> np.ndarray:
    """Of each row the place of its key's first row; rows of a key stand together."""
    at = np.arange(len(key))
    return np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0)) if len(key) else at


def _to_end(key: np.ndarray) -> np.ndarray:
    """How many rows of its key come after each row."""
    ends = len(key) - 1 - _starts(key[::-1])[::-1]
    return ends - np.arange(len(key))


def running(df: DataFrame, keys: list[str], value: str, order_by: list[str]) -> DataFrame:
    """keys and order_by of each row, n (rows of its key so far) and total (the sum of a whole-numbered value so far)."""
    names = [*keys, *order_by]

    def run(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows[["_n", "_v"]] = rows[["_n", "_v"]].groupby(rows["_key"]).cumsum()
        out = rows.loc[rows["_new"], [*names, "_n", "_v"]].rename(columns={"_n": "n", "_v": "total"})
        return out, rows[_to_end(rows["_key"].to_numpy()) == 0]

    source = df.select(*names, F.lit(1).cast("long").alias("_n"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_v"))
    return stateful_many(source, keys, order_by, run, f"{_fields(df, names)}, n long, total long")


def last_n(df: DataFrame, n: int, keys: list[str], value: str, order_by: list[str]) -> DataFrame:
    """keys and order_by of each row, and total: the sum of a whole-numbered value over its key's last n rows."""
    if n <= 0:
        raise ValueError("a window holds one row at least")
    names = [*keys, *order_by]

    def run(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        key = rows["_key"].to_numpy()
        sums = np.r_[0, rows["_v"].to_numpy("int64").cumsum()]
        at = np.arange(len(rows))
        out = rows[names].assign(total=sums[1:] - sums[np.maximum(at - n + 1, _starts(key))])
        return out[rows["_new"]], rows[_to_end(key) < n - 1]

    source = df.select(*names, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_v"))
    return stateful_many(source, keys, order_by, run, f"{_fields(df, names)}, total long")


def join_last(left: DataFrame, right: DataFrame, keys: list[str], value: str, order_by: list[str]) -> DataFrame:
    """keys and order_by of each left row, with the whole-numbered value that the right stream said last for its key
    (null if nothing yet). At equal order_by[0], right rows come first."""
    names = [*keys, *order_by]
    by = [order_by[0], "_side", *order_by[1:]]

    def run(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        key, said = rows["_key"].to_numpy(), rows["_side"].to_numpy() == 0
        last = np.maximum.accumulate(np.where(said, np.arange(len(rows)), -1))  # of the rows so far, the last right one
        known = last >= _starts(key)
        values = rows["_v"].to_numpy("int64")[np.maximum(last, 0)]
        nothing = ~known | rows["_none"].to_numpy(bool)[np.maximum(last, 0)]
        out = rows[names].assign(value=pd.arrays.IntegerArray(values, nothing))[~said]
        ends = (_to_end(key) == 0) & known
        return out, rows.iloc[last[ends]]

    tagged = left.select(*names, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_v"), F.lit(True).alias("_none"))
    v = F.col(value).cast("long")
    both = tagged.unionByName(right.select(*names, F.lit(0).alias("_side"), F.coalesce(v, F.lit(0)).alias("_v"), v.isNull().alias("_none")))
    return stateful_many(both, keys, by, run, f"{_fields(left, names)}, value long")


def stateful(df: DataFrame, keys: list[str], order_by: list[str], function: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], output: str, state: str) -> DataFrame:
    """A function of the user's with state by key: it gets the key, the key's rows of a micro-batch in order, and its state
    (None at first), and returns rows (of the schema output) and the new state (a tuple of the schema state)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out, new = function(key, _ordered(frames, order_by), held.get if held.exists else None)
        held.update(new)
        yield out

    return df.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def windowed(df: DataFrame, n: int, keys: list[str], order_by: list[str], aggregate: Callable[[pd.DataFrame], tuple], output: str, every: int = 1) -> DataFrame:
    """keys and order_by of each every-th row of a key, with what aggregate makes (a tuple, of the fields of output; None: no
    row) of its last n rows, oldest first; windows that aren't full yet count too. State: n - 1 rows, of any columns, as Arrow
    IPC; a restart under other columns is an error."""
    if n <= 0 or every <= 0:
        raise ValueError("a window holds one row at least, and emits at each row or more seldom")
    names, made, columns = [*keys, *order_by], [f.name for f in T.StructType.fromDDL(output)], df.columns

    def step(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        key, new = rows["_key"].to_numpy(), rows["_new"].to_numpy(bool)
        starts, every_row = _starts(key), rows[columns]
        since = np.r_[0, new.cumsum()]
        before = rows["_seen"].groupby(rows["_key"]).transform("max").fillna(0).to_numpy("int64") if "_seen" in rows else 0
        seen = before + since[1:] - since[starts]  # rows of its key so far
        at, out = [], []
        for i in np.flatnonzero(new & (seen % every == 0)).tolist():
            if (x := aggregate(every_row.iloc[max(starts[i], i + 1 - n) : i + 1])) is not None:
                at.append(i)
                out.append(x)
        found = pd.concat([every_row[names].iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=made)], axis=1)
        return found, rows.assign(_seen=seen)[_to_end(key) < max(n - 1, 1)]

    return stateful_many(df, keys, order_by, step, f"{_fields(df, names)}, {output}")


def panes(df: DataFrame, at: str, duration: str, lag: str, keys: list[str], slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates of each key and event-time pane, once the greatest time seen less lag has reached the pane's end;
    rows that come later than that are left out. With slide given, a pane begins each so often and they overlap."""
    met = df.withWatermark(at, lag).groupBy(*keys, F.window(at, duration, slide).alias("_p")).agg(*(a.alias(k) for k, a in aggregates.items()))
    return met.select(*keys, F.unix_micros("_p.start").alias("start_us"), *aggregates)


def write_batches(df: DataFrame, out: str, checkpoint: str, mode: str = "append", done: Callable[[DataFrame, int], None] | None = None):
    """Start writing each micro-batch to its own folder of out, by its number; a batch that is tried again replaces itself.
    done, if given, is called with what was written and the batch's number, once it stands (again, if the batch is tried
    again). Ends when all that stands in the source at the start is done; returns the streaming query."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if done:
            done(batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch={number}"), number)

    return df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
