"""Operators by key with timers and state that ends: live windows of time that emit at a period, and state dropped when a key is idle.

State is kept in RocksDB, a map entry for each slice of time, so a micro-batch rewrites the slices that its rows fall in and no others.
Rows are kept as Arrow IPC, which any reader of Arrow can open. Both need the state store provider of RocksDB in the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The class that spark.sql.streaming.stateStore.providerClass must name.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(data: bytes, columns: list[str] | None = None) -> pd.DataFrame:
    rows = pa.ipc.open_stream(data).read_pandas()
    if columns is not None and list(rows.columns) != columns:
        raise ValueError(f"the state holds rows of {list(rows.columns)}, the stream brings {columns}: it takes a new checkpoint")
    return rows


def _rows(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """All rows of a key, under the columns' own names: the frames come from named tuples, which rename some."""
    return pd.concat(frames, ignore_index=True).set_axis(columns, axis=1)


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), more])


class _Windows(StatefulProcessor):
    def __init__(self, columns: list[str], keys: list[str], micros: int, period: int, aggregate: Callable[[pd.DataFrame], tuple | None], names: list[str]):
        self.columns, self.keys, self.micros, self.period, self.aggregate, self.names = columns, keys, micros, period, aggregate, names

    def init(self, handle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "slice long", "rows binary")
        self.next = handle.getValueState("next", "at long")

    def _due(self, at: int) -> None:
        """The next emission of this key, once the watermark has reached at."""
        self.next.update((at,))
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows, self.columns)
        place = new["_us"] // self.period
        for s, part in new.groupby(place):
            if self.slices.containsKey((int(s),)):
                part = pd.concat([opened(self.slices.getValue((int(s),))[0], self.columns), part], ignore_index=True)
            self.slices.updateValue((int(s),), (packed(part),))
        first = (int(place.min()) + 1) * self.period
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if first <= passed:  # rows that come late: windows that have been emitted aren't emitted again
            first = (passed // self.period + 1) * self.period
        if not self.next.exists() or first < self.next.get()[0]:
            if self.next.exists():
                self.handle.deleteTimer(-(-self.next.get()[0] // 1000))
            self._due(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Emit the windows that end by the watermark, evict slices that no later one holds."""
        upto, at, out = timerValues.getCurrentWatermarkInMs() * 1000, self.next.get()[0], []
        slices = sorted(k[0] for k in self.slices.keys())  # noqa: SIM118  (a map state)
        held = {}
        while at <= upto:
            low = (at - self.micros) // self.period
            for s in [s for s in slices if s < low]:
                self.slices.removeKey((s,))
                held.pop(s, None)
            slices = [s for s in slices if s >= low]
            if not slices:
                break
            inside = [s for s in slices if s * self.period < at]
            if inside:
                for s in inside:
                    if s not in held:
                        held[s] = opened(self.slices.getValue((s,))[0], self.columns)
                rows = pd.concat([held[s] for s in inside], ignore_index=True)
                rows = rows[(rows["_us"] >= at - self.micros) & (rows["_us"] < at)].sort_values("_us", kind="stable", ignore_index=True)
                if len(rows) and (made := self.aggregate(rows)) is not None:
                    out.append((at, *key, *made))
                at += self.period
            else:  # nothing until the next slice's end
                at = (slices[0] + 1) * self.period
        if slices:
            self._due(at)
        else:
            self.next.clear()
        yield pd.DataFrame(out, columns=["at", *self.keys, *self.names]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def time_window(df: DataFrame, keys: list[str], at: str, micros: int, period: int, aggregate: Callable[[pd.DataFrame], tuple | None], output: str, lag: str) -> DataFrame:
    """at (microseconds) and keys of each multiple of period, with what aggregate makes (a tuple of the fields of output; None: no
    row) of its key's rows in [at - micros, at), in the order of time: at most once, when the greatest time seen less lag has
    reached it. An empty window gives no row; a row that comes later than lag counts in the windows that are still to come.

    aggregate gets a frame of df's columns but the keys, and _us, the microseconds of the column at. Rows without a time are left
    out. State: of each key the rows of one window, by slices of period; a key without rows in its window has none.
    """
    if micros <= 0 or period <= 0 or period % 1000:
        raise ValueError("a window lasts a microsecond at least, a period whole milliseconds")
    names = [f.name for f in T.StructType.fromDDL(output)]
    source = df.where(F.col(at).isNotNull()).withWatermark(at, lag).withColumn("_us", F.unix_micros(at))
    processor = _Windows(source.columns, keys, micros, period, aggregate, names)
    out = source.groupBy(*keys).transformWithStateInPandas(processor, f"at long, {_schema(df, keys, output)}", "append", "EventTime")
    return out


class _Idle(StatefulProcessor):
    def __init__(self, columns: list[str], order_by: list[str], function, state: str, ttl: int):
        self.columns, self.order_by, self.function, self.state, self.ttl = columns, order_by, function, state, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows, self.columns).sort_values(self.order_by, kind="stable", ignore_index=True)
        until = int(new["_us"].max()) // 1000 + self.ttl
        before = self.held.get() if self.held.exists() else None
        if before is not None and int(new["_us"].min()) // 1000 > self.until.get()[0]:
            before = None  # these rows come after the state's end, though its timer hasn't fired yet
        out, state = self.function(key, new.drop(columns="_us"), before)
        self.held.update(state)
        if self.until.exists():
            until = max(until, self.until.get()[0])
            self.handle.deleteTimer(self.until.get()[0])
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.until.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], at: str, order_by: list[str], function: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], output: str, state: str, ttl: int, lag: str) -> DataFrame:
    """As live.stateful, but a key's state ends: ttl milliseconds of event time after its last row it is dropped from the store,
    and a row that comes later than that finds none. Rows without a time are left out."""
    if ttl <= 0:
        raise ValueError("state lives a millisecond at least")
    source = df.where(F.col(at).isNotNull()).withWatermark(at, lag).withColumn("_us", F.unix_micros(at))
    return source.groupBy(*keys).transformWithStateInPandas(_Idle(source.columns, order_by, function, state, ttl), output, "append", "EventTime")
