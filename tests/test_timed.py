"""Live windows of time with timers, state that ends, and un-keyed live operators, over stops and failures."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riverbed.operators import order
from riverbed.sources import tables
from riverbed.streaming import live, timed, whole
from tests.conftest import SMALL
from tests.test_live import rows, slices  # noqa: F401  (a fixture)

O = ["us", "event_id"]
HOUR = 3_600_000_000


def stream_of(spark, slices):
    return tables.events_of(spark.readStream.schema(slices[3]).option("maxFilesPerTrigger", 1).parquet(f"{slices[1]}/in"))


def test_time_window_over_a_restart(spark, slices):
    put, base, every, _ = slices
    for part in ((0, 1), (2, 3)):
        for i in part:
            put(i)
        stream = stream_of(spark, slices).select("user_id", "ts", "event_id", "cents")
        out = timed.time_window(stream, ["user_id"], "ts", 24 * HOUR, 12 * HOUR, lambda w: (len(w), int(w["event_id"].iloc[0])), "n long, oldest long", "1 hour")
        live.write_batches(out, f"{base}/out", f"{base}/state").awaitTermination()
    end = every.agg(F.max("us")).first()[0] // 1000 * 1000 - HOUR
    w = F.window("ts", "24 hours", "12 hours")
    want = every.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("us", "event_id")).alias("oldest"))
    want = want.select(F.unix_micros("w.end").alias("at"), "user_id", "n", "oldest").where(F.col("at") <= end)
    assert rows(spark.read.parquet(f"{base}/out").select("at", "user_id", "n", "oldest")) == rows(want)
    with pytest.raises(ValueError):
        timed.time_window(stream, ["user_id"], "ts", 10, 10, len, "n long", "1 hour")


def test_other_columns_are_refused(spark, slices):
    put, base, _, _ = slices
    put(0)
    make = lambda s: timed.time_window(s, ["user_id"], "ts", 48 * HOUR, 12 * HOUR, lambda w: (len(w),), "n long", "1 hour")
    live.write_batches(make(stream_of(spark, slices).select("user_id", "ts", "cents")), f"{base}/out", f"{base}/state").awaitTermination()
    put(1)
    with pytest.raises(Exception, match="new checkpoint"):
        live.write_batches(make(stream_of(spark, slices).select("user_id", "ts", "k")), f"{base}/out", f"{base}/state").awaitTermination()


def test_idle_keys_leave_the_store(spark, slices):
    """State of a key ends six hours after its last row; what the store holds is what batch code says is still alive."""
    put, base, every, _ = slices
    for i in range(4):
        put(i)

    def count(key, new, before):
        n = before[0] if before else 0
        return new[["user_id", *O]].assign(n=range(n + 1, n + 1 + len(new))), (n + len(new),)

    ttl = 6 * HOUR // 1000
    out = timed.stateful(stream_of(spark, slices).select("user_id", "ts", *O), ["user_id"], "ts", O, count, "user_id long, us long, event_id long, n long", "n long", ttl, "0 seconds")
    live.write_batches(out, f"{base}/out", f"{base}/state").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == every.count()
    end = every.agg(F.max("us")).first()[0] // 1000
    alive = every.groupBy("user_id").agg((F.floor(F.max("us") / 1000) + ttl).alias("until")).where(F.col("until") > end)
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{base}/state")
    assert sorted(r["key"]["user_id"] for r in held.select("key").collect()) == sorted(r["user_id"] for r in alive.collect())
    assert 0 < alive.count() < every.select("user_id").distinct().count()


@pytest.mark.parametrize("name", ["numbered", "last_n"])
def test_unkeyed_after_a_failed_batch(spark, slices, name):
    put, base, every, _ = slices
    for i in range(4):
        put(i)
    step = {"numbered": whole.numbered(O), "last_n": whole.last_n(300, {"s": F.sum("cents"), "n": F.count(F.lit(1))}, O)}[name]
    failed = []

    def done(number):
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    def start():
        return whole.write_steps(stream_of(spark, slices).select(*O, "cents"), step, f"{base}/out", f"{base}/state", done)

    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    e = every.select(*O, "cents")
    w = Window.partitionBy(F.lit(1)).orderBy(*O).rowsBetween(-299, 0)
    want = order.numbered(e, O) if name == "numbered" else e.withColumns({"s": F.sum("cents").over(w), "n": F.count(F.lit(1)).over(w)})
    assert failed and rows(spark.read.parquet(f"{base}/out").select(*want.columns)) == rows(want)


def test_windows_are_readable(spark):
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    assert timed.opened(timed.packed(frame), ["a", "b"]).equals(frame)
    with pytest.raises(ValueError):
        timed.opened(timed.packed(frame), ["a"])


def test_an_empty_stream(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = tables.events_of(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    for i, step in enumerate((whole.numbered(O), whole.outliers("cents", 1.5, O), whole.late_panes(O, HOUR, 0, HOUR, "cents"), whole.join_last(F.col("k") > 1, ["cents"], O))):
        whole.write_steps(stream, step, f"{tmp_path}/out{i}", f"{tmp_path}/state{i}").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out{i}").count() == 0
