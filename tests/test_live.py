"""Live operators over several micro-batches, stopped and restarted, against the batch operators."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riverbed.jobs import live_jobs, registry
from riverbed.operators import joins
from riverbed.sources import tables
from riverbed.streaming import live
from tests.conftest import SMALL

O = ["us", "event_id"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def slices(spark, tmp_path):
    """Four files of the event table in the order of time, put into a folder one by one."""
    raw = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id is not null").orderBy("ts", "event_id").limit(800)
    pdf = raw.toPandas()
    step = -(-len(pdf) // 4)

    def put(i):
        spark.createDataFrame(pdf[i * step : (i + 1) * step], raw.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put, str(tmp_path), tables.events_of(spark.createDataFrame(pdf, raw.schema)), raw.schema


def run(spark, slices, make):
    """All files, with a stop half way: two runs on one checkpoint."""
    put, base, _, schema = slices
    for part in ((0, 1), (2, 3)):
        for i in part:
            put(i)
        stream = tables.events_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        live.write_batches(out := make(stream), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*out.columns)


def test_running_goes_on_after_a_restart(spark, slices):
    w = Window.partitionBy("user_id").orderBy(*O).rowsBetween(Window.unboundedPreceding, 0)
    want = slices[2].select("user_id", *O, F.count(F.lit(1)).over(w), F.sum(F.coalesce("cents", F.lit(0))).over(w))
    assert rows(run(spark, slices, lambda s: live.running(s, ["user_id"], "cents", O))) == rows(want)


def test_last_n_across_batches(spark, slices):
    w = Window.partitionBy("user_id").orderBy(*O).rowsBetween(-2, 0)
    want = slices[2].select("user_id", *O, F.sum(F.coalesce("cents", F.lit(0))).over(w))
    assert rows(run(spark, slices, lambda s: live.last_n(s, 3, ["user_id"], "cents", O))) == rows(want)


def test_join_last_across_batches(spark, slices):
    is_left = F.col("event_id") % 2 == 0
    want = joins.join_last(slices[2].where(is_left).select("user_id", *O), slices[2].where(~is_left).select("user_id", *O, "cents"), ["user_id"], ["cents"], O)
    got = run(spark, slices, lambda s: live.join_last(s.where(is_left), s.where(~is_left), ["user_id"], "cents", O))
    assert sorted(map(str, rows_or_none(got))) == sorted(map(str, rows_or_none(want.select("user_id", *O, "cents"))))


def rows_or_none(df):
    return [tuple(r) for r in df.collect()]


def test_counter_and_bad_sizes(spark, tmp_path):
    df = tables.live_counter(spark, 10, copies=2)
    q = df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}")).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.awaitTermination(8)
    finally:
        q.stop()
    first = spark.read.parquet(f"{tmp_path}/out/b=0")
    assert first.count() == 20 and first.select("n").distinct().count() == 10
    with pytest.raises(ValueError):
        tables.live_counter(spark, 0)
    with pytest.raises(ValueError):
        live.last_n(df, 0, ["n"], "n", ["n"])


@pytest.fixture(scope="module")
def unordered(spark, tmp_path_factory):
    """An event table of 140 files, each with rows of all times."""
    base = str(tmp_path_factory.mktemp("unordered"))
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(140).write.parquet(f"{base}/events.parquet")
    return base


@pytest.mark.parametrize("slice_rows", [400, 1_000_000])
@pytest.mark.parametrize("name", ["stream_panes", "stream_state_running", "stream_last_n", "stream_join_last"])
def test_many_unordered_files(spark, unordered, monkeypatch, name, slice_rows):
    monkeypatch.setattr(live_jobs, "SLICE_ROWS", slice_rows, raising=False)
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{unordered}/events.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, unordered)
    want = con.sql(registry.ORACLES[name]).project(", ".join(got.columns)).fetchall()
    assert sorted(map(str, rows_or_none(got))) == sorted(str(tuple(r)) for r in want)


def test_a_failed_batch_is_tried_again(spark, slices):
    """The sink fails in the middle of a batch, after it has written: state and output go on as if it hadn't."""
    put, base, every, schema = slices
    for i in range(4):
        put(i)
    failed = []

    def done(batch, number):
        if number == 2 and not failed:
            failed.append(batch.count())
            raise RuntimeError("lost")

    def start():
        stream = tables.events_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        return live.write_batches(live.running(stream, ["user_id"], "cents", O), f"{base}/out", f"{base}/state", done=done)

    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    w = Window.partitionBy("user_id").orderBy(*O).rowsBetween(Window.unboundedPreceding, 0)
    want = every.select("user_id", *O, F.count(F.lit(1)).over(w), F.sum("cents").over(w))
    assert failed and rows(spark.read.parquet(f"{base}/out").select("user_id", *O, "n", "total")) == rows(want)


def test_windowed_across_batches(spark, slices):
    """A user's aggregate of a live window, at each second row of a key, over a stop."""
    w = Window.partitionBy("user_id").orderBy(*O)
    want = slices[2].select("user_id", *O, F.max("value").over(w.rowsBetween(-2, 0)).alias("m"), F.row_number().over(w).alias("r")).where("r % 2 = 0").drop("r")
    make = lambda s: live.windowed(s.select("user_id", *O, "value"), 3, ["user_id"], O, lambda x: (float(x["value"].max()),), "m double", every=2)
    assert rows(run(spark, slices, make)) == rows(want)


def test_join_last_keeps_nulls(spark, slices):
    """A right row that says null is what was said last, in the live form as in the batch form."""
    is_left = F.col("event_id") % 2 == 0
    said = F.when(F.col("event_id") % 3 != 0, F.col("cents"))
    want = joins.join_last(slices[2].where(is_left).select("user_id", *O), slices[2].where(~is_left).select("user_id", *O, said.alias("v")), ["user_id"], ["v"], O)
    got = run(spark, slices, lambda s: live.join_last(s.where(is_left), s.where(~is_left).withColumn("v", said), ["user_id"], "v", O))
    assert sorted(map(str, rows_or_none(got))) == sorted(map(str, rows_or_none(want.select("user_id", *O, "v"))))
    assert got.where("value is null").count() > 0


@pytest.mark.parametrize("seconds", [0.4, 2])
def test_period_in_real_time(spark, tmp_path, seconds):
    query = tables.live_period(spark, seconds, copies=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    query.awaitTermination(9)
    query.stop()
    found = sorted((r["n"], r["copy"], r["timestamp"].timestamp()) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    turns = [t for _, copy, t in found if copy == 0]
    assert len(turns) >= 3 and [f[:2] for f in found] == [(n, c) for n in range(len(turns)) for c in (0, 1)]
    assert all(b - a == pytest.approx(seconds, abs=0.002) for a, b in zip(turns, turns[1:], strict=False))
    with pytest.raises(ValueError):
        tables.live_period(spark, 0)
