"""Steps that once grew faster than their input, against plain forms of them on odd rows."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riverbed.jobs import live_jobs, registry
from riverbed.operators import joins, windows
from riverbed.operators.windows import Last
from riverbed.streaming import live
from tests.conftest import SMALL
from tests.test_live import rows_or_none

ODD = [(1, 5, 7), (1, 5, None), (2, 6, 1), (2, 30, None), (1, 31, -4), (None, 32, 3), (None, 33, 9), (1, None, 8), (1, None, 2), (2, None, None)]


def same(a, b):
    return sorted(map(str, rows_or_none(a))) == sorted(map(str, rows_or_none(b)))


@pytest.mark.parametrize("keys", [(), ("user_id",)])
def test_sums_of_a_window_of_time(spark, keys):
    """Equal times, nulls of all kinds; windows that hold nothing but nulls."""
    df = spark.createDataFrame(ODD, "user_id long, us long, cents long")
    w = Last(micros=3, keys=keys, order_by=("us",))
    got = w.sums(df, n=F.lit(1), s=F.col("cents"))
    assert same(got.withColumn("n", F.col("n").cast("long")), w.aggregate(df, n=F.count(F.lit(1)), s=F.sum("cents")))
    got = windows.time_evict_sums(df, 3, list(keys), s=F.col("cents"))
    assert same(got, windows.time_evict(df, 3, list(keys), s=F.sum("cents")))
    assert w.sums(df.limit(0), s=F.col("cents")).count() == 0
    with pytest.raises(ValueError):
        Last(rows=3).sums(df, s=F.col("cents"))
    with pytest.raises(ValueError):
        windows.time_evict_sums(df, 0, [], s=F.col("cents"))


def test_a_dense_window_sorts_no_more_than_its_entries(spark):
    """All rows lie in one window: each once as it enters and once as it leaves, no frame that slides over them."""
    df = spark.range(1000).select(F.col("id").alias("us"), F.lit(1).alias("cents"))
    got = Last(micros=10**9, order_by=("us",)).sums(df, s=F.col("cents"))
    assert [r["s"] for r in got.orderBy("us").collect()] == list(range(1, 1001))
    assert "RangeFrame, -" not in got._jdf.queryExecution().toString()


def test_keys_share_calls_of_python(spark, tmp_path):
    """Two micro-batches of 3,000 keys, a null one and whole numbers that no double holds: a call for each group, not for each key."""
    big = 2**60
    df = spark.range(6000).select(F.when(F.col("id") % 3000 != 0, F.col("id") % 3000 + big).alias("k"), F.col("id").alias("us"), (F.col("id") + big).alias("v"))
    calls = spark.sparkContext.accumulator(0)

    def seen(rows):
        calls.add(1)
        n = rows.assign(_n=rows["_n"].fillna(0) if "_n" in rows else 0)
        n["_n"] = n.groupby("_key")["_n"].transform("max") + n["_new"].groupby(n["_key"]).cumsum()
        return n.loc[n["_new"], ["k", "us", "v"]].assign(n=n["_n"].astype("int64")), n.groupby("_key").tail(1)

    for i, part in enumerate((df.where("us < 3000"), df.where("us >= 3000"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        live.write_batches(live.stateful_many(stream, ["k"], ["us"], seen, "k long, us long, v long, n long"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert calls.value <= (i + 1) * live.GROUPS
    got = spark.read.parquet(f"{tmp_path}/out").select("k", "us", "v", "n")
    assert same(got, df.withColumn("n", F.floor(F.col("us") / 3000) + 1))


def test_micro_batches_grow_not_in_number(spark, monkeypatch):
    """However many rows there are, the table is cut in so many micro-batches."""
    asked = []
    monkeypatch.setattr(live_jobs, "SLICE_ROWS", 10)
    monkeypatch.setattr(live_jobs, "_slices", lambda spark, raw, n, path, by: asked.append(n) or slices_of(spark, raw, n, path, by))
    assert live_jobs.stream_panes(spark, SMALL).count() > 0
    assert asked == [2 * live_jobs.SLICES]


def test_lists_of_a_window_of_time_are_cut_from_blocks(spark, monkeypatch):
    """A block's values are put in order once, no frame gathers them anew for each row; as lists and as text, in parts of two rows."""
    monkeypatch.setattr(joins, "DEALT", 2)
    times = [-7, -1, 0, 0, 1, 4, 5, 5, 6, 9, 10, 14, 30, None]
    left = [(k, t, f"{k}{i}") for k in (None, 1, 2) for i, t in enumerate(times)] * 2
    right = [(k, t, v) for k in (None, 1) for t in times for v in (None, -3, 12)]
    l, r = spark.createDataFrame(left, "k long, us long, x string"), spark.createDataFrame(right, "k long, us long, v long")
    held = lambda k, t: [v for _, v in sorted(((u, v) for q, u, v in right if q == k and None not in (u, t) and t - 5 < u <= t), key=lambda p: (p[0], p[1] is not None, p[1] or 0))]
    got = joins.join_last_time(l, r, 5, ["k"], "v")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*row, held(*row[:2]))) for row in left)
    text = joins.join_last_time(l, r, 5, ["k"], "v", text=("é;", "none"))
    assert sorted(map(str, map(tuple, text.collect()))) == sorted(str((*row, "é;".join("none" if v is None else str(v) for v in held(*row[:2])))) for row in left)
    for df in (got, text):
        assert not any("collect_list" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x)


def test_long_lists_of_a_window_of_time_come_first(spark, tmp_path):
    """A Parquet writer looks at its memory again after as many rows as still fit by the size of those it has. So short rows don't
    stand before long ones, and a row group stays near its size, though 20,000 keys have a value and one has 400 in each window."""
    n = 400
    sides = lambda v: spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).alias("us"), v.alias("v")).union(spark.range(5 * n).select(F.lit(10**6), F.col("id"), v))
    left, right = sides(F.lit(0)).drop("v"), sides(F.col("id") + 1000)
    out = {text: joins.join_last_time(left, right, n, ["k"], "v", text=text) for text in (None, (",", "-"))}
    for text, df in out.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" not in plan.split("SortMergeJoin")[0]  # rows come from the join as they are
        sizes, size = {}, F.length("items") + 1 if text else F.size("items")
        for part, found in df.select(F.spark_partition_id(), size).collect():
            sizes.setdefault(part, []).append(found.bit_length())
        assert sizes and all(x == sorted(x, reverse=True) for x in sizes.values())
    block = 1 << 18
    out[",", "-"].write.options(**{"parquet.block.size": block, "parquet.enable.dictionary": "false"}).parquet(f"{tmp_path}/out")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("out/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 20_000 + 5 * n and max(g.total_byte_size for g in groups) < 1.5 * block


def test_a_python_function_gets_many_groups(spark):
    """udaf_batch calls Python for shares of the groups, not for each."""
    plan = registry.QUERIES["udaf_batch"](spark, SMALL)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas [_share" in plan


slices_of = live_jobs._slices
