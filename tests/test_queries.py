"""Each registered query of the stream library against its SQL, on the smallest tables; golden vectors; error cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.functions import schema, topics, values
from riverbed.jobs import registry
from riverbed.operators import analytics, joins, order, rows, windows
from riverbed.operators.windows import Last
from riverbed.sources import tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{SMALL}/{f}')")
    return c


def normal(rows_):
    def one(x):
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x)
        return repr(round(float(x), 9)) if isinstance(x, (int, float)) and not math.isnan(x) else str(x)

    return sorted(tuple(map(one, r)) for r in rows_)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL)
    want = con.sql(registry.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    assert normal(got.select(*(F.col(f"`{n}`") for n in names)).collect()) == normal(want.project(quoted).fetchall())


def test_score_model(spark):
    got = registry.QUERIES["score_model"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count() and got.where("nearest is null").count() == 0


def test_score_model_many_labels(spark, tmp_path):
    """More labels than one pass takes: each vector is its own centroid."""
    rows = spark.range(10_050).select(F.col("id").alias("vec_id"), F.col("id").cast("int").alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["score_model"](spark, str(tmp_path))
    assert got.count() == 10_050 and got.where("nearest is null or nearest <> label").count() == 0


def seq(spark, items, *names):
    return spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)], ["us", *names]).withColumn("event_id", F.col("us"))


def test_windows_golden(spark):
    n = seq(spark, [1, 2, 3, 4, 5, 6, 7], "v")
    assert [r.s for r in Last(rows=3).aggregate(n, s=F.sum("v")).orderBy("us").collect()] == [1, 3, 6, 9, 12, 15, 18]
    n = seq(spark, list(range(1, 16)), "v")
    assert [r.a for r in Last(rows=10).trigger(2).aggregate(n, a=F.avg("v")).orderBy("us").collect()] == [1.5, 2.5, 3.5, 4.5, 5.5, 7.5, 9.5]
    n = seq(spark, list(range(12)), "v")
    out = Last(rows=4, every=3, complete=True).aggregate(n, m=F.max("v")).orderBy("us").collect()
    assert [r.m for r in out] == [5, 8, 11]
    n = seq(spark, list(range(20)), "v")
    assert sorted(r.s for r in windows.batch(n, 4, [], ["us"], s=F.sum("v")).collect()) == [6, 22, 38, 54, 70]
    keyed = seq(spark, [("a", 1), ("b", 7), ("a", 2), ("b", 9), ("a", 4), ("a", 5), ("b", 8), ("b", 17), ("a", 10)], "c", "d")
    assert sorted((r.c, r.s) for r in windows.batch(keyed, 2, ["c"], ["us"], s=F.sum("d")).collect()) == [("a", 3), ("a", 9), ("a", 10), ("b", 16), ("b", 25)]
    flagged = seq(spark, list(range(1, 11)), "v")
    out = windows.punct_batch(flagged, F.col("v") % 5 == 0, "after", ["us"], s=F.sum("v"), m=F.max("v"))
    assert sorted((r.s, r.m) for r in out.collect()) == [(15, 5), (40, 10)]
    for bad in (lambda: Last(rows=0), lambda: Last(micros=-1), lambda: Last(), lambda: windows.batch(n, 0, [], ["us"]), lambda: windows.ticks(n, [], 0, [])):
        with pytest.raises(ValueError):
            bad()


def test_order_helpers_equal_one_task(spark):
    """With tiny buckets and blocks, the same as one sort of everything."""
    e = registry.QUERIES["add_seq"](spark, SMALL)
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id")
    from pyspark.sql import Window

    plain = ev.withColumn("s", F.sum("user_id").over(Window.orderBy("us", "event_id").rowsBetween(-4, 0))).select("event_id", "s")
    mine = order.last_n(ev, 5, {"s": F.sum("user_id")}, ["us", "event_id"], block=7, width=10_000_000_000).select("event_id", "s")
    assert mine.exceptAll(plain).count() == 0 and mine.count() == plain.count() == e.count()


def test_joins_golden(spark):
    right = seq(spark, [("a", "a1"), ("b", "b1"), ("c", "c1"), ("a", "a2"), ("a", "a3"), ("c", "c2")], "k", "v")
    left = seq(spark, ["a", "b", "c", "d"], "k").withColumn("us", F.col("us") + 100)
    assert [r.v for r in joins.join_last(left, right, ["k"], ["v"], ["us", "event_id"]).orderBy("us").collect()] == ["a3", "b1", "c2", None]
    assert [r["items"] for r in joins.join_last_n(left, right, 2, ["k"], "v", ["us"], ["event_id"]).orderBy("event_id").collect()] == [["a2", "a3"], ["b1"], ["c1", "c2"], []]
    assert [r["items"] for r in joins.join_last_n(left, right, 3, [], "v", ["us"], ["event_id"]).collect()] == [["a2", "a3", "c2"]] * 4


def test_topics_table():
    import re

    for name, f in (("a/b/c", "a/b/c"), ("a", "+"), ("a/b", "+/b"), ("/b", "+/b"), ("a/b/c", "a/+/c"), ("d//f", "d/+/f"), ("/c/", "+/c/"), ("a", "#"), ("/", "#"), ("a/b/c", "a/#"), ("a", "a/#"), ("//c", "//c/#")):
        assert re.search(topics.pattern(f), name)
    for name, f in (("a/b/d", "a/b/c"), ("a/b", "+"), ("a/c", "+/b"), ("d/a/f/", "+/+/+"), ("e//f", "d/+/f"), ("d/f", "a/#"), ("a/c/e", "a/b/#"), ("x//c", "//c/#"), ("ab", "a/#")):
        assert not re.search(topics.pattern(f), name)


def test_schemas(spark):
    s = schema.parse_schema("tuple<int32 a, rstring[5] b, list<optional<float64>> c, map<rstring, uint16>[3] d, optional<tuple<boolean x>> e, uint64 f>")
    assert [f.dataType.simpleString() for f in s] == ["int", "string", "array<double>", "map<string,int>", "struct<x:boolean>", "decimal(20,0)"]
    assert [f.nullable for f in s] == [False] * 4 + [True, False]
    for bad in ("", "int32 a", "tuple<>", "tuple<int32>", "tuple<int33 a>", "tuple<int32 a", "tuple<int32 a>>", "tuple<int32 a, int32 a>", "tuple<list<> a>"):
        with pytest.raises(ValueError):
            schema.parse_schema(bad)
    out = schema.conform(spark.createDataFrame([(None, "x")], "a int, b string"), schema.parse_schema("tuple<int32 a, rstring b, list<int32> c, timestamp t>")).first()
    assert (out.a, out.b, out.c) == (0, "x", [])


def test_json_and_rows(spark):
    j = spark.createDataFrame([('{"a":"abc","g":[{"v":"hello"},{"v":"bye","a":"def"}]}',), ('{"g":["x"]}',), ("{}",), ('{"g":[]}',)], "j string")
    got = sorted(r[0] for r in values.flatten_array(j, "j", "g", "a").collect())
    assert got == sorted(['{"v":"hello","a":"abc"}', '{"v":"bye","a":"def"}', '{"payload":"x"}'])
    good, bad = rows.catch(spark.createDataFrame([("1",), ("five",), ("3",)], "s string"), "s", "int")
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(ValueError):
        rows.sample(j, 2.0, "j")
    n = spark.createDataFrame([(418, "325")], T.StructType([T.StructField("ii", T.IntegerType()), T.StructField("ss", T.StringType())]))
    assert n.select(values.tuple_string(n)).first()[0] == '{ii=418,ss="325"}'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sort_of_everything_in_one_task(spark):
    """Windows over a whole stream: one task gets rows of buckets at most, and sums of them."""
    e = tables.events(spark, SMALL).select("us", "event_id", "cents")
    frames = [Last(micros=10**9).aggregate(e, s=F.sum("cents")), windows.time_evict(e, 10**9, [], s=F.sum("cents")), order.last_n(e, 5, {"s": F.sum("cents")}, ["us"])]
    for df in frames:
        text = plan(df)
        assert "Window" in text
        for part in text.split("SinglePartition")[1:]:  # only what has been summed by bucket
            assert "sum" in part.split("Scan")[0] and "_bucket" in part.split("Scan")[0]
    assert not any("SinglePartition" in plan(f) for f in frames[:2])
    with pytest.raises(ValueError):
        Last(micros=5, complete=True)


def test_joins_of_odd_rows(spark):
    """Null keys meet null keys, rows without an order come first, left rows that repeat stay: the same in each form."""
    left = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 1, "a"), (None, 5, 2, "b"), (2, None, 3, "c"), (3, 9, 4, "d")], "k long, us long, event_id long, x string")
    right = spark.createDataFrame([(1, 3, 10, 7), (None, 4, 11, None), (None, 2, 12, 8), (2, None, 13, 9), (1, 6, 14, 1)], "k long, us long, event_id long, v long")
    want = sorted(map(str, [(1, 5, 1, "a", 7), (1, 5, 1, "a", 7), (None, 5, 2, "b", None), (2, None, 3, "c", 9), (3, 9, 4, "d", None)]))
    for width in (None, 2, 100):
        got = joins.join_last(left, right, ["k"], ["v"], ["us", "event_id"], width)
        assert sorted(map(str, map(tuple, got.collect()))) == want
    lists = {str(tuple(r[:4])): r["items"] for r in joins.join_last_n(left, right, 2, ["k"], "v", ["us", "event_id"]).collect()}
    assert lists == {"(1, 5, 1, 'a')": [7], "(None, 5, 2, 'b')": [8, None], "(2, None, 3, 'c')": [9], "(3, 9, 4, 'd')": []}
    timed = joins.join_last_time(left, right, 3, ["k"], "v").collect()
    assert len(timed) == 5 and {str(tuple(r[:4])): r["items"] for r in timed} == {"(1, 5, 1, 'a')": [7], "(None, 5, 2, 'b')": [None], "(2, None, 3, 'c')": [], "(3, 9, 4, 'd')": []}
    empty = joins.join_last(left.where("false"), right, [], ["v"], ["us", "event_id"])
    assert empty.count() == 0 and joins.join_last(left, right.where("false"), [], ["v"], ["us", "event_id"]).where("v is null").count() == 5


def test_nulls_quotes_and_bad_json(spark):
    n = spark.createDataFrame([(1, None), (None, 'a"b\\c')], "a int, b string")
    assert [r[0] for r in values.as_json(n).collect()] == ['{"a":1,"b":null}', '{"a":null,"b":"a\\"b\\\\c"}']
    assert [r[0] for r in n.select(values.tuple_string(n)).collect()] == ["{a=1,b=null}", '{a=null,b="a\\"b\\\\c"}']
    j = spark.createDataFrame([("[1]",), ("{oops",)], "j string")
    assert [r[0] for r in j.select(values.json_object(F.col("j"))).collect()] == ['{"payload":[1]}', None]
    with pytest.raises(Exception):
        j.select(values.json_object(F.col("j"), strict=True)).collect()
    assert rows.union(n) is n


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.counter(spark, -1)
    assert [tuple(r) for r in tables.counter(spark, 4, F.when(F.col("n") > 1, F.col("n") * 2)).collect()] == [(2, 4), (3, 6)]
    assert [tuple(r) for r in tables.constants(spark, [("a", 1), None, ("b", 2)], "x string, y int").orderBy("_i").collect()] == [(0, "a", 1), (1, "b", 2)]
    for name, text in (("one.txt", "a\nb\n"), ("two.txt", "c\n")):
        (tmp_path / name).write_text(text)
    got = tables.text_lines(spark, str(tmp_path)).collect()
    assert sorted((r["value"], r["path"].rsplit("/", 1)[-1]) for r in got) == [("a", "one.txt"), ("b", "one.txt"), ("c", "two.txt")]
    q = tables.live_lines(spark, str(tmp_path), 1).select("value").writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("lines").collect()) == ["a", "b", "c"]


def test_schema_of_named_tuples():
    from typing import NamedTuple

    class Reading(NamedTuple):
        sensor: str
        value: float
        count: int
        ok: bool

    s = schema.schema_of(Reading)
    assert s.fieldNames() == ["sensor", "value", "count", "ok"] and [f.dataType.simpleString() for f in s] == ["string", "double", "bigint", "boolean"]


def test_trending_windows(spark):
    items = list("abacabadcc") * 3
    t = seq(spark, items, "v")
    got = {}
    for r in analytics.trending(t, F.col("v"), 8, 2, ["us"], every=4).collect():
        got.setdefault(r["block"], []).append((r["rank"], r["entry"], r["n"]))
    for b in range(-(-len(items) // 4)):
        counts = sorted(((-items[max(0, 4 * b - 4) : 4 * b + 4].count(x), x) for x in set(items[max(0, 4 * b - 4) : 4 * b + 4])))
        assert sorted(got[b]) == [(i + 1, x, -n) for i, (n, x) in enumerate(counts[:2])]
    with pytest.raises(ValueError):
        analytics.trending(t, F.col("v"), 8, 2, ["us"], every=3)


def test_fan_out_of_many_filters(spark):
    """Filters of a frame against the same filters as regular expressions; topics and filters with odd letters and empty levels."""
    import itertools
    import re

    from riverbed.functions import topics

    names = ["a", "b", "", "x\ny", "."]
    every = ["/".join(t) for n in (1, 2, 3) for t in itertools.product(names, repeat=n)]
    filters = ["/".join(t) for n in (1, 2, 3) for t in itertools.product(["a", "", "+", "."], repeat=n)]
    filters = [f for f in filters + [f + "/#" for f in filters] + ["#"] if f]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(every)] + [(None, -1), (every[0], -2)], "topic string, i long")
    got = topics.fan_out(df, spark.createDataFrame([(f,) for f in [*filters, None, filters[0]]], "f string"))
    want = [(i, f) for t, i in [*((t, i) for i, t in enumerate(every)), (every[0], -2)] for f in filters if re.search(topics.pattern(f), t)]
    assert sorted((r["i"], r["filter"]) for r in got.collect()) == sorted(want)
    few, many = (topics.fan_out(df, spark.range(n).selectExpr("concat('q/', id, '/+')"))._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (10, 100_000))
    assert few == many


def test_json_elements_keep_their_order(spark):
    from riverbed.functions import values

    df = spark.createDataFrame([('{"p":{"z":1,"y":"q"},"n":null,"l.x":[{"z":1,"a":[2, 3],"p":0}, {}, "s\\"t", null, [1]]}',), ("\n[1]",), (None,), ("not json",), ('{"l.x":{}}',)], "j string")
    got = [r[0] for r in values.flatten_array(df, "j", "l.x", "p", "n", "none").collect()]
    assert got[:3] == ['{"z":1,"a":[2,3],"p":0,"n":null}', '{"p":{"z":1,"y":"q"},"n":null}', '{"payload":"s\\"t","p":{"z":1,"y":"q"},"n":null}']
    assert got[3:] == ['{"payload":null,"p":{"z":1,"y":"q"},"n":null}', '{"payload":[1],"p":{"z":1,"y":"q"},"n":null}']
    assert [r[0] for r in df.select(values.json_object(F.col("j"))).collect()][1:4] == ['{"payload":[1]}', None, None]


def test_leading_entries():
    import random
    from collections import Counter, deque

    rng = random.Random(7)
    for size, n, k in ((3, 5, 2), (40, 30, 2), (200, 90, 3), (30, 400, 1)):
        leading, window, counts = analytics.Leading(size, k), deque(), Counter()
        for _ in range(1500):
            x = min(int(rng.paretovariate(0.6)) - 1, size - 1) if rng.random() < 0.8 else rng.randrange(size)
            window.append(x)
            counts[x] += 1
            leading.change(x, 1)
            if len(window) > n:
                counts[y := window.popleft()] -= 1
                leading.change(y, -1)
            assert leading.top() == [(i, c) for c, i in sorted((-c, i) for i, c in counts.items() if c)[:k] for c in (-c,)]


def test_hot_keys_are_dealt_to_many_tasks(spark):
    """A key with a third of all rows, in blocks: as many partitions of the window as blocks, and the rows of the plain form."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 50) as k", "id as us", "id % 7 as event_id", "id % 11 as v")
    plain = Last(rows=4, keys=("k",)).aggregate(df, s=F.sum("v"))
    assert sorted(map(str, Last(rows=4, keys=("k",), hot=100).aggregate(df, s=F.sum("v")).collect())) == sorted(map(str, plain.collect()))
    dealt = order.blocks(df, 4, ["us"], ["k"], 100)
    assert dealt.where("k is null").select("_in").distinct().count() == 11 and dealt.groupBy("k", "_in").count().agg(F.max("count")).first()[0] == 103
    for bad in ({"rows": 3, "hot": 5}, {"micros": 3, "keys": ("k",), "hot": 5}, {"rows": 3, "keys": ("k",), "hot": 0}):
        with pytest.raises(ValueError):
            Last(**bad)


def test_functions_over_windows(spark):
    df = spark.range(500).selectExpr("concat('k', id % 3) as k", "id as us", "id * 7 % 5 as event_id", "id * id % 101 as v")
    w = Last(rows=6, keys=("k",), every=4)
    got = w.apply(df, lambda x: (int(x["v"].iloc[0]), len(x)) if x["v"].iloc[-1] % 2 else None, "a long, n long")
    want = w.aggregate(df, a=F.first("v"), n=F.count(F.lit(1))).where("v % 2 = 1").select("k", "us", "event_id", "a", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        Last(micros=5).apply(df, len, "n long")


@pytest.mark.parametrize("grid", [4, 1024])
def test_buckets_by_one_pass(spark, monkeypatch, grid):
    """Bounds from the counting pass or from a second one; nulls, NaN, infinite numbers and ties keep the order."""
    monkeypatch.setattr(order, "GRID", grid)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    values = [odd[i // 100] if i % 100 == 0 and i < 400 else float(i % 37) for i in range(2000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i long")
    bounds, n = order.measured(df, "x")
    assert n == 2000 and bounds == sorted(set(bounds)) and len(bounds) >= 5
    for width in (None, bounds, []):
        found = order.numbered(df, ["x", "i"], "seq", width).orderBy("seq").collect()
        place = lambda v: float("-inf") if v is None else 1e400 if v != v else v
        want = sorted(range(2000), key=lambda i: (place(values[i]), values[i] is not None and values[i] != values[i], i))
        assert [r["i"] for r in found] == want and [r["seq"] for r in found] == list(range(2000))
    empty = df.where("i < 0")
    assert order.measured(empty, "x") == ([], 0) and order.numbered(empty, ["x", "i"]).collect() == []
    assert order.measured(df.where("x is null"), "x")[0] == []
