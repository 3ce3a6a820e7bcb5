"""Live sources and sinks in Python: restarts, tasks and batches that fail, each row and marker once."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from riverbed.operators import joins, rows
from riverbed.sources import python
from riverbed.streaming import live


def test_calls_go_on_after_a_restart(spark, tmp_path):
    calls = python.live_calls(spark, lambda n: None if n % 3 == 0 else [(str(n),)] * 2 if n == 5 else (None,), "name string", 4)
    for _ in range(3):
        live.write_batches(calls, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = sorted((r["n"], r["name"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(1, None), (2, None), (4, None), (5, "5"), (5, "5"), (7, None), (8, None), (10, None), (11, None)]


def test_calls_without_any_row(spark):
    assert python.called_with(spark.range(5).toDF("n"), lambda n: None, "a string, b double").collect() == []
    assert python.called_with(spark.range(0).toDF("n"), lambda n: (1,), "a long").collect() == []


def test_an_error_of_the_function_ends_the_query(spark):
    with pytest.raises(Exception, match="no five"):
        def made(n):
            if n == 5:
                raise ValueError("no five")
            return (n,)

        python.called_with(spark.range(9).toDF("n"), made, "a long").collect()


@pytest.mark.parametrize("where", ["before", "after", "replace"])
def test_markers(spark, where):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "a long, m boolean")
    found = sorted((r["a"], r["place"], r["is_marker"]) for r in rows.marked(df, F.col("m"), where).collect())
    first = {"before": [(1, 0, True), (1, 1, False)], "after": [(1, 0, False), (1, 1, True)], "replace": [(1, 0, True)]}[where]
    assert found == [*first, (2, 0, False), (3, 0, False)]
    with pytest.raises(ValueError):
        rows.marked(df, F.col("m"), "beside")


@pytest.fixture
def into(spark, tmp_path):
    """A stream of three files, and a function that runs it to a sink."""
    for i in range(3):
        spark.range(i * 100, i * 100 + 100, numPartitions=1).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) s").write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def run(kind):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        spark.dataSource.register(kind)
        rows.marked(stream, F.col("id") % 50 == 0, "after").writeStream.format(kind.name()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    made = rows.marked(spark.read.parquet(f"{tmp_path}/in"), F.lit(False), "after").schema
    return run, str(tmp_path), lambda: sorted((r["id"], r["s"], r["is_marker"]) for r in python.published(spark, f"{tmp_path}/out", made).collect())


WANT = sorted([(i, None if i % 7 == 0 else str(i), False) for i in range(300)] + [(i, None if i % 7 == 0 else str(i), True) for i in range(0, 300, 50)], key=str)


def test_a_task_and_a_batch_that_fail(into):
    """A task stages its rows and fails; a batch's list stands and then the query fails before Spark knows: nothing twice."""
    run, base, found = into
    stage, publish, discard = python.staged_files(f"{base}/out")

    def once(name):
        try:
            os.close(os.open(f"{base}/{name}", os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False

    def staged(batches):
        name = stage(batches)
        if TaskContext.get() is not None and once("task"):
            raise RuntimeError("task lost")
        return name

    def listed(names, number):
        publish(names, number)
        if number == 1 and once("batch"):
            raise RuntimeError("batch lost")

    kind = python.sink("failing_rows", staged, listed, discard)
    failures = 0
    for _ in range(4):
        try:
            run(kind)
            break
        except Exception:  # noqa: BLE001  (the query is started again, whatever ended it)
            failures += 1
    assert failures and os.path.exists(f"{base}/task") and os.path.exists(f"{base}/batch")
    assert sorted(found(), key=str) == WANT


def test_publish_keeps_the_first_list(tmp_path):
    import pyarrow as pa

    stage, publish, discard = python.staged_files(f"file:{tmp_path}/out")
    batch = pa.record_batch({"a": [1, 2]})
    first, second, none = stage(iter([batch])), stage(iter([batch])), stage(iter([]))
    assert none is None
    publish([first], 0)
    publish([second], 0)
    discard([first], 0)
    assert os.listdir(f"{tmp_path}/out/parts") == [first] and os.listdir(f"{tmp_path}/out/batches") == ["000000000000.txt"]


@pytest.mark.parametrize("n", [1, 3, 40])
@pytest.mark.parametrize("width", [None, 50])
@pytest.mark.parametrize("keys", [["k"], []])
def test_last_n_by_blocks(spark, n, width, keys):
    """A key with most rows, null keys, null times, and windows shorter and longer than a block."""
    right = [(None if i % 11 == 0 else "hot" if i % 3 else "b", None if i % 29 == 0 else i * 7 % 200, i, None if i % 5 == 0 else i) for i in range(400)]
    left = [(None if i % 7 == 0 else "hot" if i % 2 else "c" if i % 4 else "b", None if i % 31 == 0 else i * 3 % 230 - 10, i) for i in range(120)]
    a, b = spark.createDataFrame(left, "k string, us long, event_id long"), spark.createDataFrame(right, "k string, us long, event_id long, v long")
    found = {r["event_id"]: r["items"] for r in joins.join_last_n(a, b, n, keys, "v", ["us", "event_id"], width=width).collect()}
    by = lambda r: (-1 << 60 if r[1] is None else r[1], r[2])
    want = {x[2]: [r[3] for r in sorted(right, key=by) if (not keys or r[0] == x[0]) and by(r)[0] <= by(x)[0]][-n:] for x in left}
    assert found == want
