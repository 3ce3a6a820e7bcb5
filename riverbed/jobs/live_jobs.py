"""Queries that run as streams over the event table until all of it is read, and return what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rows as row_operators
from ..sources import python
from ..sources.tables import EVENTS_SQL, events_of, live_table, shared_folder, table
from ..streaming import live, timed, whole
from .registry import query
from .shared import HOUR, LATE_SQL, LEFT_SQL, RIGHT_SQL

O = ["us", "event_id"]


#: About as many rows as one micro-batch takes; rows of one instant are never parted.
SLICE_ROWS = 1_000_000
#: Micro-batches don't become more than twice so many, as each costs what its jobs and its state cost: beyond that they grow.
SLICES = 3


def _slices(spark, raw: DataFrame, n: int, path: str, by: Column) -> None:
    """Write raw to path, parted into about n ranges of by (column _slice, in order, nulls in the last)."""
    at = raw.select(by.cast("double").alias("at"))
    inner = sorted(set(at.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n))))
    infinite = float("inf")
    timed_ = raw.withColumn("_at", F.coalesce(by.cast("double"), F.lit(infinite)))
    sliced = Bucketizer(splits=[-infinite, *inner, infinite], inputCol="_at", outputCol="_slice").transform(timed_)
    sliced.withColumn("_slice", F.col("_slice").cast("int")).repartitionByRange("_at").drop("_at").write.partitionBy("_slice").parquet(path)


def _fed(spark, path: str, into: str) -> Iterator[None]:
    """Move the files of one slice after the other to the folder that a stream reads."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(into))
    folders = [x.getPath() for x in fs.listStatus(fs_path(path)) if x.isDirectory()]
    for i, folder in enumerate(sorted(folders, key=lambda f: int(f.getName().split("=")[1]))):
        for x in fs.listStatus(folder):
            if not fs.rename(x.getPath(), fs_path(f"{into}/{i:06d}-{x.getPath().getName()}")):
                raise OSError(f"{x.getPath()} can't be moved to {into}")
        yield


def _written(spark, sf, make: Callable[[Callable[[], DataFrame]], DataFrame], step: whole.Step | None = None, by: Column | None = None, least: int = 1, provider: str | None = None) -> DataFrame:
    """All rows that make gives for the event stream (it may take the stream more than once), or step makes of them, read from
    the shared folder.

    However the table's files are cut and ordered, the stream brings its rows in the order of time (or of by): a table of
    more than SLICE_ROWS, or one for which several batches are asked, is first written in ranges of it, and the stream runs
    until each is done before it goes on with the next.
    """
    path = shared_folder(spark, "live")
    source, raw = f"{sf}/events.parquet", table(spark, sf, "events")
    n = max(least, min(SLICES, -(-raw.count() // SLICE_ROWS)))
    steps = [None]
    if n > 1:
        _slices(spark, raw, 2 * n, f"{path}/slices", F.unix_micros(F.col("ts").cast("timestamp")) if by is None else by)
        source, steps = f"{path}/in", _fed(spark, f"{path}/slices", f"{path}/in")
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, provider or before)
    try:
        for _ in steps:
            df = make(lambda: events_of(live_table(spark, source, None, raw.schema)))
            run = whole.write_steps(df, step, f"{path}/out", f"{path}/state") if step else live.write_batches(df, f"{path}/out", f"{path}/state")
            run.awaitTermination()
    finally:
        spark.conf.set(kind, before)
    if step:
        return spark.read.parquet(f"{path}/out").drop("batch")
    return spark.read.schema(df.schema).parquet(f"{path}/out").select(*df.columns)


@query(f"SELECT user_id, us, event_id, count(*) OVER w AS n, sum(coalesce(cents, 0)) OVER w::BIGINT AS total FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
def stream_state_running(spark, sf):
    return _written(spark, sf, lambda stream: live.running(stream(), ["user_id"], "cents", O))


@query(f"SELECT user_id, us, event_id, sum(coalesce(cents, 0)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 2 PRECEDING)::BIGINT AS total FROM {EVENTS_SQL}")
def stream_last_n(spark, sf):
    return _written(spark, sf, lambda stream: live.last_n(stream(), 3, ["user_id"], "cents", O))


@query(f"""WITH e AS (SELECT *, CAST(event_type = 'view' AS INTEGER) AS side FROM {EVENTS_SQL} WHERE event_type IN ('view', 'purchase'))
SELECT user_id, us, event_id, value FROM (SELECT user_id, us, event_id, side, last_value(CASE WHEN side = 0 THEN coalesce(cents, 0) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, side, event_id ROWS UNBOUNDED PRECEDING) AS value FROM e) WHERE side = 1""")
def stream_join_last(spark, sf):
    return _written(spark, sf, lambda stream: live.join_last(stream().where("event_type = 'view'"), stream().where("event_type = 'purchase'"), ["user_id"], "cents", O))


@query(f"""WITH e AS (SELECT event_type, us // 3600000000 * 3600000000 AS start_us, us, cents FROM {EVENTS_SQL})
SELECT event_type, start_us, count(*) AS n, sum(cents)::BIGINT AS total FROM e
WHERE start_us + 3600000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM e) GROUP BY ALL""")
def stream_panes(spark, sf):
    return _written(spark, sf, lambda stream: live.panes(stream(), "ts", "1 hour", "10 minutes", ["event_type"], n=F.count(F.lit(1)), total=F.sum("cents")))


@query(f"SELECT user_id, us, event_id, max(cents) OVER w - min(cents) OVER w AS spread FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
def stream_stateful(spark, sf):
    """A function of the user's own, which keeps the least and the greatest value of its key; it is given many keys at once."""

    def spread(rows):
        values = rows.assign(low=rows["low"].fillna(rows["cents"]), high=rows["high"].fillna(rows["cents"])) if "low" in rows else rows.assign(low=rows["cents"], high=rows["cents"])
        by = values.groupby("_key")
        rows = rows.assign(low=by["low"].cummin(), high=by["high"].cummax())
        out = rows.loc[rows["_new"], ["user_id", *O]].assign(spread=rows["high"] - rows["low"])
        return out, rows.groupby("_key").tail(1)

    return _written(spark, sf, lambda stream: live.stateful_many(stream().select("user_id", *O, "cents"), ["user_id"], O, spread, "user_id long, us long, event_id long, spread long"))


@query(f"SELECT user_id, us, event_id, m, n FROM (SELECT user_id, us, event_id, max(cents) OVER w AS m, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 4 PRECEDING)) WHERE r % 3 = 0")
def stream_last_trigger(spark, sf):
    """Any aggregate of a live window of five rows, at each third row of a key."""
    return _written(spark, sf, lambda stream: live.windowed(stream().select("user_id", *O, "cents"), 5, ["user_id"], O, lambda w: (int(w["cents"].max()), len(w)), "m long, n long", every=3))


@query(f"SELECT event_id, row_number() OVER (ORDER BY us, event_id) - 1 AS seq FROM {EVENTS_SQL}")
def stream_add_seq(spark, sf):
    """Places in the whole stream, which go on from batch to batch."""
    return _written(spark, sf, lambda stream: stream().select(*O), whole.numbered(O), least=3).select("event_id", "seq")


@query(f"""WITH r AS (SELECT event_id, cents, row_number() OVER w AS n, sum(cents) OVER w::DOUBLE AS s, sum(CAST(cents AS HUGEINT) * cents) OVER w::DOUBLE AS q FROM {EVENTS_SQL} WINDOW w AS (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (abs(s / n) + 1.5 * sqrt((q - s * s / n) / (n - 1))) / 100 AS "limit" FROM r WHERE n > 1)
SELECT event_id, round("limit", 4) AS "limit" FROM l WHERE abs(cents) / 100 > "limit" """)
def stream_outliers(spark, sf):
    """Outliers against all rows of the stream so far."""
    out = _written(spark, sf, lambda stream: stream().select(*O, "cents"), whole.outliers("cents", 1.5, O), least=3)
    return out.select("event_id", F.round("limit", 4).alias("limit"))


@query(f"SELECT event_id, sum(cents) OVER (ORDER BY us, event_id ROWS 24 PRECEDING)::BIGINT AS s FROM {EVENTS_SQL}")
def stream_last_n_global(spark, sf):
    return _written(spark, sf, lambda stream: stream().select(*O, "cents"), whole.last_n(25, {"s": F.sum("cents")}, O), least=3).select("event_id", "s")


@query(f"SELECT l.event_id, r.event_id AS rid, r.cents FROM {LEFT_SQL} l ASOF LEFT JOIN {RIGHT_SQL} r ON l.us >= r.us")
def stream_join_last_global(spark, sf):
    def both(stream):
        e = stream().where("event_type in ('view', 'purchase')")
        bought = F.col("event_type") == "purchase"
        return e.select(*O, "event_type", F.when(bought, F.col("event_id")).alias("rid"), F.when(bought, F.col("cents")).alias("cents"))

    return _written(spark, sf, both, whole.join_last(F.col("event_type") == "view", ["rid", "cents"], O), least=3).select("event_id", "rid", "cents")


def _arrival() -> Column:
    return F.col("event_id") + 40 * (F.col("event_id") % 5)


def _arriving(stream):
    return stream().select("event_id", "us", "cents", _arrival().alias("arrival"))


@query(f"SELECT pane, late, count(*) AS n, sum(cents)::BIGINT AS s, min(arrival) AS first FROM (SELECT *, watermark >= pane + {2 * HOUR} AS late FROM {LATE_SQL}) GROUP BY 1, 2")
def stream_pane_timing(spark, sf):
    """Rows in the order of their arrival, which isn't that of their times: late or not by the greatest time so far."""
    rows = _written(spark, sf, _arriving, whole.accepted(["arrival", "event_id"], 2 * HOUR, HOUR, 6 * HOUR), _arrival(), 3)
    return rows.groupBy("pane", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"), F.min("arrival").alias("first"))


@query(f"""WITH r AS (SELECT *, watermark >= pane + {2 * HOUR} AS late FROM {LATE_SQL}), o AS (SELECT pane, count(*) AS n, sum(coalesce(cents, 0))::BIGINT AS total FROM r WHERE NOT late GROUP BY 1)
SELECT pane, 0 AS "index", n, total FROM o WHERE pane + {2 * HOUR} <= (SELECT max(us) - {HOUR} FROM {EVENTS_SQL})
UNION ALL SELECT r.pane, row_number() OVER w, coalesce(n, 0) + row_number() OVER w, (coalesce(total, 0) + sum(coalesce(cents, 0)) OVER w)::BIGINT FROM r LEFT JOIN o USING (pane) WHERE late WINDOW w AS (PARTITION BY r.pane ORDER BY arrival, event_id)""")
def stream_late_panes(spark, sf):
    """Every firing of a pane: when it is complete, and again for each row that comes late."""
    return _written(spark, sf, _arriving, whole.late_panes(["arrival", "event_id"], 2 * HOUR, HOUR, 6 * HOUR, "cents"), _arrival(), 3)


@query(f"""WITH e AS (SELECT user_id, us, cents FROM {EVENTS_SQL} WHERE user_id IS NOT NULL)
SELECT (us // {12 * HOUR} + i) * {12 * HOUR} + {12 * HOUR} AS at, user_id, count(*) AS n, sum(coalesce(cents, 0))::BIGINT AS total FROM e, (SELECT unnest([0, 1]) AS i)
WHERE (us // {12 * HOUR} + i) * {12 * HOUR} + {12 * HOUR} <= (SELECT max(us) // 1000 * 1000 - {HOUR} FROM e) GROUP BY 1, 2""")
def stream_hop_time(spark, sf):
    """A live window of 24 hours that emits each 12 hours of event time; its state is a row for each user and open window."""
    rows = lambda stream: stream().where("user_id is not null").select("user_id", "ts", F.coalesce("cents", F.lit(0)).alias("cents"))
    make = lambda stream: live.panes(rows(stream), "ts", "24 hours", "1 hour", ["user_id"], "12 hours", n=F.count(F.lit(1)), total=F.sum("cents"))
    out = _written(spark, sf, make, least=3, provider=timed.PROVIDER)
    return out.select((F.col("start_us") + 24 * HOUR).alias("at"), "user_id", "n", "total")


@query("""SELECT n, n * n % 1009 AS "value" FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS n) WHERE n % 5 <> 0
UNION ALL SELECT n, -n FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS n) WHERE n % 10 = 3""")
def stream_calls(spark, sf):
    """A live source that calls a function with as many numbers as there are events: no row, one, or two of each."""

    def made(n):
        return None if n % 5 == 0 else [(n * n % 1009,), (-n,)] if n % 10 == 3 else (n * n % 1009,)

    path, n = shared_folder(spark, "calls"), table(spark, sf, "events").count()
    calls = python.live_calls(spark, made, "value long", max(1, -(-n // 3)))
    for _ in range(3):  # a micro-batch each, and a restart in between
        live.write_batches(calls, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(calls.schema).parquet(f"{path}/out").where(F.col("n") < n).select("n", "value")


@query(f"""SELECT event_id, cents, 0 AS place, false AS is_marker FROM {EVENTS_SQL}
UNION ALL SELECT event_id, cents, 1, true FROM {EVENTS_SQL} WHERE k = 0""")
def stream_sink(spark, sf):
    """A live sink in Python gets each row and each marker once."""
    path = shared_folder(spark, "sink")
    raw = table(spark, sf, "events")
    rows = row_operators.marked(events_of(live_table(spark, f"{sf}/events.parquet", None, raw.schema)), F.col("k") == 0, "after").select("event_id", "cents", "place", "is_marker")
    spark.dataSource.register(python.sink("rows_and_markers", *python.staged_files(f"{path}/out")))
    rows.writeStream.format("rows_and_markers").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return python.published(spark, f"{path}/out", rows.schema).drop("batch")
