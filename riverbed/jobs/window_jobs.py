"""Queries on windows of the event stream, by keys and over the whole stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import order, windows
from ..operators.windows import Last
from ..sources.tables import EVENTS_SQL, events, table
from .registry import query

HOUR = 3_600_000_000
DAY = 24 * HOUR
O = ["us", "event_id"]
#: About as many rows as one call of a Python function over many groups takes.
SHARE_ROWS = 50_000


@query(f"SELECT event_id, sum(cents) OVER (ORDER BY us, event_id ROWS 24 PRECEDING)::BIGINT AS s FROM {EVENTS_SQL}")
def win_last_n_global(spark, sf):
    return Last(rows=25).aggregate(events(spark, sf), s=F.sum("cents")).select("event_id", "s")


@query(f"SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 2 PRECEDING)::BIGINT AS s FROM {EVENTS_SQL}")
def win_last_n_keyed(spark, sf):
    return Last(rows=3, keys=("user_id",)).aggregate(events(spark, sf), s=F.sum("cents")).select("event_id", "s")


@query(f"SELECT event_id, s, n FROM (SELECT event_id, sum(cents) OVER w::BIGINT AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 9 PRECEDING)) WHERE r % 2 = 0")
def win_trigger_count(spark, sf):
    return Last(rows=10).trigger(2).partition("user_id").aggregate(events(spark, sf), s=F.sum("cents"), n=F.count(F.lit(1))).select("event_id", "s", "n")


@query(f"SELECT event_id, m FROM (SELECT event_id, max(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 3 PRECEDING) AS m, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM {EVENTS_SQL}) WHERE r % 3 = 0 AND r >= 4")
def win_trigger_complete(spark, sf):
    return Last(rows=4, keys=("user_id",), every=3, complete=True).aggregate(events(spark, sf), m=F.max("cents")).select("event_id", "m")


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) AS n FROM {EVENTS_SQL}")
def win_last_time(spark, sf):
    return Last(micros=6 * HOUR, keys=("user_id",)).aggregate(events(spark, sf), n=F.count(F.lit(1))).select("event_id", "n")


@query(f"SELECT event_id, count(*) OVER w AS n, sum(cents) OVER w::BIGINT AS s FROM {EVENTS_SQL} WINDOW w AS (ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW)")
def win_last_time_global(spark, sf):
    e = events(spark, sf).select("event_id", "us", "cents")
    return Last(micros=6 * HOUR).sums(e, n=F.lit(1), s=F.col("cents")).select("event_id", F.col("n").cast("long").alias("n"), "s")


@query(f"""WITH b AS (SELECT us AS at, false AS evicted, us, cents FROM {EVENTS_SQL} UNION ALL SELECT us + {HOUR}, true, NULL, NULL FROM {EVENTS_SQL})
SELECT "at", evicted, s FROM (SELECT "at", evicted, sum(cents) OVER w::BIGINT AS s, count(us) OVER w AS l FROM b WINDOW w AS (ORDER BY "at" RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)) WHERE l > 0""")
def win_time_evict_global(spark, sf):
    return windows.time_evict_sums(events(spark, sf).select("us", "cents"), HOUR, [], s=F.col("cents"))


@query(f"""WITH b AS (SELECT user_id, us AS at, false AS evicted, us, cents FROM {EVENTS_SQL} UNION ALL SELECT user_id, us + {DAY}, true, NULL, NULL FROM {EVENTS_SQL})
SELECT user_id, "at", evicted, s FROM (SELECT user_id, "at", evicted, sum(cents) OVER w::BIGINT AS s, count(us) OVER w AS l FROM b WINDOW w AS (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)) WHERE l > 0""")
def win_time_evict(spark, sf):
    e = events(spark, sf).select("user_id", "us", "cents")
    return windows.time_evict(e, DAY, ["user_id"], s=F.sum("cents"))


@query(f"SELECT epoch_us(time_bucket(INTERVAL 12 HOUR, ts)) + CAST(i * {12 * HOUR} AS BIGINT) AS start, user_id, count(*) AS n, sum(cents)::BIGINT AS s FROM {EVENTS_SQL}, (SELECT unnest([-1, 0]) AS i) GROUP BY 1, 2")
def win_hop_time(spark, sf):
    w = F.window("ts", "24 hours", "12 hours")
    return events(spark, sf).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s")).select(F.unix_micros("w.start").alias("start"), "user_id", "n", "s")


@query(f"""WITH e AS (SELECT user_id, us, event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 2 PRECEDING)::BIGINT AS s FROM {EVENTS_SQL}),
g AS (SELECT user_id, unnest(range(CAST(ceil(min(us) / {DAY}.0) AS BIGINT) * {DAY}, max(us) // {DAY} * {DAY} + {DAY} + 1, {DAY})) AS us FROM e GROUP BY 1)
SELECT g.user_id, g.us, s FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.us >= e.us""")
def win_count_tick(spark, sf):
    e = Last(rows=3, keys=("user_id",)).aggregate(events(spark, sf).select("user_id", "us", "event_id", "cents"), s=F.sum("cents"))
    return windows.ticks(e, ["s"], DAY, ["user_id"])


@query(f"SELECT batch, sum(cents)::BIGINT AS s, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY us, event_id) - 1) // 25 AS batch, cents FROM {EVENTS_SQL}) GROUP BY 1")
def batch_count(spark, sf):
    return windows.batch(events(spark, sf), 25, [], O, s=F.sum("cents"), n=F.count(F.lit(1)))


@query(f"SELECT user_id, batch, sum(cents)::BIGINT AS s, count(*) AS n FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 4 AS batch, cents FROM {EVENTS_SQL}) GROUP BY 1, 2")
def batch_count_keyed(spark, sf):
    return windows.batch(events(spark, sf), 4, ["user_id"], O, s=F.sum("cents"), n=F.count(F.lit(1)))


def _punct_sql(group: str, where: str = "true") -> str:
    return f"SELECT g::BIGINT AS \"window\", sum(cents)::BIGINT AS s, count(*) AS n FROM (SELECT cents, k, {group} AS g FROM (SELECT *, CAST(k = 0 AS INTEGER) AS m FROM {EVENTS_SQL})) WHERE {where} GROUP BY 1"


@query(_punct_sql("sum(m) OVER (ORDER BY us, event_id)"))
def punct_before(spark, sf):
    return windows.punct_batch(events(spark, sf), F.col("k") == 0, "before", O, s=F.sum("cents"), n=F.count(F.lit(1)))


@query(_punct_sql("sum(m) OVER (ORDER BY us, event_id) - m"))
def punct_after(spark, sf):
    return windows.punct_batch(events(spark, sf), F.col("k") == 0, "after", O, s=F.sum("cents"), n=F.count(F.lit(1)))


@query(_punct_sql("sum(m) OVER (ORDER BY us, event_id)", "k <> 0"))
def punct_replace(spark, sf):
    return windows.punct_batch(events(spark, sf), F.col("k") == 0, "replace", O, s=F.sum("cents"), n=F.count(F.lit(1)))


@query(f"SELECT us // {DAY} * {DAY} AS start, event_type, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1, 2")
def batch_time(spark, sf):
    return events(spark, sf).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start"), "event_type", "n")


@query(f"""WITH e AS (SELECT user_id, us // {HOUR} AS h FROM {EVENTS_SQL}), g AS (SELECT user_id, unnest(range(min(h), max(h) + 1)) AS h FROM e GROUP BY 1)
SELECT g.user_id, g.h * {HOUR} AS start, count(e.h) AS n FROM g LEFT JOIN e ON g.user_id = e.user_id AND g.h = e.h GROUP BY 1, 2""")
def batch_time_empty(spark, sf):
    h = events(spark, sf).select("user_id", F.floor(F.col("us") / HOUR).alias("h"))
    counts = h.groupBy("user_id", "h").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).select("user_id", F.explode(F.sequence("a", "z")).alias("h"))
    return grid.join(counts, ["user_id", "h"], "left").select("user_id", (F.col("h") * HOUR).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT event_id, max(cents) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS 2 PRECEDING) AS m FROM {EVENTS_SQL} WHERE event_type IN ('click', 'view')")
def win_copy_config(spark, sf):
    e, config = events(spark, sf), Last(rows=3, keys=("user_id",))
    a, b = (config.aggregate(e.where(F.col("event_type") == t), m=F.max("cents")) for t in ("click", "view"))
    return a.unionByName(b).select("event_id", "m")


@query(f"SELECT event_id, count(*) OVER w AS n, sum(cents) OVER w::BIGINT AS s, min(cents) OVER w AS lo, max(cents) OVER w AS hi FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id ROWS 9 PRECEDING)")
def win_multi_measure(spark, sf):
    return Last(rows=10, keys=("event_type",)).aggregate(events(spark, sf), n=F.count(F.lit(1)), s=F.sum("cents"), lo=F.min("cents"), hi=F.max("cents")).select("event_id", "n", "s", "lo", "hi")


@query(f"SELECT event_id, array_to_string(list(k) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 2 PRECEDING), '-') AS ks FROM {EVENTS_SQL}")
def win_collect(spark, sf):
    out = Last(rows=3, keys=("user_id",)).aggregate(events(spark, sf), l=F.collect_list(F.col("k").cast("string")))
    return out.select("event_id", F.array_join("l", "-").alias("ks"))


@query("SELECT doc_id, pos, word, n FROM (SELECT doc_id, pos, word, least(r, 3) AS n, r FROM (SELECT doc_id, pos, word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS r FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) WHERE w <> ''))) WHERE r % 2 = 0")
def word_count_window(spark, sf):
    from ..operators import rows

    w = rows.words(table(spark, sf, "documents"), "text", "doc_id")
    return Last(rows=3, keys=("word",), order_by=("doc_id", "pos"), every=2).aggregate(w, n=F.count(F.lit(1))).select("doc_id", "pos", "word", "n")


@query(f"SELECT event_id, row_number() OVER (ORDER BY us, event_id) - 1 AS seq FROM {EVENTS_SQL}")
def add_seq(spark, sf):
    return order.numbered(events(spark, sf), O).select("event_id", "seq")


@query(f"SELECT event_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM {EVENTS_SQL}")
def inter_arrival(spark, sf):
    from pyspark.sql import Window

    return events(spark, sf).select("event_id", (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy(*O))).alias("gap"))


@query(f"SELECT event_id, max(cents) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {5 * HOUR - 1} PRECEDING AND CURRENT ROW) AS m FROM {EVENTS_SQL}")
def win_time_max(spark, sf):
    return Last(micros=5 * HOUR, keys=("user_id",)).aggregate(events(spark, sf), m=F.max("cents")).select("event_id", "m")


@query(f"SELECT event_id, s / n AS mean FROM (SELECT event_id, sum(cents) OVER w::BIGINT AS s, count(*) OVER w AS n FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 3 PRECEDING))")
def moving_average(spark, sf):
    """A lookback of 5 averages the last 4 rows: the reading that comes makes room first."""
    out = Last(rows=5 - 1, keys=("user_id",)).aggregate(events(spark, sf), s=F.sum("cents"), n=F.count(F.lit(1)))
    return out.select("event_id", (F.col("s") / F.col("n")).alias("mean"))


@query(f"SELECT event_id FROM (SELECT event_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM {EVENTS_SQL}) WHERE p IS NULL OR abs(cents - p) > 2000")
def delta_filter(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf).withColumn("p", F.lag("cents").over(Window.partitionBy("user_id").orderBy(*O)))
    return e.where("p is null or abs(cents - p) > 2000").select("event_id")


@query(f"SELECT user_id, us // {DAY} AS day, max(cents) - min(cents) AS spread FROM {EVENTS_SQL} GROUP BY 1, 2")
def udaf_batch(spark, sf):
    """A Python function over each user's rows of a day, called for shares of about SHARE_ROWS rows that hold whole groups."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf.groupby(["_user", "_none", "day"], dropna=False)["cents"]
        out = (by.max() - by.min()).rename("spread").reset_index()
        out["user_id"] = out["_user"].astype("Int64").mask(out["_none"])
        return out[["user_id", "day", "spread"]].astype({"day": "Int64", "spread": "Int64"})

    e = events(spark, sf).select(F.coalesce("user_id", F.lit(0)).alias("_user"), F.col("user_id").isNull().alias("_none"), F.floor(F.col("us") / DAY).alias("day"), "cents")
    shares = max(1, -(-e.count() // SHARE_ROWS))
    share = F.pmod(F.xxhash64("_user", "_none", "day"), F.lit(shares)).alias("_share")
    return e.select("*", share).groupBy("_share").applyInPandas(spread, "user_id long, day long, spread long")


#: A third of all events in one key, and some without a key.
SKEWED_SQL = f"(SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id) FROM {EVENTS_SQL})"


def _skewed(spark, sf):
    key = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 11 != 0, F.col("user_id"))
    return events(spark, sf).withColumn("user_id", key)


@query(f"SELECT event_id, s, n FROM (SELECT event_id, sum(cents) OVER w::BIGINT AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM {SKEWED_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 9 PRECEDING)) WHERE r % 2 = 0")
def win_last_n_hot_key(spark, sf):
    """Windows of keys one of which holds a third of all rows: it is dealt in blocks."""
    config = Last(rows=10, keys=("user_id",), every=2, hot=200)
    return config.aggregate(_skewed(spark, sf), s=F.sum("cents"), n=F.count(F.lit(1))).select("event_id", "s", "n")


@query(f"SELECT user_id, batch, sum(cents)::BIGINT AS s, count(*) AS n FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 7 AS batch, cents FROM {SKEWED_SQL}) GROUP BY 1, 2")
def batch_count_hot_key(spark, sf):
    return windows.batch(_skewed(spark, sf), 7, ["user_id"], O, hot=200, s=F.sum("cents"), n=F.count(F.lit(1)))


@query(f"SELECT user_id, us, event_id, m - lo AS spread FROM (SELECT user_id, us, event_id, max(cents) OVER w AS m, min(cents) OVER w AS lo, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM {SKEWED_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 4 PRECEDING)) WHERE r % 3 = 0 AND r >= 5")
def udf_sliding(spark, sf):
    """A Python function over sliding windows, at each third row of a key once its window is full."""
    config = Last(rows=5, keys=("user_id",), every=3, complete=True)
    return config.apply(_skewed(spark, sf).select("user_id", *O, "cents"), lambda w: (int(w["cents"].max() - w["cents"].min()),), "spread long")


@query(f"SELECT us, event_id, max(cents) OVER w - min(cents) OVER w AS spread FROM {EVENTS_SQL} WINDOW w AS (ORDER BY us, event_id ROWS 11 PRECEDING)")
def udf_sliding_global(spark, sf):
    """A Python function over the last twelve rows of the whole stream, at each row."""
    return Last(rows=12).apply(events(spark, sf).select(*O, "cents"), lambda w: (int(w["cents"].max() - w["cents"].min()),), "spread long")
