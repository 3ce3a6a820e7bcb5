"""Queries that join streams, follow event time, or compute what samples of the domain do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics, joins, windows
from ..sources.tables import EVENTS_SQL, events, shared_folder, table, text_lines
from .registry import query
from .shared import HOUR, LATE_SQL, LEFT_SQL, RIGHT_SQL

O = ["us", "event_id"]

TRADES_SQL = f"(SELECT user_id % 20 AS ticker, us, event_id, cents AS price_cents, k AS volume FROM {EVENTS_SQL} WHERE event_type = 'purchase')"
QUOTES_SQL = f"(SELECT user_id % 20 AS ticker, us, event_id, cents / 100 AS ask, k AS size FROM {EVENTS_SQL} WHERE event_type = 'view')"
VWAP_SQL = f"(SELECT ticker, us, event_id, lo AS low, hi AS high, s / c / 100 AS mean, pv / v / 100 AS vwap FROM (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi, sum(p) OVER w::BIGINT AS s, count(p) OVER w AS c, sum(p * volume) OVER w::BIGINT AS pv, sum(volume) OVER w::BIGINT AS v FROM (SELECT *, CASE WHEN volume <> 0 THEN price_cents END AS p FROM {TRADES_SQL}) WINDOW w AS (PARTITION BY ticker ORDER BY us, event_id ROWS 3 PRECEDING)) WHERE c > 0)"


def trades(spark, sf):
    return events(spark, sf).where("event_type = 'purchase'").select((F.col("user_id") % 20).alias("ticker"), "us", "event_id", F.col("cents").alias("price_cents"), F.col("k").alias("volume"))


def quotes(spark, sf):
    return events(spark, sf).where("event_type = 'view'").select((F.col("user_id") % 20).alias("ticker"), "us", "event_id", (F.col("cents") / 100).alias("ask"), F.col("k").alias("size"))


@query(f"SELECT ticker, event_id, low, high, mean, vwap FROM {VWAP_SQL}")
def vwap_count(spark, sf):
    return analytics.vwap(trades(spark, sf)).select("ticker", "event_id", "low", "high", "mean", "vwap")


#: Invented prices spread too far for an exponential: a hundredth of them is taken.
CHEAP_TRADES_SQL = TRADES_SQL.replace("cents AS price_cents", "cents // 100 AS price_cents")
CHEAP_VWAP_SQL, CHEAP_QUOTES_SQL = VWAP_SQL.replace(TRADES_SQL, CHEAP_TRADES_SQL), QUOTES_SQL.replace("cents / 100 AS ask", "(cents // 100) / 100 AS ask")


def _cheap(spark, sf):
    t = trades(spark, sf).withColumn("price_cents", F.floor(F.col("price_cents") / 100))
    q = events(spark, sf).where("event_type = 'view'").select((F.col("user_id") % 20).alias("ticker"), "us", "event_id", (F.floor(F.col("cents") / 100) / 100).alias("ask"), F.col("k").alias("size"))
    return t, q


@query(f"SELECT q.ticker, q.event_id, ask, vwap, round(CASE WHEN vwap > ask THEN size * exp(vwap - ask) ELSE 0 END, 4) AS \"index\" FROM {CHEAP_QUOTES_SQL} q ASOF JOIN {CHEAP_VWAP_SQL} v ON q.ticker = v.ticker AND q.us >= v.us")
def bargain_index(spark, sf):
    out = analytics.bargains(*_cheap(spark, sf))
    return out.select("ticker", "event_id", "ask", "vwap", F.round("index", 4).alias("index"))


@query(f"""WITH p AS (SELECT ticker, (us // {12 * HOUR} + i) * {12 * HOUR} AS start, sum(price_cents * volume)::BIGINT AS pv, sum(volume)::BIGINT AS v FROM {CHEAP_TRADES_SQL}, (SELECT unnest([-1, 0]) AS i) GROUP BY 1, 2)
SELECT ticker, event_id, vwap, round(CASE WHEN vwap > ask THEN size * exp(vwap - ask) ELSE 0 END, 4) AS "index" FROM (
SELECT q.ticker, q.event_id, ask, size, pv / v / 100 AS vwap FROM {CHEAP_QUOTES_SQL} q JOIN p ON q.ticker = p.ticker AND q.us // {12 * HOUR} * {12 * HOUR} = p.start + {24 * HOUR} WHERE v > 0)""")
def vwap_event_time(spark, sf):
    """Panes of 24 hours each 12 hours; a quote meets the pane that ended at the start of its own 12 hours."""
    t, q = _cheap(spark, sf)
    t = t.withColumn("ts", F.timestamp_micros("us"))
    p = t.groupBy("ticker", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.sum(F.col("price_cents") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    p = p.where("v > 0").select("ticker", F.unix_micros("w.end").alias("end"), (F.col("pv") / F.col("v") / 100).alias("vwap"))
    unit = (F.floor(F.col("us") / (12 * HOUR)) * (12 * HOUR)).cast("long")
    index = analytics.index_of(F.col("vwap"), F.col("ask"), F.col("size"))
    return joins.join_band(q, p, ["ticker"], unit, "end").select("ticker", "event_id", "vwap", F.round(index, 4).alias("index"))


@query(f"""WITH t AS (SELECT ticker, us // {HOUR} * {HOUR} AS slice, sum(price_cents * volume)::BIGINT AS pv, sum(volume)::BIGINT AS v FROM {CHEAP_TRADES_SQL} GROUP BY 1, 2)
SELECT ticker, event_id, vwap, round(CASE WHEN vwap > ask THEN size * exp(vwap - ask) ELSE 0 END, 4) AS "index" FROM (
SELECT q.ticker, q.event_id, any_value(ask) AS ask, any_value(size) AS size, sum(pv) / sum(v) / 100 AS vwap FROM {CHEAP_QUOTES_SQL} q JOIN t ON q.ticker = t.ticker AND t.slice < q.us // {HOUR} * {HOUR} AND t.slice >= q.us // {HOUR} * {HOUR} - {10 * HOUR} GROUP BY 1, 2 HAVING sum(v) > 0)""")
def vwap_event_time_fine(spark, sf):
    """Panes of ten units of time, one each unit (an hour, as invented events are sparse): summed up by unit, put together from
    ten; a quote meets the pane that ended at the start of its own unit."""
    t, q = _cheap(spark, sf)
    unit = (F.floor(F.col("us") / HOUR) * HOUR).cast("long")
    slices = t.groupBy("ticker", unit.alias("end")).agg(F.sum(F.col("price_cents") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    panes = windows.slid(slices, q.select("ticker", unit.alias("end")), ["ticker"], "end", 10 * HOUR, pv=F.sum("pv"), v=F.sum("v"))
    panes = panes.where("v > 0").select("ticker", "end", (F.col("pv") / F.col("v") / 100).alias("vwap"))
    index = analytics.index_of(F.col("vwap"), F.col("ask"), F.col("size"))
    return joins.join_band(q, panes, ["ticker"], unit, "end").select("ticker", "event_id", "vwap", F.round(index, 4).alias("index"))


#: A text with tags for each event; one after a slash or a letter isn't a tag.
TAGGED_SQL = "'#' || event_type || ' é#k' || k || ', (#k-' || k % 7 || ') a/#no +#日' || k % 3"
#: What stands before a tag (white space, ASCII signs but for the slash) and in one.
TAG = r"(?:^|\s|[!-.:-@\[-`{-~])(#[\p{L}0-9_-]+)"


def _tags(spark, sf):
    def k(m=None):
        return (F.col("k") % m if m else F.col("k")).cast("string")

    text = F.concat(F.lit("#"), "event_type", F.lit(" é#k"), k(), F.lit(", (#k-"), k(7), F.lit(") a/#no +#日"), k(3))
    return events(spark, sf).select("us", "event_id", F.posexplode(F.regexp_extract_all(text, F.lit(TAG), F.lit(1))).alias("pos", "tag"))


TAGS_SQL = f"(SELECT us, event_id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (SELECT us, event_id, regexp_extract_all({TAGGED_SQL}, '{TAG}', 1) AS t FROM {EVENTS_SQL}))"


@query(f"""WITH c AS (SELECT block, tag AS entry, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY us, event_id, pos) - 1) // 4000 AS block, tag FROM {TAGS_SQL}) GROUP BY 1, 2),
s AS (SELECT t.block, entry, sum(n)::BIGINT AS n FROM (SELECT DISTINCT block FROM c) t JOIN c ON c.block BETWEEN t.block - 9 AND t.block GROUP BY 1, 2)
SELECT block, entry, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, entry) AS r FROM s) WHERE r <= 10""")
def trending_topk(spark, sf):
    """The ten top tags of the last 40,000, at each 4,000th."""
    return analytics.trending(_tags(spark, sf), F.col("tag"), 40_000, 10, [*O, "pos"], every=4000)


def _each_sql(n: int) -> str:
    return f"""WITH t AS (SELECT row_number() OVER (ORDER BY us, event_id, pos) AS g, us, event_id, pos, tag FROM {TAGS_SQL}),
c AS (SELECT g, d.tag, sum(CAST(t.tag = d.tag AS INTEGER)) OVER (PARTITION BY d.tag ORDER BY g ROWS {n - 1} PRECEDING) AS n FROM t, (SELECT DISTINCT tag FROM t) d),
r AS (SELECT g, string_agg(tag || ':' || n, ' ' ORDER BY n DESC, tag) AS top FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, tag) AS r FROM c WHERE n > 0) WHERE r <= 10 GROUP BY 1)
SELECT us, event_id, CAST(pos - 1 AS INTEGER) AS pos, t.tag AS entry, top FROM t JOIN r USING (g)"""


@query(_each_sql(40_000))
def trending_each(spark, sf):
    """The ten top tags of the last 40,000, at each tag."""
    return analytics.trending_each(_tags(spark, sf), F.col("tag"), 40_000, 10, [*O, "pos"])


@query(_each_sql(300))
def trending_each_short(spark, sf):
    """The ten top tags of the last 300, at each tag."""
    return analytics.trending_each(_tags(spark, sf), F.col("tag"), 300, 10, [*O, "pos"], block=2000)


@query(f"""WITH r AS (SELECT event_id, cents, row_number() OVER w AS n, sum(cents) OVER w::DOUBLE AS s, sum(CAST(cents AS HUGEINT) * cents) OVER w::DOUBLE AS q FROM {EVENTS_SQL} WINDOW w AS (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (abs(s / n) + 1.5 * sqrt((q - s * s / n) / (n - 1))) / 100 AS "limit" FROM r WHERE n > 1)
SELECT event_id, round("limit", 4) AS "limit" FROM l WHERE abs(cents) / 100 > "limit" """)
def running_outliers(spark, sf):
    out = analytics.running_outliers(events(spark, sf).select("event_id", "us", "cents"), "cents", 1.5, O)
    return out.select("event_id", F.round("limit", 4).alias("limit"))


def _sides(spark, sf):
    e = events(spark, sf).select("user_id", "us", "event_id", "event_type", "cents")
    return e.where("event_type = 'view'").drop("event_type", "cents"), e.where("event_type = 'purchase'").drop("event_type").withColumnRenamed("event_id", "rid").withColumn("event_id", F.col("rid"))


@query(f"SELECT l.event_id, r.event_id AS rid, r.cents FROM {LEFT_SQL} l ASOF LEFT JOIN {RIGHT_SQL} r ON l.user_id = r.user_id AND l.us >= r.us")
def join_last_keyed(spark, sf):
    left, right = _sides(spark, sf)
    return joins.join_last(left, right, ["user_id"], ["rid", "cents"], O).select("event_id", "rid", "cents")


@query(f"SELECT l.event_id, r.event_id AS rid, r.cents FROM {LEFT_SQL} l ASOF LEFT JOIN {RIGHT_SQL} r ON l.us >= r.us")
def join_last_global(spark, sf):
    left, right = _sides(spark, sf)
    return joins.join_last(left, right, [], ["rid", "cents"], O).select("event_id", "rid", "cents")


@query(f"SELECT l.event_id, r.event_id AS rid, r.cents FROM {LEFT_SQL} l ASOF LEFT JOIN {RIGHT_SQL} r ON l.user_id = r.user_id AND l.us >= r.us")
def join_last_hot_key(spark, sf):
    left, right = _sides(spark, sf)
    return joins.join_last(left, right, ["user_id"], ["rid", "cents"], O, width=6 * HOUR).select("event_id", "rid", "cents")


def _last_n_sql(by: str, on: str, n: int) -> str:
    return f"""WITH r AS (SELECT *, list(cents) OVER ({by} ORDER BY us, event_id ROWS {n - 1} PRECEDING) AS l FROM {RIGHT_SQL})
SELECT l.event_id, coalesce(array_to_string(r.l, ','), '') AS items FROM {LEFT_SQL} l ASOF LEFT JOIN r ON {on} l.us >= r.us"""


@query(_last_n_sql("PARTITION BY user_id", "l.user_id = r.user_id AND", 3))
def join_last_n(spark, sf):
    left, right = _sides(spark, sf)
    out = joins.join_last_n(left, right.drop("rid"), 3, ["user_id"], "cents", O, ["event_id"])
    return out.select("event_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(_last_n_sql("", "", 4))
def join_last_n_global(spark, sf):
    left, right = _sides(spark, sf)
    out = joins.join_last_n(left, right.drop("rid"), 4, [], "cents", O, ["event_id"])
    return out.select("event_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"SELECT l.event_id, coalesce(string_agg(r.cents, ',' ORDER BY r.us), '') AS items FROM {LEFT_SQL} l LEFT JOIN {RIGHT_SQL} r ON l.user_id = r.user_id AND r.us > l.us - {48 * HOUR} AND r.us <= l.us GROUP BY 1")
def join_last_time(spark, sf):
    left, right = _sides(spark, sf)
    out = joins.join_last_time(left, right, 48 * HOUR, ["user_id"], "cents")
    return out.select("event_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"SELECT q.event_id, q.us // {HOUR} * {HOUR} AS unit, n FROM {QUOTES_SQL} q JOIN (SELECT ticker, us // {HOUR} * {HOUR} AS unit, count(*) AS n FROM {TRADES_SQL} GROUP BY 1, 2) t ON q.ticker = t.ticker AND q.us // {HOUR} * {HOUR} = t.unit")
def join_band(spark, sf):
    unit = (F.floor(F.col("us") / HOUR) * HOUR).cast("long")
    t = trades(spark, sf).groupBy("ticker", unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return joins.join_band(quotes(spark, sf), t, ["ticker"], unit, "unit").select("event_id", "unit", "n")


@query(f"SELECT l.event_id FROM {LEFT_SQL} l JOIN (SELECT user_id, min(us) AS a FROM {RIGHT_SQL} GROUP BY 1) r ON l.user_id = r.user_id AND r.a <= l.us")
def dynamic_filter(spark, sf):
    left, right = _sides(spark, sf)
    return joins.dynamic_filter(left, right, "user_id", "us", "us").select("event_id")


@query(f"SELECT us // {HOUR} * {HOUR} AS start, us // {HOUR} * {HOUR} + {HOUR} AS \"end\", sum(cents)::BIGINT AS s FROM {EVENTS_SQL} GROUP BY 1, 2")
def ev_tumble(spark, sf):
    return events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum("cents").alias("s")).select(F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "s")


@query(f"SELECT ((us - {HOUR}) // {3 * HOUR} + i) * {3 * HOUR} + {HOUR} AS start, count(*) AS n FROM {EVENTS_SQL}, (SELECT unnest([-1, 0]) AS i) GROUP BY 1")
def ev_hop(spark, sf):
    """Panes of 6 hours each 3 hours, from one hour past midnight."""
    return events(spark, sf).groupBy(F.window("ts", "6 hours", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start"), "n")


def _accepted(spark, sf):
    e = events(spark, sf).select("event_id", "us", "cents", (F.col("event_id") + 40 * (F.col("event_id") % 5)).alias("arrival"))
    return analytics.accepted(e, ["arrival", "event_id"], 2 * HOUR, HOUR, 6 * HOUR)


@query(f"SELECT event_id, pane, watermark >= pane + {2 * HOUR} AS late FROM {LATE_SQL}")
def ev_late_filter(spark, sf):
    return _accepted(spark, sf).select("event_id", "pane", "late")


@query(f"SELECT pane, late, count(*) AS n, sum(cents)::BIGINT AS s, min(arrival) AS first FROM (SELECT *, watermark >= pane + {2 * HOUR} AS late FROM {LATE_SQL}) GROUP BY 1, 2")
def ev_pane_timing(spark, sf):
    return _accepted(spark, sf).groupBy("pane", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"), F.min("arrival").alias("first"))


@query(f"SELECT event_id, pane, CASE WHEN late THEN row_number() OVER (PARTITION BY pane, late ORDER BY arrival, event_id) ELSE 0 END AS \"index\" FROM (SELECT *, watermark >= pane + {2 * HOUR} AS late FROM {LATE_SQL})")
def ev_pane_index(spark, sf):
    """The firing that takes up each row: 0 when the pane is complete, then one for each row that comes late."""
    rows = _accepted(spark, sf)
    later = F.row_number().over(Window.partitionBy("pane", "late").orderBy("arrival", "event_id"))
    return rows.select("event_id", "pane", F.when(F.col("late"), later).otherwise(0).cast("long").alias("index"))


@query(f"SELECT tag, count(*) AS n FROM {TAGS_SQL} GROUP BY 1")
def tag_counts(spark, sf):
    """Tags of letters of any script, after the start, white space or punctuation other than a slash."""
    return _tags(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def src_text_lines(spark, sf):
    """Lines of text files that hold all documents, and how often each stands there."""
    path = shared_folder(spark, "lines")
    table(spark, sf, "documents").where("text is not null").select("text").write.text(path, lineSep="\n")
    return text_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


#: Frames with null keys, null times, and rows that repeat.
ODD_SQL = f"(SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id, us, event_id, cents, event_type FROM {EVENTS_SQL})"
ODD_LEFT_SQL = f"(SELECT *, row_number() OVER () AS lid FROM (SELECT * EXCLUDE (event_type, cents), cents % 5 AS mark FROM {ODD_SQL}, range(2) WHERE event_type = 'view'))"
ODD_RIGHT_SQL = f"(SELECT us, user_id, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE cents END AS cents FROM {ODD_SQL} WHERE event_type = 'purchase')"


def _odd_sides(spark, sf):
    e = events(spark, sf).select(F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("user_id"), "us", "event_id", "event_type", "cents")
    left = e.where("event_type = 'view'").select("user_id", "us", "event_id", (F.col("cents") % 5).alias("mark"))
    right = e.where("event_type = 'purchase'").select("user_id", "us", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("cents")).alias("cents"))
    return left.union(left), right


def _items(df):
    return df.select("user_id", "event_id", "mark", F.array_join(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("items"))


@query(f"SELECT l.user_id, l.event_id, mark, r.event_id AS rid, cents FROM {ODD_LEFT_SQL} l ASOF LEFT JOIN {ODD_RIGHT_SQL} r ON coalesce(l.user_id, -1) = coalesce(r.user_id, -1) AND l.us >= r.us")
def join_last_odd(spark, sf):
    left, right = _odd_sides(spark, sf)
    right = right.withColumn("rid", F.col("event_id"))
    return joins.join_last(left, right, ["user_id"], ["rid", "cents"], O, width=6 * HOUR).select("user_id", "event_id", "mark", "rid", "cents")


@query(f"""WITH r AS (SELECT *, list(coalesce(CAST(cents AS VARCHAR), '-')) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 2 PRECEDING) AS l FROM {ODD_RIGHT_SQL})
SELECT l.user_id, l.event_id, mark, coalesce(array_to_string(r.l, ','), '') AS items FROM {ODD_LEFT_SQL} l ASOF LEFT JOIN r ON coalesce(l.user_id, -1) = coalesce(r.user_id, -1) AND l.us >= r.us""")
def join_last_n_odd(spark, sf):
    left, right = _odd_sides(spark, sf)
    return _items(joins.join_last_n(left, right, 3, ["user_id"], "cents", O))


@query(f"""SELECT any_value(l.user_id) AS user_id, any_value(l.event_id) AS event_id, any_value(mark) AS mark, coalesce(string_agg(CASE WHEN r.us IS NOT NULL THEN coalesce(CAST(cents AS VARCHAR), '-') END, ',' ORDER BY r.us), '') AS items
FROM {ODD_LEFT_SQL} l LEFT JOIN {ODD_RIGHT_SQL} r ON l.user_id IS NOT DISTINCT FROM r.user_id AND r.us > l.us - {48 * HOUR} AND r.us <= l.us GROUP BY lid""")
def join_last_time_odd(spark, sf):
    left, right = _odd_sides(spark, sf)
    return joins.join_last_time(left, right, 48 * HOUR, ["user_id"], "cents", ["user_id", "event_id", "mark"], (",", "-"))


@query("SELECT count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT CASE WHEN event_type <> '' THEN replace(replace(props, 'k', 'K'), 'K', 'k') END AS p FROM events) WHERE p <> ''")
def tuple_passing(spark, sf):
    """A chain of five times (drop empty texts, replace a letter, replace it back), as one projection."""
    rows = events(spark, sf).select("props")
    for _ in range(5):
        rows = rows.where("props <> ''").withColumn("props", F.replace("props", F.lit("k"), F.lit("K"))).withColumn("props", F.replace("props", F.lit("K"), F.lit("k")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("chars"))
