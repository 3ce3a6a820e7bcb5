"""Queries on rows: filters, projections, JSON, collections, topics, placement, user functions, checks."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import schema, topics, values
from ..operators import checks, rows
from ..sources import tables
from ..sources.tables import EVENTS_SQL, events, table
from .registry import query

TOPIC_SQL = "event_type || '/' || user_id || '/' || k"


def topic_events(spark, sf):
    return events(spark, sf).withColumn("topic", F.concat_ws("/", "event_type", F.col("user_id").cast("string"), F.col("k").cast("string")))


@query(f"SELECT event_id, value FROM {EVENTS_SQL} WHERE event_type = 'purchase' AND value > 50")
def filter_basic(spark, sf):
    return events(spark, sf).where("event_type = 'purchase' and value > 50").select("event_id", "value")


@query("SELECT CASE WHEN c_acctbal > 5000 THEN 'match' ELSE 'rest' END AS side, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS cents FROM customer GROUP BY 1")
def filter_both(spark, sf):
    match, rest = rows.both_sides(table(spark, sf, "customer"), F.col("c_acctbal") > 5000)
    both = match.withColumn("side", F.lit("match")).unionByName(rest.withColumn("side", F.lit("rest")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("SELECT CAST((l_linenumber - 2) % 3 AS INTEGER) AS port, count(*) AS n FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1")
def split_n(spark, sf):
    return rows.split(table(spark, sf, "lineitem").select("l_linenumber"), 3, F.col("l_linenumber") - 2).groupBy("port").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, k + 17 AS v FROM {EVENTS_SQL} WHERE k <> 68")
def map_drop_null(spark, sf):
    return rows.mapped(events(spark, sf), F.when(F.col("k") != 68, F.col("k") + 17), "v", "event_id")


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def modify(spark, sf):
    return table(spark, sf, "customer").withColumn("c_name", F.upper("c_name")).select("c_custkey", "c_name")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) WHERE w <> ''")
def flat_map_words(spark, sf):
    return rows.words(table(spark, sf, "documents"), "text", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_linenumber % 4 = 0")
def functor(spark, sf):
    return table(spark, sf, "lineitem").where("l_linenumber % 4 = 0").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"))


@query("SELECT event_id, CAST(k AS SMALLINT) AS k, '' AS note, CAST(NULL AS BIGINT) AS extra FROM " + EVENTS_SQL)
def schema_conform(spark, sf):
    return schema.conform(events(spark, sf), schema.parse_schema("tuple<int64 event_id, int16 k, rstring note, optional<int64> extra>"))


@query(f"SELECT event_id, user_id, '' AS tag FROM {EVENTS_SQL}")
def schema_extend(spark, sf):
    both = schema.extend(schema.parse_schema("tuple<int64 event_id, int64 user_id>"), schema.parse_schema("tuple<rstring[10] tag>"))
    return schema.conform(events(spark, sf), both)


@query(f"SELECT 'good' AS side, count(*) AS n FROM {EVENTS_SQL} WHERE k % 5 <> 0 UNION ALL SELECT 'bad', count(*) FROM {EVENTS_SQL} WHERE k % 5 = 0")
def catch_bad_rows(spark, sf):
    text = events(spark, sf).select(F.when(F.col("k") % 5 == 0, F.lit("five")).otherwise(F.col("k").cast("string")).alias("s"))
    good, bad = rows.catch(text, "s", "int")
    return good.select(F.lit("good").alias("side")).union(bad.select(F.lit("bad"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 429496729")
def sample_hash(spark, sf):
    return rows.sample(table(spark, sf, "lineitem"), 0.1, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def str_contains(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").contains("License")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE starts_with(text, 'An')")
def str_startswith(spark, sf):
    return table(spark, sf, "documents").where(F.startswith("text", F.lit("An"))).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE regexp_full_match(CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) ELSE c_name END, 'Customer#0+[1-9]*')")
def grep_full(spark, sf):
    """Names that end in a line end are no full matches."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\n"))).otherwise(F.col("c_name"))
    return rows.grep(table(spark, sf, "customer").withColumn("c_name", name), "c_name", "Customer#0+[1-9]*", "full").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[a-z]tion [a-z]+ble')")
def grep_search(spark, sf):
    return rows.grep(table(spark, sf, "documents"), "text", "[a-z]tion [a-z]+ble").select("doc_id")


@query("SELECT s_suppkey, s_name FROM (SELECT s_suppkey, s_name FROM supplier) WHERE contains(CAST(s_suppkey AS VARCHAR), '7') OR contains(s_name, '7')")
def any_contains(spark, sf):
    return rows.any_contains(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "7")


@query("SELECT CASE WHEN c_acctbal >= 8000 THEN 0 ELSE 1 END AS port, count(*) AS n FROM customer WHERE c_acctbal >= 6000 GROUP BY 1")
def score_route(spark, sf):
    port = F.when(F.col("c_acctbal") >= 8000, 0).when(F.col("c_acctbal") >= 6000, 1)
    return table(spark, sf, "customer").withColumn("port", port).where("port is not null").groupBy("port").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, v FROM (SELECT l_orderkey, l_linenumber, least(CASE WHEN l_orderkey >= 10 THEN CAST(l_orderkey AS BIGINT) END, CASE WHEN l_partkey >= 10 THEN CAST(l_partkey AS BIGINT) END, CASE WHEN l_suppkey >= 10 THEN CAST(l_suppkey AS BIGINT) END) AS v FROM lineitem) WHERE v IS NOT NULL")
def lowest_above(spark, sf):
    numbers = F.array(*(F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey")))
    return rows.mapped(table(spark, sf, "lineitem"), F.array_min(F.filter(numbers, lambda x: x >= 10)), "v", "l_orderkey", "l_linenumber")


@query(f"SELECT event_id, CASE WHEN k % 15 = 0 THEN 'FizzBuzz' WHEN k % 3 = 0 THEN 'Fizz' WHEN k % 5 = 0 THEN 'Buzz' ELSE CAST(k AS VARCHAR) END AS label FROM {EVENTS_SQL} WHERE k <> 0")
def case_label(spark, sf):
    k = F.col("k")
    label = F.when(k == 0, None).when((k % 3 == 0) | (k % 5 == 0), F.concat(F.when(k % 3 == 0, "Fizz").otherwise(""), F.when(k % 5 == 0, "Buzz").otherwise(""))).otherwise(k.cast("string"))
    return rows.mapped(events(spark, sf), label, "label", "event_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS string FROM orders")
def as_string(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("string"))


@query("SELECT '{\"o_orderkey\":' || o_orderkey || ',\"priority\":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '\"' || o_orderpriority || '\"' END || '}' AS jsonString FROM orders")
def as_json(spark, sf):
    return values.as_json(table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority")))


@query("SELECT '{\"payload\":\"' || c_name || '\"}' AS jsonString FROM customer")
def as_json_payload(spark, sf):
    return table(spark, sf, "customer").select(values.payload_json(F.col("c_name")).alias("jsonString"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '{{\"payload\":[' || k || ']}}' ELSE '{{\"payload\":' || k || '}}' END AS jsonString FROM {EVENTS_SQL}")
def json_parse_wrap(spark, sf):
    e = events(spark, sf)
    k = F.col("k").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), k, F.lit("]"))).otherwise(k)
    space = F.when(F.col("event_id") % 2 == 0, F.lit("\n\t")).otherwise(F.lit(" "))
    return e.select("event_id", values.json_object(F.concat(space, text, space)).alias("jsonString"))


@query("SELECT '{\"event_id\":' || event_id || ',\"k\":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE CAST(k AS VARCHAR) END || '}' AS jsonString FROM " + EVENTS_SQL)
def json_serialize(spark, sf):
    return values.as_json(events(spark, sf).select("event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k")))


def _nested(spark, sf):
    e = events(spark, sf)
    return e.select(F.concat(F.lit('{"a":"p"'), F.when(F.col("k") % 4 != 0, F.concat(F.lit(',"li.st":[{"v":'), F.col("k"), F.lit(',"b":2.5},'), F.col("event_id"), F.lit("]"))).otherwise(""), F.lit("}")).alias("j"))


@query(f"SELECT '{{\"v\":' || k || ',\"b\":2.5}}' AS jsonString FROM {EVENTS_SQL} WHERE k % 4 <> 0 UNION ALL SELECT '{{\"payload\":' || event_id || '}}' FROM {EVENTS_SQL} WHERE k % 4 <> 0")
def json_flatten(spark, sf):
    return values.flatten_array(_nested(spark, sf), "j", "li.st")


@query(f"SELECT '{{\"v\":' || k || ',\"b\":2.5,\"a\":\"p\"}}' AS jsonString FROM {EVENTS_SQL} WHERE k % 4 <> 0 UNION ALL SELECT '{{\"payload\":' || event_id || ',\"a\":\"p\"}}' FROM {EVENTS_SQL} WHERE k % 4 <> 0")
def json_flatten_extra(spark, sf):
    return values.flatten_array(_nested(spark, sf), "j", "li.st", "a", "b")


@query("SELECT l_orderkey, unnest([l_partkey, l_suppkey, l_partkey]) AS item FROM lineitem")
def flatten_list(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey", "l_partkey")).alias("item"))


@query("SELECT l_orderkey, l_linenumber, unnest(list_distinct([l_partkey, l_suppkey, l_partkey])) AS item FROM lineitem")
def flatten_set(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array_sort(F.array_distinct(F.array("l_partkey", "l_suppkey", "l_partkey")))).alias("item"))


@query("SELECT l_orderkey, 'part' AS key, l_partkey AS value FROM lineitem UNION ALL SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem")
def flatten_map(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.explode(F.create_map(F.lit("part"), "l_partkey", F.lit("supplier"), "l_suppkey")))


@query(f"SELECT event_id, us AS a, us // 1000 * 1000 AS b, us AS c FROM {EVENTS_SQL}")
def ts_from_int(spark, sf):
    us = F.col("us")
    return events(spark, sf).select("event_id", F.unix_micros(values.timestamp_of(us, "Microseconds")).alias("a"), F.unix_micros(values.timestamp_of(F.floor(us / 1000))).alias("b"), F.unix_micros(values.timestamp_of(us * 1000 + 7, "Nanoseconds")).alias("c"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority || ', \"' || o_orderstatus || '\"' END AS note FROM orders")
def csv_format_parse(spark, sf):
    rows_ = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"'))).alias("note"))
    text = rows_.select(F.to_csv(F.struct("o_orderkey", "note")).alias("line"))
    return text.select(F.from_csv("line", F.lit("o_orderkey BIGINT, note STRING")).alias("r")).select("r.*")


@query("SELECT '{c_custkey=' || c_custkey || ',c_name=' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '\"' || c_name || ' \\\"' || c_mktsegment || '\\\"\"' END || ',l=[\"' || c_name || '\",null],t={s=\"' || c_mktsegment || '\",n=' || c_custkey || '},m={\"k\":' || c_custkey || '}}' AS string FROM customer")
def tuple_string(spark, sf):
    """Strings, nulls, and a list, a tuple and a map inside."""
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('"')))
    inside = [F.array("c_name", F.lit(None)).alias("l"), F.struct(F.col("c_mktsegment").alias("s"), F.col("c_custkey").alias("n")).alias("t"), F.create_map(F.lit("k"), "c_custkey").alias("m")]
    n = table(spark, sf, "customer").select("c_custkey", name.alias("c_name"), *inside)
    return n.select(values.tuple_string(n).alias("string"))


@query("SELECT c_name AS string FROM customer")
def attr_to_string(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").cast("string").alias("string"))


@query("SELECT 'event: ' || event_id AS line FROM events")
def print_tag(spark, sf):
    return events(spark, sf).select(F.concat_ws(": ", F.lit("event"), F.col("event_id").cast("string")).alias("line"))


@query("SELECT o_orderkey || '.' || ['txt', 'csv', 'log', 'xtxt'][o_orderkey % 4 + 1] AS file FROM orders WHERE o_orderkey % 4 IN (0, 2)")
def file_suffix_filter(spark, sf):
    suffix = F.get(F.array(*map(F.lit, ("txt", "csv", "log", "xtxt"))), (F.col("o_orderkey") % 4).cast("int"))
    files = table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("."), suffix).alias("file"))
    return files.where(tables.has_suffix(F.col("file"), "txt", "log"))


CUSTOMERS_SQL = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name || ', "' || c_mktsegment || '"' END AS note, c_acctbal FROM customer"""


def _customers(spark, sf):
    """With nulls, empty texts, quotes and commas."""
    key = F.col("c_custkey") % 4
    note = F.when(key == 0, None).when(key == 1, "").otherwise(F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    return table(spark, sf, "customer").select("c_custkey", note.alias("note"), "c_acctbal")


@query(CUSTOMERS_SQL)
def sink_csv_roundtrip(spark, sf):
    path, n = tables.shared_folder(spark, "csv"), _customers(spark, sf)
    tables.write_csv(n, path)
    return tables.csv_table(spark, path, n.schema)


@query(f"SELECT codec, c_custkey, note, c_acctbal FROM ({CUSTOMERS_SQL}), (SELECT unnest(['none', 'gzip', 'bzip2']) AS codec)")
def src_csv(spark, sf):
    """Files without a header, plain and compressed, read to a declared schema."""
    path, n, out = tables.shared_folder(spark, "csv"), _customers(spark, sf), None
    for codec in ("none", "gzip", "bzip2"):
        tables.write_csv(n, f"{path}/{codec}", codec)
        got = tables.csv_table(spark, f"{path}/{codec}", schema.parse_schema("tuple<int64 c_custkey, optional<rstring> note, optional<float64> c_acctbal>"))
        out = rows.union(got.withColumn("codec", F.lit(codec)), *([out] if out is not None else []))
    return out


@query("SELECT kind, weight, count(*) * weight AS total FROM events JOIN (VALUES ('view', 1), ('click', 2), ('purchase', 5)) v(kind, weight) ON event_type = kind GROUP BY 1, 2")
def src_constants(spark, sf):
    """Constant rows, one of them None, that weigh the events of their kind."""
    weights = tables.constants(spark, [("view", 1), None, ("click", 2), ("purchase", 5)], "kind string, weight long").drop("_i")
    return events(spark, sf).join(F.broadcast(weights), F.col("event_type") == F.col("kind")).groupBy("kind", "weight").agg((F.count(F.lit(1)) * F.col("weight")).alias("total"))


@query("SELECT n, n * 3 + 1 AS \"value\" FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS n) WHERE n % 4 <> 0")
def src_counter(spark, sf):
    """As many numbers as there are events; the row function leaves each fourth out."""
    return tables.counter(spark, events(spark, sf).count(), F.when(F.col("n") % 4 != 0, F.col("n") * 3 + 1))


@query("SELECT n, n * n % 1009 AS \"value\" FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS n) WHERE n % 5 <> 0")
def udf_source(spark, sf):
    """A source in Python that makes as many rows as there are events, in parts."""
    spark.dataSource.register(tables.generated(lambda n: n * n % 1009 if n % 5 else None))
    return spark.read.format("generated").option("rows", str(events(spark, sf).count())).option("parts", "16").load()


@query(f"SELECT event_type AS counter, count(*) AS n, sum(cents)::BIGINT AS total FROM {EVENTS_SQL} GROUP BY 1")
def observe_counts(spark, sf):
    """Counters that are kept beside a job while it writes its rows."""
    e = events(spark, sf)
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]  # a name each
    seen = Observation("events")
    counts = [c for i, k in enumerate(kinds) for c in (F.count_if(F.col("event_type") == k).alias(f"n{i}"), F.sum(F.when(F.col("event_type") == k, F.col("cents"))).alias(f"t{i}"))]
    e.observe(seen, *(counts or [F.count(F.lit(1)).alias("n")])).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, seen.get[f"n{i}"], seen.get[f"t{i}"]) for i, k in enumerate(kinds)], "counter string, n long, total long")


@query(f"SELECT {TOPIC_SQL} AS topic, CAST(user_id AS VARCHAR) AS key, props AS message FROM {EVENTS_SQL}")
def kafka_decode(spark, sf):
    e = topic_events(spark, sf)
    raw = e.select(F.col("topic").cast("binary").alias("topic"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"))
    return tables.message_from_kafka(raw)


@query(f"SELECT 'all' AS topic, CAST(user_id AS VARCHAR) AS key, props AS value FROM {EVENTS_SQL}")
def kafka_encode(spark, sf):
    m = topic_events(spark, sf).select("topic", F.col("user_id").cast("string").alias("key"), F.col("props").alias("message"))
    return tables.message_to_kafka(m, "all").select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT l_orderkey AS key FROM lineitem UNION ALL SELECT o_orderkey FROM orders")
def union_all(spark, sf):
    return rows.union(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")))


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_set(spark, sf):
    n, r = table(spark, sf, "customer").select(F.col("c_name").alias("name")), table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return rows.union(n, r, n)


@query("SELECT l_orderkey, l_linenumber, l_quantity + 19 AS q FROM lineitem")
def par_round_robin(spark, sf):
    return rows.parallel(table(spark, sf, "lineitem"), 5).select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 19).alias("q"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def par_key(spark, sf):
    s = table(spark, sf, "lineitem").select("l_suppkey")
    return rows.parallel(s, 5, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST((l_orderkey + 89) % 5 AS INTEGER) AS channel, count(*) AS n FROM lineitem GROUP BY 1")
def par_hash_channel(spark, sf):
    return rows.parallel(table(spark, sf, "lineitem"), 5, channel=F.col("l_orderkey") + 89).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(c AS INTEGER) AS channel FROM orders, range(3) AS r(c)")
def par_broadcast(spark, sf):
    return rows.broadcast_to(table(spark, sf, "orders").select("o_orderkey"), 3)


@query(f"SELECT DISTINCT {TOPIC_SQL} AS topic, true AS name_ok, false AS plus_ok FROM {EVENTS_SQL}")
def topic_valid(spark, sf):
    t = topic_events(spark, sf).select("topic").distinct()
    return t.select("topic", topics.name_valid(F.col("topic")).alias("name_ok"), topics.filter_valid(F.concat("topic", F.lit("+"))).alias("plus_ok"))


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE event_type = 'click' AND k = 7 AND event_id % 2 = 0 UNION ALL SELECT event_id FROM {EVENTS_SQL} WHERE event_type = 'view' AND user_id = 3")
def topic_match(spark, sf):
    """Topics of odd events end in a line end, which is a letter like others."""
    e = topic_events(spark, sf)
    e = e.withColumn("topic", F.when(F.col("event_id") % 2 == 0, F.col("topic")).otherwise(F.concat("topic", F.lit("\n"))))
    return e.where(topics.matches(F.col("topic"), "click/+/7") | topics.matches(F.col("topic"), "view/3/#")).select("event_id")


@query(f"SELECT filter, count(*) AS n FROM (SELECT unnest([CASE WHEN event_type = 'click' THEN 'click/#' END, CASE WHEN user_id = 3 THEN '+/3/+' END, '#']) AS filter FROM {EVENTS_SQL}) WHERE filter IS NOT NULL GROUP BY 1")
def topic_fanout(spark, sf):
    filters = spark.createDataFrame([("click/#",), ("+/3/+",), ("#",), ("click/#",), ("nothing/+",)], "filter string")
    return topics.fan_out(topic_events(spark, sf), filters).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE event_type IN ('click', 'view') AND user_id = 3")
def topic_filtered(spark, sf):
    return events(spark, sf).where(topics.in_filter(F.col("event_type"), ["click", "view"]) & (F.col("user_id") == 3)).select("event_id")


@query(f"SELECT event_id, cents * 2 + 1 AS v FROM {EVENTS_SQL}")
def udf_map(spark, sf):
    @F.pandas_udf("long")
    def twice(c: pd.Series) -> pd.Series:
        return c * 2 + 1

    return events(spark, sf).select("event_id", twice("cents").alias("v"))


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE cents % 7 = 0")
def udf_filter(spark, sf):
    @F.pandas_udf("boolean")
    def wanted(c: pd.Series) -> pd.Series:
        return c % 7 == 0

    return events(spark, sf).where(wanted("cents")).select("event_id")


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS i FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 3)) AS i FROM orders)")
def udtf_expand(spark, sf):
    def expand(batches):
        for b in batches:
            n = (b.o_orderkey % 3).to_numpy()
            yield pd.DataFrame({"o_orderkey": np.repeat(b.o_orderkey.to_numpy(), n), "i": np.concatenate([np.arange(x) for x in n]) if len(n) else []}).astype({"i": "int32"})

    o = table(spark, sf, "orders").select("o_orderkey")
    return o.mapInPandas(expand, f"o_orderkey {o.dtypes[0][1]}, i int")


#: Centroids that one pass over the vectors compares with.
CENTROIDS = 10_000


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, any_value(e.label) AS label, arg_min(c.label, list_distance(CAST(e.embedding AS DOUBLE[]), c.c)) AS nearest FROM embeddings e, c GROUP BY 1""")
def score_model(spark, sf):
    """Nearest centroid of each vector; the centroids are means by label, as many as there are labels."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c")).orderBy("label")

    def against(block):
        labels, centroids = [m["label"] for m in block], np.array([m["c"] for m in block])
        step = max(1, 2**22 // len(labels))

        def score(batches):
            for b in batches:
                nearest, least = b.nearest.astype(object).to_numpy(copy=True), b.least.to_numpy("float64", copy=True)
                for i in range(0, len(b), step):
                    x = np.stack(b.embedding.to_numpy()[i : i + step])
                    d = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
                    at = d.argmin(1)
                    for k in np.flatnonzero(d.min(1) < least[i : i + step]):
                        nearest[i + k], least[i + k] = labels[at[k]], d[k, at[k]]
                yield b.assign(nearest=nearest, least=least)

        return score

    out = e.withColumns({"nearest": F.lit(None).cast(e.schema["label"].dataType), "least": F.lit(float("inf"))})
    rows = means.toLocalIterator()
    while block := list(itertools.islice(rows, CENTROIDS)):
        out = out.mapInPandas(against(block), out.schema)
    return out.select("vec_id", "label", "nearest")



@query(f"SELECT event_type, count(*) AS n FROM {EVENTS_SQL} WHERE k > 50 GROUP BY 1")
def composite_transform(spark, sf):
    def high(df):
        return df.where("k > 50")

    def counted(df):
        return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    return events(spark, sf).transform(high).transform(counted)


@query("SELECT 'count' AS \"check\", true AS ok, count(*) AS found FROM events")
def check_count(spark, sf):
    return checks.count(events(spark, sf), 1, exact=False)


@query("SELECT 'contents' AS \"check\", count(*) = 0 AS ok, 2 * count(*) AS found FROM events WHERE event_id % 100 = 7")
def check_contents(spark, sf):
    """Against a table in which each hundredth row differs."""
    e = events(spark, sf).select("event_id", "cents")
    return checks.contents(e, e.withColumn("cents", F.when(F.col("event_id") % 100 == 7, F.col("cents") + 1).otherwise(F.col("cents"))))


@query("SELECT 'contents_ordered' AS \"check\", count(*) = 0 AS ok, count(*) AS found FROM events WHERE event_id % 100 = 7")
def check_contents_ordered(spark, sf):
    """Against a table dealt otherwise, in which each hundredth row differs."""
    e = events(spark, sf).select("us", "event_id", "cents")
    other = e.withColumn("cents", F.when(F.col("event_id") % 100 == 7, F.col("cents") + 1).otherwise(F.col("cents")))
    return checks.contents_ordered(e, other.repartition(7), ["us", "event_id"])


@query(f"SELECT 'rows' AS \"check\", count(*) = 0 AS ok, count(*) AS found FROM {EVENTS_SQL} WHERE k >= 90")
def check_rows(spark, sf):
    return checks.rows(events(spark, sf), F.col("k") < 90)


@query(f"SELECT 'markers' AS \"check\", count(*) = 5 AS ok, count(*) AS found FROM {EVENTS_SQL} WHERE k = 0")
def check_punct(spark, sf):
    return checks.markers(events(spark, sf), F.col("k") == 0, 5)
