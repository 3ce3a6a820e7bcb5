"""Topic names, filters with + and #, and matching of many filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_valid(c: Column) -> Column:
    return F.coalesce((c != "") & ~c.rlike("[\\x00+#]"), F.lit(False))


def filter_valid(c: Column) -> Column:
    """# only alone or last after a slash; + only as a whole level."""
    return F.coalesce(c.rlike("\\A(?:(?:\\+|[^\\x00+#/]*)(?:/(?:\\+|[^\\x00+#/]*))*(?:/#)?|#)\\z") & (c != ""), F.lit(False))


def pattern(topic_filter: str) -> str:
    """An anchored regular expression: + is one level, perhaps empty; a/# is a and all below it; # is everything."""
    if topic_filter == "#":
        return "(?s)^.*$"
    body, deep = (topic_filter[:-2], True) if topic_filter.endswith("/#") else (topic_filter, False)
    levels = ["[^/]*" if x == "+" else re.escape(x) for x in body.split("/")]
    return "(?s)^" + "/".join(levels) + ("(?:/.*)?" if deep else "") + "(?!.)"  # $ would pass over a last line end


def matches(c: Column, topic_filter: str) -> Column:
    return c.rlike(pattern(topic_filter))


def fan_out(df: DataFrame, filters: DataFrame | list[str], topic: str = "topic") -> DataFrame:
    """A row for each filter that matches the row's topic; filters is a list, or a frame whose first column holds them.

    Filters form a trie, a table of their beginnings. Each different topic walks down it, a join a level: to the beginning
    with its own next level, and to that with +. So the plan grows with the depth of filters and not with their number, and
    a topic meets only the filters that match it. Filters that repeat count once; null and empty ones, and null topics,
    match nothing.
    """
    if isinstance(filters, list):
        filters = df.sparkSession.createDataFrame([(f,) for f in filters], "filter string")
    every = filters.select(F.col(filters.columns[0]).alias("filter")).where("filter <> ''").distinct().withColumn("_l", F.split("filter", "/", -1))
    deep = F.element_at("_l", -1) == "#"
    kinds = every.withColumn("_n", F.size("_l") - deep.cast("int")).withColumn("_at", F.array_join(F.slice("_l", F.lit(1), F.col("_n")), "/"))
    ends = kinds.select("filter", "_at", F.col("_n").alias("_d"), deep.alias("_deep"))
    nodes = kinds.where("_n > 0").select(F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_d"), "_l")
    nodes = nodes.select("_d", F.array_join(F.slice("_l", F.lit(1), F.col("_d")), "/").alias("_at")).distinct()
    depth = ends.agg(F.max("_d")).first()[0] or 0
    topics = df.select(F.col(topic).alias("_topic")).where("_topic is not null").distinct().withColumn("_levels", F.split("_topic", "/", -1))
    here = topics.withColumns({"_at": F.lit(""), "_d": F.lit(0)})
    found = here
    for d in range(1, depth + 1):
        level = F.get("_levels", F.lit(d - 1))
        step = [x if d == 1 else F.concat("_at", F.lit("/"), x) for x in (level, F.lit("+"))]
        here = here.where(F.size("_levels") >= d).select("_topic", "_levels", F.explode(F.array_distinct(F.array(*step))).alias("_at"), F.lit(d).alias("_d"))
        here = here.join(nodes, ["_at", "_d"], "left_semi").select("_topic", "_levels", "_at", "_d")
        found = found.unionByName(here)
    met = found.join(ends, ["_at", "_d"]).where(F.col("_deep") | (F.col("_d") == F.size("_levels"))).select("_topic", "filter").distinct()
    return df.join(met, F.col(topic) == F.col("_topic")).drop("_topic")


def in_filter(c: Column, values: list[str]) -> Column:
    return c.isin(*values) if values else c != ""
