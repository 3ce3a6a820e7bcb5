"""Checks of a stream's contents: each returns one row (check, ok, found)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


def _verdict(df: DataFrame, name: str, ok: Column, found: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), ok.alias("ok"), found.cast("long").alias("found"))


def count(df: DataFrame, n: int, exact: bool = True) -> DataFrame:
    c = df.agg(F.count(F.lit(1)).alias("n"))
    return _verdict(c, "count", F.col("n") == n if exact else F.col("n") >= n, F.col("n"))


def rows(df: DataFrame, condition: Column) -> DataFrame:
    c = df.agg(F.count_if(~F.coalesce(condition, F.lit(False))).alias("n"))
    return _verdict(c, "rows", F.col("n") == 0, F.col("n"))


def contents(df: DataFrame, expected: DataFrame) -> DataFrame:
    """The same rows, each as often; found: rows too many on either side."""
    names = df.columns
    n = df.withColumn("_n", F.lit(1)).unionByName(expected.select(*names).withColumn("_n", F.lit(-1))).groupBy(*names).agg(F.sum("_n").alias("_n"))
    return _verdict(n.agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("n")), "contents", F.col("n") == 0, F.col("n"))


def contents_ordered(df: DataFrame, expected: DataFrame, order_by: list[str]) -> DataFrame:
    """The same rows in the same places of the order; found: places that differ."""
    names = df.columns
    a = order.numbered(df, order_by, "_i").select("_i", F.struct(*names).alias("_a"))
    b = order.numbered(expected, order_by, "_i").select("_i", F.struct(*names).alias("_b"))
    n = a.join(b, "_i", "full_outer").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n"))
    return _verdict(n, "contents_ordered", F.col("n") == 0, F.col("n"))


def markers(df: DataFrame, marker: Column, n: int) -> DataFrame:
    c = df.agg(F.count_if(marker).alias("n"))
    return _verdict(c, "markers", F.col("n") == n, F.col("n"))
