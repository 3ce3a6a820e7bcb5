"""Row by row: filters, splits, projections, routing, placement."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_sides(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    c = F.coalesce(condition, F.lit(False))
    return df.where(c), df.where(~c)


def split(df: DataFrame, n: int, port: Column) -> DataFrame:
    """Adds port: the value modulo n; rows with a negative or null one go."""
    if n <= 0:
        raise ValueError("there is one output at least")
    return df.withColumn("port", F.when(port >= 0, port % n).cast("int")).where("port is not null")


def mapped(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """One output row for each that value isn't null for."""
    return df.select(*keep, value.alias(name)).where(F.col(name).isNotNull())


def words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each word, with its place."""
    return df.select(*keep, F.posexplode(F.split(text, " ")).alias("pos", "word")).where("word <> ''")


def catch(df: DataFrame, column: str, dtype: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value converts (converted), and the others."""
    c = F.col(column).try_cast(dtype)
    return df.withColumn(column, c).where(F.col(column).isNotNull()), df.where(c.isNull())


def sample(df: DataFrame, fraction: float, key: str) -> DataFrame:
    """The same rows at each run: those whose key's md5 is low."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies in 0 to 1")
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < int(fraction * 2**32))


def grep(df: DataFrame, column: str, pattern: str, mode: str = "search") -> DataFrame:
    """Rows whose column holds the pattern somewhere, or, with mode "full", is matched by it from the first letter to the last."""
    return df.where(F.col(column).rlike(f"\\A(?:{pattern})\\z" if mode == "full" else pattern))


def any_contains(df: DataFrame, term: str) -> DataFrame:
    return df.where(functools.reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").contains(term), F.lit(False)) for c in df.columns)))


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all; a frame given twice counts once, and with no others it is the first itself."""
    different = list({id(f): f for f in (first, *others)}.values())
    return functools.reduce(lambda a, b: a.unionByName(b), different)


def parallel(df: DataFrame, width: int, keys: list[str] | None = None, channel: Column | None = None) -> DataFrame:
    """Rows dealt evenly, by keys, or by a channel number that stays visible."""
    if channel is not None:
        return df.withColumn("channel", F.pmod(channel, F.lit(width)).cast("int")).repartition(width, "channel")
    return df.repartition(width, *(keys or []))


def broadcast_to(df: DataFrame, width: int) -> DataFrame:
    """Each row on each of width channels."""
    return df.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def marked(df: DataFrame, marker: Column, where: str) -> DataFrame:
    """Rows with markers among them, live or not: is_marker, and place (0 or 1) in the order of a row and the marker that stands
    "before" or "after" it, or "replace"s it. A marker has its row's columns, so that it can be put in order."""
    row, mark = (F.struct(F.lit(m).alias("m")) for m in (False, True))
    if where not in ("before", "after", "replace"):
        raise ValueError("a marker stands before, after or in place of a row")
    made = {"before": F.array(mark, row), "after": F.array(row, mark), "replace": F.array(mark)}[where]
    out = df.select(*df.columns, F.posexplode(F.when(F.coalesce(marker, F.lit(False)), made).otherwise(F.array(row))).alias("place", "_m"))
    return out.select(*df.columns, "place", F.col("_m.m").alias("is_marker"))
