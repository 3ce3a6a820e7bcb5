"""Order over a whole stream without sorting it in one task: numbers, running totals and neighbours by buckets of the order.

Buckets are ranges of a numeric order column (never of partitions, whose bounds are sampled anew at each run). What passes through one
task is a row for each bucket; the rows themselves are sorted bucket by bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the rows are dealt to by quantiles: at least, at most, and rows in one between these.
BUCKETS, BUCKET_ROWS = (8, 1 << 16), 200_000
#: Up to so many buckets the bounds come from the pass that counts the rows.
GRID = 1024
#: The bucket of rows without an order value; they come first.
NO_ORDER = -(1 << 62)


def place_of(values: list, x: Column) -> Column:
    """How many of the ascending values are less than x, by halving steps; null for null."""
    if not values:
        return F.when(x.isNotNull(), 0)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(values).bit_length()))))
    every = F.lit(values).cast(f"array<{'double' if isinstance(values[0], float) else 'bigint'}>")
    found = F.aggregate(steps, F.lit(0), lambda a, k: F.when((a + k <= len(values)) & (F.get(every, a + k - 1) < x), a + k).otherwise(a))
    return F.when(x.isNotNull(), found)


def measured(df: DataFrame, column: str) -> tuple[list[float], int]:
    """Bounds that deal the rows to buckets of about BUCKET_ROWS, the same for every task and retry as the driver keeps them, and how
    many rows there are. Both come from one pass; only a table of more than GRID buckets needs a second one, for finer bounds."""
    x = F.col(column).cast("double")
    grid = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, [i / GRID for i in range(1, GRID)], 4 * GRID).alias("q")).first()
    n = min(max(BUCKETS[0], grid["n"] // BUCKET_ROWS), BUCKETS[1])
    if n <= GRID:
        found = [grid["q"][GRID * i // n - 1] for i in range(1, n)] if grid["q"] else []
    else:
        found = df.select(x.alias("_x")).where("_x is not null").approxQuantile("_x", [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted(set(found)), grid["n"]


def bucketed(df: DataFrame, order: str, width: int | list[float] | None = None) -> DataFrame:
    """Adds _bucket: ranges of so wide a span of order, or between bounds that are given, or, without width, ranges that hold about
    as many rows each. A row's range among bounds is found by binary search in the JVM."""
    if isinstance(width, int):
        bucket = F.floor(F.col(order) / F.lit(width)).cast("long")
        return df.withColumn("_bucket", F.coalesce(bucket, F.lit(NO_ORDER)))
    bounds = measured(df, order)[0] if width is None else width
    splits = [float("-inf"), *(x for x in bounds if math.isfinite(x)), float("inf")]
    if len(splits) == 2:
        return df.withColumn("_bucket", F.when(F.col(order).isNull(), F.lit(NO_ORDER)).otherwise(F.lit(0).cast("long")))
    found = Bucketizer(splits=splits, inputCol="_at", outputCol="_found", handleInvalid="keep").transform(df.withColumn("_at", F.col(order).cast("double")))
    return found.withColumn("_bucket", F.when(F.col(order).isNull(), F.lit(NO_ORDER)).otherwise(F.col("_found").cast("long"))).drop("_at", "_found")


def by_bucket(order_by: list[str], keys: list[str] | None = None):
    return Window.partitionBy(*(keys or []), "_bucket").orderBy(*order_by)


def running(df: DataFrame, sums: dict[str, Column], order_by: list[str], keys: list[str] | None = None, width: int | list[float] | None = None, peers: bool = False) -> DataFrame:
    """Adds a running sum, this row included, of each column expression in sums; over all rows, or by keys. With peers, rows of
    equal order_by are included too."""
    keys = keys or []
    parts = bucketed(df, order_by[0], width).withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    totals = parts.groupBy(*keys, "_bucket").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    on = F.col("_bucket") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = by_bucket(order_by, keys)
    w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(totals, on).withColumns({n: F.col(f"_s_{n}") + F.sum(f"_v_{n}").over(w) for n in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, order_by: list[str], name: str = "seq", width: int | list[float] | None = None) -> DataFrame:
    """Adds each row's place in the whole order, from 0."""
    return running(df, {"_n": F.lit(1)}, order_by, width=width).select(*df.columns, (F.col("_n") - 1).alias(name))


def carried(df: DataFrame, value: Column, name: str, order_by: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Adds the last value that isn't null up to and with each row: in its bucket, else what the buckets before it carry on."""
    keys = keys or []
    parts = bucketed(df, order_by[0], width).withColumn("_v", value)
    marks = parts.groupBy(*keys, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order_by))).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_b"), F.last("_l", ignorenulls=True).over(before).alias("_c"))
    on = F.col("_bucket") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = by_bucket(order_by, keys).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(marks, on).withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_c")))
    return out.select(*df.columns, name)


def blocks(df: DataFrame, n: int, order_by: list[str], keys: list[str] | None = None, block: int | None = None, width: int | None = None) -> DataFrame:
    """Adds _g (a row's place in the whole order, or in its key's, from 0), _block (of so many rows) and _in: each row stands in its
    own block, and the last n - 1 of a block in the next one too. With keys and _in as a window's partition, one that looks back less
    than n rows needs no row of another partition, however many rows a key has."""
    if n <= 0:
        raise ValueError("a window holds one row at least")
    block = max(n, block or 20_000)
    rows = running(df, {"_g": F.lit(1)}, order_by, keys, width).withColumn("_g", F.col("_g") - 1).withColumn("_block", F.floor(F.col("_g") / block))
    halo = F.when((F.col("_g") % block) >= block - (n - 1), F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
    return rows.withColumn("_in", F.explode(halo))


def last_n(df: DataFrame, n: int, aggregates: dict[str, Column], order_by: list[str], block: int | None = None, width: int | None = None, keys: list[str] | None = None, place: str | None = None) -> DataFrame:
    """Aggregates of the last n rows of the whole stream, or of a row's key, at each row; place, if given, is the name of the column for
    its place there, from 0. Blocks of rows are windows' partitions; each gets a copy of the n - 1 rows before it."""
    w = Window.partitionBy(*(keys or []), "_in").orderBy("_g").rowsBetween(-(n - 1), 0)
    out = blocks(df, n, order_by, keys, block, width).withColumns({k: a.over(w) for k, a in aggregates.items()})
    return out.where("_in = _block").select(*df.columns, *aggregates, *([F.col("_g").alias(place)] if place else []))


def heavy(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with more than so many rows, and all others. Counts are made before anything is dealt by key; a null key is a key."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > rows).select(*(F.col(k).alias(f"_k_{k}") for k in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(found, on, "left_semi"), df.join(found, on, "left_anti")


def time_blocks(df: DataFrame, at: str, micros: int, ahead: Column | None = None) -> DataFrame:
    """Each row in its block of micros (_block) and, where ahead holds (always, if not given), in the next one too: with _in as
    a key, windows that look back less than micros need no row of another key. Rows without a time have a block of their own."""
    block = F.coalesce(F.floor(F.col(at) / F.lit(micros)).cast("long"), F.lit(NO_ORDER))
    both = F.array("_block", F.col("_block") + 1)
    return df.withColumn("_block", block).withColumn("_in", F.explode(both if ahead is None else F.when(ahead, both).otherwise(F.array("_block"))))
