"""Un-keyed operators on a live stream: each micro-batch is put in order as a table, and what it carries on is written with its number.

A step gets the rows of a micro-batch and what the batch before it has carried, and returns rows and what goes on. A batch that is
tried again reads what its predecessor wrote, so it gives the same rows. Rows of a batch are ordered by order_by; across batches they
count as they come. What is carried is one row, or as many as a window holds or panes are open; it is never the whole stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, order

#: A step: rows of a micro-batch and the table that is carried (None at first) give rows and the next such table.
Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def write_steps(df: DataFrame, step: Step, out: str, checkpoint: str, done: Callable[[int], None] | None = None):
    """Start writing what step makes of each micro-batch to out, and what it carries on beside the query's state, both under the
    batch's number. done, if given, is called once both stand (again, if a batch is tried again). Ends when all that stands
    in the source at the start is done; returns the streaming query."""

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{checkpoint}/carried/batch={number - 1}") if number else None
        if before is not None and before.isEmpty():
            before = None
        batch.persist()
        try:
            rows, carried = step(batch, before)
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
            carried.write.mode("overwrite").parquet(f"{checkpoint}/carried/batch={number}")
        finally:
            batch.unpersist()
        if done:
            done(number)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _one(before: DataFrame | None) -> Row | None:
    return before.first() if before is not None else None


def _row(spark: SparkSession, values: Row | None, otherwise: Row | None, schema) -> DataFrame:
    """The table of one row that goes on: values, or what came before if the batch was empty."""
    kept = values if values is not None else otherwise
    return spark.createDataFrame([tuple(kept)] if kept is not None else [], schema)


def running(sums: dict[str, Column], order_by: list[str]) -> Step:
    """Adds a running sum of each whole-numbered expression, over all rows of the stream so far."""

    def step(batch: DataFrame, before: DataFrame | None):
        held = _one(before)
        totals = batch.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("decimal(38,0)").alias(n) for n, c in sums.items()))
        if held is not None:
            totals = totals.select(*((F.col(n) + F.lit(held[n])).cast("decimal(38,0)").alias(n) for n in sums))
        out = order.running(batch, sums, order_by)
        if held is not None:
            out = out.withColumns({n: (F.col(n) + F.lit(held[n])).cast(out.schema[n].dataType) for n in sums})
        return out, totals

    return step


def numbered(order_by: list[str], name: str = "seq") -> Step:
    """Adds each row's place in the stream, from 0."""
    counts = running({name: F.lit(1)}, order_by)

    def step(batch: DataFrame, before: DataFrame | None):
        rows, carried = counts(batch, before)
        return rows.withColumn(name, F.col(name) - 1), carried

    return step


def outliers(cents: str, threshold: float, order_by: list[str]) -> Step:
    """Rows whose size is above the running mean's plus threshold standard deviations over all rows so far."""
    from ..operators.analytics import beyond

    c = F.col(cents)
    sums = running({"_n": F.lit(1), "_s": c, "_q": (c * c).cast("decimal(38,0)")}, order_by)

    def step(batch: DataFrame, before: DataFrame | None):
        rows, carried = sums(batch, before)
        return beyond(rows, c, threshold).select(*batch.columns, "limit"), carried

    return step


def last_n(n: int, aggregates: dict[str, Column], order_by: list[str]) -> Step:
    """Adds aggregates of the stream's last n rows at each row; n - 1 rows are carried."""
    if n <= 0:
        raise ValueError("a window holds one row at least")

    def step(batch: DataFrame, before: DataFrame | None):
        new = batch.withColumn("_old", F.lit(0))
        both = new if before is None else before.withColumn("_old", F.lit(-1)).unionByName(new)
        out = order.last_n(both.withColumns({"_w": F.col("_old")}), n, aggregates, ["_w", *order_by]) if before is not None else order.last_n(both, n, aggregates, order_by)
        kept = both.orderBy(F.col("_old").desc(), *(F.col(c).desc() for c in order_by)).limit(n - 1).drop("_old")
        return out.where("_old = 0").select(*batch.columns, *aggregates), kept

    return step


def join_last(is_left: Column, values: list[str], order_by: list[str]) -> Step:
    """Rows of one stream that is_left holds for, with the values that the others have said last (nulls, if nothing yet)."""

    def step(batch: DataFrame, before: DataFrame | None):
        held = _one(before)
        left, right = batch.where(is_left).drop(*values), batch.where(~is_left)
        out = joins.join_last(left, right.withColumn("_said", F.lit(True)), [], [*values, "_said"], order_by)
        if held is not None:
            out = out.withColumns({v: F.when(F.col("_said"), F.col(v)).otherwise(F.lit(held[v])) for v in values})
        end = right.agg(F.max_by(F.struct(*values), F.struct(*order_by)).alias("x")).where("x is not null").select("x.*")
        schema = batch.select(*values).schema
        return out.drop("_said"), _row(batch.sparkSession, end.first(), held, schema)

    return step


def accepted(arrival: list[str], pane: int, lag: int, discard_age: int) -> Step:
    """As the batch operator of that name: watermark, pane and late of each row, by the greatest us that has come before it in
    the whole stream; rows go that come discard_age after their pane's end."""
    from ..operators import analytics

    def step(batch: DataFrame, before: DataFrame | None):
        held = _one(before)
        greatest = batch.agg(F.max("us").alias("most")).first()["most"]
        most = [x for x in (greatest, held["most"] if held else None) if x is not None]
        rows = analytics.accepted(batch, arrival, pane, lag, discard_age, held["most"] if held else None)
        return rows, batch.sparkSession.createDataFrame([(max(most),)] if most else [], "most long")

    return step


def late_panes(arrival: list[str], pane: int, lag: int, discard_age: int, value: str, keys: list[str] | None = None) -> Step:
    """A row for each firing of a pane (of each key): keys, pane, index, n and total (of a whole-numbered value).

    A pane fires first (index 0) when the greatest time seen, less lag, reaches its end; then anew, with all that it holds,
    for each row that comes later, until discard_age after its end. A pane whose first row comes late has no firing 0.
    Carried: the greatest time, and the panes that may still take rows."""
    keys = keys or []
    marks = accepted(arrival, pane, lag, discard_age)
    by = [*keys, "pane"]

    def step(batch: DataFrame, before: DataFrame | None):
        open_ = None if before is None else before.where("pane is not null").select(*by, "n", "total", "index", "fired")
        rows, most = marks(batch, before.where("pane is null").select("most") if before is not None else None)
        top = most.first()
        now = top["most"] - lag if top else None
        rows = rows.select(*by, *(c for c in arrival if c not in by), F.coalesce(F.col(value), F.lit(0)).cast("long").alias("_v"), "late")
        ahead = rows.where("not late").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"))
        ahead = ahead.withColumns({"index": F.lit(0).cast("long"), "fired": F.lit(False)})
        if open_ is not None:
            ahead = ahead.unionByName(open_)
        state = ahead.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("index").alias("index"), F.max("fired").alias("fired"))
        over = F.lit(now) >= F.col("pane") + pane if now is not None else F.lit(False)
        first = state.where(over & ~F.col("fired") & (F.col("n") > 0)).select(*by, F.lit(0).cast("long").alias("index"), "n", "total")
        w = Window.partitionBy(*by).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
        late = rows.where("late").withColumns({"_i": F.count(F.lit(1)).over(w), "_s": F.sum("_v").over(w)})
        held = state.select(*(F.col(c).alias(f"_{c}") for c in by), "n", "total", "index")
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        again = late.join(held, on, "left").select(*by, (F.coalesce("index", F.lit(0)) + F.col("_i")).alias("index"), (F.coalesce("n", F.lit(0)) + F.col("_i")).alias("n"), (F.coalesce("total", F.lit(0)) + F.col("_s")).alias("total"))
        added = rows.where("late").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total")).select(*by, "n", "total", F.col("n").alias("index"))
        whole = state.select(*by, "n", "total", "index", (F.col("fired") | over).alias("fired")).unionByName(added.withColumn("fired", F.lit(True)))
        whole = whole.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "total", "index")), F.max("fired").alias("fired"))
        if now is not None:
            whole = whole.where(F.col("pane") + pane + discard_age > F.lit(now))
        return first.unionByName(again), whole.withColumn("most", F.lit(None).cast("long")).unionByName(most, allowMissingColumns=True)

    return step
