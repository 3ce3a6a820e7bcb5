"""Tables on disk and what is derived from the event table: trades, quotes, topics, late arrivals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, as events_of gives it."""
    return events_of(table(spark, sf_dir, "events"))


def events_of(raw: DataFrame) -> DataFrame:
    """Events with ts as an instant (UTC), us (its microseconds), cents (value as whole hundredths) and k from props."""
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"), "props",
    )


#: The same columns in SQL.
EVENTS_SQL = "(SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events)"


def message_from_kafka(df: DataFrame) -> DataFrame:
    """Binary topic, key and value of Kafka's source as strings: topic (never null), key, message."""
    return df.select(F.coalesce(F.col("topic").cast("string"), F.lit("")).alias("topic"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("message"))


def message_to_kafka(df: DataFrame, topic: str | None = None) -> DataFrame:
    """What Kafka's sink writes; with no topic each row goes to its own."""
    return df.select(F.lit(topic).alias("topic") if topic else F.col("topic"), F.col("key").cast("binary").alias("key"), F.col("message").cast("binary").alias("value"))


def kafka_options(servers: str, topics: list[str], **options: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics)} | options


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, with each file's path and time of change."""
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))


def live_table(spark: SparkSession, path: str, files_per_batch: int | None = 64, schema: StructType | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream: each file is read once, at most files_per_batch in a micro-batch
    (None: all that are new), by their time of change, whatever times their rows have."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream takes no plain path of a file


def live_lines(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Lines of the text files that stand in a folder or come into it, each file once, in the order of change."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))


def live_counter(spark: SparkSession, rows_per_batch: int, copies: int = 1) -> DataFrame:
    """An endless counter: n from 0 on, rows_per_batch in a micro-batch, each in so many copies (numbered from 0)."""
    if rows_per_batch <= 0 or copies <= 0:
        raise ValueError("a period gives one row at least")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 1).load()
    return ticks.select("timestamp", F.col("value").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))


def live_period(spark: SparkSession, seconds: float, copies: int = 1) -> DataFrame:
    """An endless counter in real time: n from 0 on, one every so many seconds (a whole number of milliseconds, one at least),
    each in so many copies (numbered from 0); timestamp is when its turn came, at equal distances whatever a batch's delay."""
    period = Fraction(round(seconds * 1000), 1000)
    if period <= 0 or copies <= 0:
        raise ValueError("a period takes a millisecond at least and gives one row at least")
    # so many ticks a second, of which every so-many-th counts
    ticks = spark.readStream.format("rate").option("rowsPerSecond", period.denominator).option("numPartitions", 1).load()
    turns = ticks.where(F.col("value") % period.numerator == 0)
    n = F.expr(f"value div {period.numerator}")
    return turns.select("timestamp", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))


def has_suffix(name, *suffixes: str):
    found = F.lit(False)
    for s in suffixes:
        found = found | F.endswith(name, F.lit(f".{s}"))
    return found


def counter(spark: SparkSession, n: int, row: Column | None = None) -> DataFrame:
    """n from 0 to n - 1, with what row (an expression of n) makes of it as value; where that is null there is no row. A
    negative n is an error."""
    if n < 0:
        raise ValueError("a count can't be negative")
    numbers = spark.range(n).select(F.col("id").alias("n"))
    return numbers if row is None else numbers.select("n", row.alias("value")).where("value is not null")


def constants(spark: SparkSession, rows: list[tuple | None], schema: str) -> DataFrame:
    """Rows that are given, in their order as _i; None is left out."""
    kept = [(i, *r) for i, r in enumerate(r for r in rows if r is not None)]
    return spark.createDataFrame(kept, f"_i long, {schema}")


#: How a null stands in CSV files, so that it isn't an empty text.
NULL_MARK = "\\N"


def csv_table(spark: SparkSession, path: str, schema: StructType, null: str = NULL_MARK) -> DataFrame:
    """CSV files without a header, of a declared schema; .gz and .bz2 are read as what they are. A gzip file is one task."""
    return spark.read.schema(schema).csv(path, nullValue=null, emptyValue="")


def write_csv(df: DataFrame, path: str, compression: str = "none", null: str = NULL_MARK) -> None:
    df.write.csv(path, nullValue=null, compression=compression)


def generated(row: Callable[[int], int | None], called: str = "generated") -> type[DataSource]:
    """A source in Python, to be registered: rows (n, value) for n from 0 to the option rows - 1, where value is what the user's
    function makes of n (None: no row), in as many parts as the option parts says, each its own task. The classes are made
    here, so that workers get them whole and needn't have this library."""

    class Reader(DataSourceReader):
        def __init__(self, rows: int, parts: int):
            self.rows, self.parts = rows, parts

        def partitions(self) -> list[InputPartition]:
            bounds = [self.rows * i // self.parts for i in range(self.parts + 1)]
            return [InputPartition(x) for x in zip(bounds, bounds[1:], strict=False)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for n in range(*partition.value):
                if (value := row(n)) is not None:
                    yield n, value

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return "n long, value long"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(int(self.options["rows"]), int(self.options.get("parts", "8")))

    return Source


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on one machine only, where that is unset, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="riverbed-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
