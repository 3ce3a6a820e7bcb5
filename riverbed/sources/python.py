"""Live sources that a user's function makes, and sinks that a user's functions take, each row and each marker once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .tables import live_counter


def called_with(ticks: DataFrame, function: Callable[[int], tuple | list | None], output: str) -> DataFrame:
    """n and the fields of output: what the user's function makes of each n of ticks, live or not. A tuple is a row, a list holds
    several, None is none; an exception of the function ends the query."""
    names = ["n", *(f.name for f in StructType.fromDDL(output))]

    def make(batches):
        for b in batches:
            out = []
            for n in b["n"].tolist():
                made = function(n)
                out += [(n, *row) for row in (made if isinstance(made, list) else [made] if made is not None else [])]
            yield pd.DataFrame(out, columns=names, dtype=object if not out else None)

    return ticks.select("n").mapInPandas(make, f"n long, {output}")


def live_calls(spark: SparkSession, function: Callable[[int], tuple | list | None], output: str, rows_per_batch: int) -> DataFrame:
    """An endless source: the user's function is called with 0, 1, 2, ..., rows_per_batch numbers in a micro-batch, in tasks. The
    place is the stream's own offset, so a restart goes on with the next number, and a batch that is tried again calls the
    function with the numbers it had; the function makes the same of the same number, then rows come once."""
    return called_with(live_counter(spark, rows_per_batch), function, output)


class Staged(WriterCommitMessage):
    """What names the rows that a task has put somewhere, unseen yet."""

    def __init__(self, value: Any):
        self.value = value


def sink(called: str, stage: Callable[[Iterator[pa.RecordBatch]], Any], publish: Callable[[list, int], None], discard: Callable[[list, int], None] | None = None) -> type[DataSource]:
    """A live sink of the user's functions, to be registered. stage runs in each task: it puts rows where nobody sees them and
    returns what names them (None: nothing). publish gets those of a micro-batch's successful tasks and the batch's number, in
    one place; Spark may call it again under the same number after a stop, and what counts is the first call that
    ended. discard gets the names of a batch that failed, which publish may have seen
    before it did. What a lost task has staged is never published."""

    class Writer(DataSourceStreamArrowWriter):
        def write(self, iterator):
            return Staged(stage(iterator))

        def commit(self, messages, batchId):
            publish([m.value for m in messages if m is not None and m.value is not None], batchId)

        def abort(self, messages, batchId):
            if discard:
                discard([m.value for m in messages if m is not None and m.value is not None], batchId)

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def streamWriter(self, schema, overwrite):
            return Writer()

    return Sink


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and its path there."""
    plain = folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(plain)


def staged_files(folder: str) -> tuple[Callable, Callable, Callable]:
    """stage, publish and discard for sink(): Parquet files below parts of a shared folder, and for each micro-batch a list of
    those that count, below batches. A list is written under another name and then moved, and one that stands stays."""

    def stage(batches):
        system, base = _at(folder)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        try:
            for b in batches:
                if b.num_rows and writer is None:
                    system.create_dir(f"{base}/parts", recursive=True)
                    writer = parquet.ParquetWriter(f"{base}/parts/{name}", b.schema, filesystem=system)
                if b.num_rows:
                    writer.write_batch(b)
        finally:
            if writer:
                writer.close()
        return name if writer else None

    def discard(names, number):
        """Deletes what isn't listed: a list may stand though its batch failed afterwards."""
        system, base = _at(folder)
        there, listed = f"{base}/batches/{number:012d}.txt", set()
        if system.get_file_info(there).type != fs.FileType.NotFound:
            with system.open_input_stream(there) as f:
                listed = set(f.read().decode().split())
        for n in names:
            if n not in listed:
                system.delete_file(f"{base}/parts/{n}")

    def publish(names, number):
        system, base = _at(folder)
        system.create_dir(f"{base}/batches", recursive=True)
        there = f"{base}/batches/{number:012d}.txt"
        if system.get_file_info(there).type != fs.FileType.NotFound:
            discard(names, number)
            return
        unseen = f"{base}/{number:012d}-{uuid.uuid4().hex}"
        with system.open_output_stream(unseen) as out:
            out.write("".join(f"{n}\n" for n in names).encode())
        system.move(unseen, there)

    return stage, publish, discard


def published(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of the micro-batches that stand in a folder of staged_files(), each with the number of its batch."""
    listed = spark.read.schema("file string").text(f"{folder}/batches").select("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("batch"))
    rows = spark.read.schema(schema).parquet(f"{folder}/parts").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(listed, "file").drop("file")
