"""Small helpers shared by the corpus operators: hashing of words in numpy, cuts of lineage, reading of tables."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

U = np.uint64
#: Bytes of text that one vectorised step handles; its arrays take some 60 times as much.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine only, a new temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riverbed-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later stages don't depend on lost executors' shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riverbed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, mod: int):
    """crc32 of the decimal text of a column, modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix64(np.arange(1, 257, dtype=U) * U(BASE))
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(1 << bits, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of an odd number modulo 2**64 and of its inverse."""
    return _powers(max(21, int(n).bit_length()))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[0] = 0; (H[e] - H[s]) * inverse**s is a hash of values[s:e]."""
    h = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=h[1:])
    return h


def slice_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((h[ends] - h[starts]) * powers(len(h))[1][starts])


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def groups(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows of at most limit bytes together; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_groups(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """The texts of an Arrow batch as UTF-8 (null: empty), a few at a time: no second copy of the whole batch is held."""
    texts = batch.column(column)
    texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for g in groups(sizes, limit):
        yield g, [t or b"" for t in texts[g].cast(pa.large_binary()).to_pylist()]


def from_texts(df: DataFrame, text: str, out: str, kind: str, make: Callable[[], Callable[[list[bytes]], list | np.ndarray]]) -> DataFrame:
    """df with the column out (of the SQL type kind) made from the whole texts; it takes the place of one of that name, or
    comes last. make() is called once a task; what it returns gets a few texts at a time, as UTF-8 (null: empty)."""
    fields = [(f"`{f.name}`", f.dataType.simpleString()) for f in df.schema if f.name != out or out == text]
    if out == text:
        schema = ", ".join(f"{n} {t}" for n, t in fields)
    else:
        df = df.select(*(n for n, _ in fields))
        schema = ", ".join(f"{n} {t}" for n, t in [*fields, (f"`{out}`", kind)])
    to = to_arrow_type(T.StructType.fromDDL(f"x {kind}")[0].dataType)

    def run(batches):
        made = make()
        for b in batches:
            parts = []
            for _, data in text_groups(b, text):
                found = made(data)
                parts.append(pa.array(found, type=to))
            found = pa.concat_arrays(parts) if parts else pa.array([], type=to)
            if out == text:
                where = b.schema.get_field_index(text)
                found = pc.if_else(b.column(where).is_valid(), found.cast(b.schema.field(where).type), pa.scalar(None, b.schema.field(where).type))
                yield b.set_column(where, b.schema.field(where), found)
            else:
                yield b.append_column(out, found)
        del made
        release()

    return df.mapInArrow(run, schema)


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim; where it has none, nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """At a task's end: hand what Arrow and the C library keep of their freed memory back to the system, as later tasks
    reuse the worker."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _segments(data: bytes) -> Iterator[bytes]:
    """Cut a long text at white space into parts of about STEP_BYTES."""
    at = 0
    while len(data) - at > STEP_BYTES:
        window = np.frombuffer(data, np.uint8, STEP_BYTES, at)
        spaces = np.flatnonzero(~IS_WORD[window[-4096:]])
        if len(spaces):
            end = at + STEP_BYTES - len(window[-4096:]) + int(spaces[-1]) + 1
        else:
            rest = np.flatnonzero(~IS_WORD[np.frombuffer(data, np.uint8, offset=at + STEP_BYTES)])
            end = at + STEP_BYTES + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ([^\\x20\\x09-\\x0D]+, A-Z as a-z) of texts of STEP_BYTES together, or of one longer text.

    Returns the words' hashes, their first and last bytes (two columns), and the number of words of each text.
    """
    if len(texts) == 1 and len(texts[0]) > STEP_BYTES:
        parts = [words([x]) if len(x) <= STEP_BYTES else _words([x]) for x in _segments(texts[0])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([sum(len(p[0]) for p in parts)])
    return _words(texts)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(IS_WORD[data], prepend=False))
    starts, ends = edges[::2], edges[1::2]
    h = slice_hashes(prefix_hashes(LOWER_VALUES[data]), starts, ends)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.stack([data[starts], data[ends - 1]], 1), np.diff(np.searchsorted(starts, bounds))
