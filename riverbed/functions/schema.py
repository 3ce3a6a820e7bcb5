"""Schemas: from tuple strings and typing.NamedTuple, joined, and applied to a frame."""

from __future__ import annotations

import datetime
import decimal
import re
import typing

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of primitive types, as in tuple strings; unsigned ones get the next wider signed type.
PRIMITIVES = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(),
    "decimal32": T.DecimalType(38, 10), "decimal64": T.DecimalType(38, 10), "decimal128": T.DecimalType(38, 10),
    "complex32": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "complex64": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "rstring": T.StringType(), "ustring": T.StringType(), "timestamp": T.TimestampType(), "blob": T.BinaryType(), "xml": T.StringType(), "enum": T.StringType(),
}
_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|\d+|[<>,\[\]])")


def parse_schema(text: str) -> T.StructType:
    """tuple<type name, ...> as a StructType; fields are nullable only if optional<...>. ValueError on bad input."""
    tokens, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise ValueError(f"unexpected text at {at} in {text!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def expect(*wanted: str) -> str:
        if not tokens or tokens[-1] not in wanted:
            raise ValueError(f"expected {' or '.join(wanted)} in {text!r}, found {tokens[-1] if tokens else 'its end'}")
        return tokens.pop()

    def bound() -> None:
        if tokens and tokens[-1] == "[":
            tokens.pop()
            if not tokens or not tokens.pop().isdigit():
                raise ValueError(f"a bound is a number in {text!r}")
            expect("]")

    def kind() -> tuple[T.DataType, bool]:
        name = tokens.pop() if tokens else ""
        if name == "tuple":
            expect("<")
            fields = []
            while True:
                dtype, optional = kind()
                field = tokens.pop() if tokens else ""
                if not re.fullmatch(r"[A-Za-z_]\w*", field) or field in [f.name for f in fields]:
                    raise ValueError(f"a new attribute name is missing in {text!r}")
                fields.append(T.StructField(field, dtype, optional))
                if expect(",", ">") == ">":
                    return T.StructType(fields), False
        if name in ("list", "set", "optional"):
            expect("<")
            dtype, optional = kind()
            expect(">")
            if name == "optional":
                return dtype, True
            bound()
            return T.ArrayType(dtype, optional), False
        if name == "map":
            expect("<")
            key, _ = kind()
            expect(",")
            value, optional = kind()
            expect(">")
            bound()
            return T.MapType(key, value, optional), False
        if name not in PRIMITIVES:
            raise ValueError(f"unknown type {name!r} in {text!r}")
        if name == "rstring":
            bound()
        return PRIMITIVES[name], False

    if not tokens or tokens[-1] != "tuple":
        raise ValueError(f"not a tuple: {text!r}")
    out = kind()[0]
    if tokens:
        raise ValueError(f"text after the tuple in {text!r}")
    return out


def schema_of(named_tuple: type) -> T.StructType:
    """The schema of a typing.NamedTuple's annotations."""
    simple = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 10)}

    def kind(hint) -> tuple[T.DataType, bool]:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if hint in simple:
            return simple[hint], False
        if type(None) in args and len(args) == 2:
            return kind(next(a for a in args if a is not type(None)))[0], True
        if origin in (list, set):
            return T.ArrayType(*kind(args[0])), False
        if origin is dict:
            return T.MapType(kind(args[0])[0], *kind(args[1])), False
        if isinstance(hint, type) and hasattr(hint, "_fields"):
            return schema_of(hint), False
        raise TypeError(f"no type for {hint!r}")

    return T.StructType([T.StructField(n, *kind(h)) for n, h in typing.get_type_hints(named_tuple).items()])


def extend(a: T.StructType, b: T.StructType) -> T.StructType:
    return T.StructType(a.fields + b.fields)


def default_of(dtype: T.DataType) -> Column:
    """What a missing value of a type that isn't optional becomes."""
    if isinstance(dtype, T.StructType):
        return F.struct(*(default_of(f.dataType).alias(f.name) for f in dtype))
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, T.MapType):
        return F.create_map().cast(dtype)
    values = {"string": "", "boolean": False, "timestamp": 0, "binary": b""}
    return F.lit(values.get(dtype.typeName(), 0)).cast(dtype) if dtype.typeName() != "timestamp" else F.timestamp_seconds(F.lit(0))


def conform(df: DataFrame, schema: T.StructType, by: str = "name") -> DataFrame:
    """df with schema's columns, by name or by position; missing or null values become the type's default unless optional."""
    out = []
    for i, f in enumerate(schema):
        source = (df.columns[i] if i < len(df.columns) else None) if by == "position" else (f.name if f.name in df.columns else None)
        c = F.col(f"`{source}`").try_cast(f.dataType) if source else F.lit(None).cast(f.dataType)
        out.append((c if f.nullable else F.coalesce(c, default_of(f.dataType))).alias(f.name))
    return df.select(*out)
