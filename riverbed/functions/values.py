"""Row and value conversions: strings, JSON, collections, times, CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Attributes that are null stay, as null.
KEEP_NULLS = {"ignoreNullFields": "false"}


def as_json(df: DataFrame, name: str = "jsonString") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), KEEP_NULLS).alias(name))


def payload_json(c: Column) -> Column:
    """A value that isn't an object, as {"payload": value}."""
    return F.to_json(F.struct(c.alias("payload")), KEEP_NULLS)


def _trimmed(c: Column) -> Column:
    """Without JSON's white space around it."""
    return F.trim(c, F.lit(" \t\n\r"))


def json_object(c: Column, strict: bool = False) -> Column:
    """JSON text as an object's text: arrays and scalars are wrapped. What isn't JSON is an error if strict, else null."""
    ok = (F.parse_json(c) if strict else F.try_parse_json(c)).isNotNull()
    return F.when(ok & _trimmed(c).startswith("{"), _trimmed(c)).when(ok, F.concat(F.lit('{"payload":'), _trimmed(c), F.lit("}")))


def _path(key: str) -> str:
    """The path of a key, whatever letters it has."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return f"$['{quoted}']"


def _text(value: Column, raw: Column) -> Column:
    """JSON text of a value: as it stands (raw), but for strings, which are quoted, and null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.to_json(value)).otherwise(F.coalesce(raw, F.lit("null")))


def flatten_array(df: DataFrame, column: str, key: str, *extra: str, name: str = "jsonString") -> DataFrame:
    """A row for each element of the array at key: objects as they stand, keys in their own order, others as payload. Extra keys
    are copied from the parent, after the element's own, where it has them and the element hasn't. No array, or an empty
    one: no rows. A key may hold any letters."""
    parent = F.try_parse_json(F.col(column))
    fields = T.StructType([T.StructField(key, T.ArrayType(T.StringType()))])
    extras = {k: F.try_variant_get(parent, _path(k), "variant") for k in extra}
    raw = T.StructType([T.StructField(k, T.StringType()) for k in extra])
    both = F.arrays_zip(F.try_variant_get(parent, _path(key), "array<variant>").alias("v"), F.from_json(F.col(column), fields).getField(key).alias("t"))
    rows = df.select(F.explode(both).alias("_e"), *(x.alias(f"_x{i}") for i, x in enumerate(extras.values())), *([F.from_json(F.col(column), raw).alias("_raw")] if extra else []))
    value = F.col("_e.v")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    own = F.when(is_object, F.regexp_replace(_trimmed(F.col("_e.t")), r"\s*\}\z", "")).otherwise(F.concat(F.lit('{"payload":'), _text(value, F.col("_e.t"))))
    held = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    more = []
    for i, k in enumerate(extra):
        missing = F.when(is_object, ~F.array_contains(held, k)).otherwise(F.lit(k != "payload"))
        more.append(F.when(F.col(f"_x{i}").isNotNull() & missing, F.concat(F.to_json(F.lit(k).cast("variant")), F.lit(":"), _text(F.col(f"_x{i}"), F.col("_raw").getField(k)))))
    empty = own == "{"
    # concat_ws leaves out what isn't there
    return rows.select(F.concat(F.when(empty, F.concat(own, F.concat_ws(",", *more))).otherwise(F.concat_ws(",", own, *more)), F.lit("}")).alias(name))


def _literal(c: Column, kind: T.DataType) -> Column:
    """A value as it stands in a tuple's text: strings quoted; lists [a,b], maps {k:v} and tuples {a=1} of such values."""
    if isinstance(kind, T.StringType):
        text = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _literal(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda x: F.concat(_literal(x["key"], kind.keyType), F.lit(":"), _literal(x["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        text = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f"{f.name}="), _literal(c.getField(f.name), f.dataType)) for f in kind)), F.lit("}")))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def tuple_string(df: DataFrame) -> Column:
    """{a=1,b="x"}: attributes in order, strings quoted, with backslashes before quotes and backslashes; null without quotes.
    Lists, maps and tuples inside hold values of the same form."""
    parts = [F.concat(F.lit(f"{f.name}="), _literal(df[f.name], f.dataType)) for f in df.schema]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def timestamp_of(c: Column, resolution: str = "Milliseconds") -> Column:
    if resolution == "Nanoseconds":
        return F.timestamp_micros(F.floor(c / 1000).cast("long"))
    return {"Milliseconds": F.timestamp_millis, "Microseconds": F.timestamp_micros}[resolution](c.cast("long"))
