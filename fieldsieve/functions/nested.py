"""Nested values of any schema as JSON and in an order-free normal form: one expression, made by a walk over the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"  # fixed value
PLAIN = (T.StringType, T.NumericType, T.BooleanType)


def compatible(c: Column, kind: T.DataType) -> Column:
    """A value of types that JSON has: bytes as {encoding, value}, times as ISO texts in UTC, other kinds as their text."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[compatible(c[f.name], f.dataType).alias(f.name) for f in kind.fields])) if kind.fields else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: compatible(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: k.cast("string")), lambda _, v: compatible(v, kind.valueType))
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.struct(F.lit("base64").alias("encoding"), F.base64(c).alias("value")))
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), ISO)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.date_format(c, ISO)
    return c if isinstance(kind, PLAIN) else c.cast("string")


def json_tree(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row of df (or some of its columns) as JSON text; what is null is there as null."""
    kind = T.StructType([df.schema[c] for c in columns or df.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in kind.names])
    return F.to_json(compatible(row, kind), {"ignoreNullFields": "false"})


def normal(c: Column, kind: T.DataType) -> Column:
    """A value whose arrays are sorted, in every level, and whose fields and keys go by name: equal for values that differ in order only."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[normal(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.transform(c, lambda e: normal(e, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), normal(e["value"], kind.valueType).alias("value"))))
    return compatible(c, kind)


def normal_digest(df: DataFrame, column: str) -> Column:
    """SHA-256 of a column's normal form as JSON."""
    return F.sha2(F.to_json(F.struct(normal(F.col(f"`{column}`"), df.schema[column].dataType).alias("v")), {"ignoreNullFields": "false"}), 256)
