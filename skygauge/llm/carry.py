"""Columns of any type and name through places that take few: as one text for each row, and as one hash.

Maps go as arrays of their entries, at any depth, fields by number; so keys of any type, dots and
equal names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Times with all their digits; fields that are null stay so.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _flat(x: Column, kind: T.DataType) -> Column:
    """x without maps and with numbered fields."""
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(x), lambda e: F.struct(_flat(e["key"], kind.keyType).alias("k"), _flat(e["value"], kind.valueType).alias("v")))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _flat(e, kind.elementType))
    if isinstance(kind, T.StructType) and kind:
        return F.when(x.isNotNull(), F.struct(*(_flat(x.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind))))
    return x.cast("string") if isinstance(kind, (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)) else x


def _flat_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("k", _flat_type(kind.keyType)), T.StructField("v", _flat_type(kind.valueType))]))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_flat_type(kind.elementType))
    if isinstance(kind, T.StructType) and kind:
        return T.StructType([T.StructField(f"f{i}", _flat_type(f.dataType)) for i, f in enumerate(kind)])
    return T.StringType() if isinstance(kind, (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)) else kind


def _whole(x: Column, kind: T.DataType) -> Column:
    """The reverse of _flat()."""
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(x, lambda e: F.struct(_whole(e["k"], kind.keyType).alias("key"), _whole(e["v"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _whole(e, kind.elementType))
    if isinstance(kind, T.StructType) and kind:
        return F.when(x.isNotNull(), F.struct(*(_whole(x.getField(f"f{i}"), f.dataType).alias(f.name) for i, f in enumerate(kind))))
    return x.cast(kind)


def _kinds(df: DataFrame, columns: list[str]) -> T.StructType:
    """The columns' types, under numbers for names."""
    return T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(columns)])


def packed(df: DataFrame, columns: list[str]) -> Column:
    """The columns of a row as JSON."""
    return F.to_json(F.struct(*(_flat(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(columns))), JSON)


def unpacked(text: str, df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """The columns again, each by its name."""
    kinds = _kinds(df, columns)
    held = F.from_json(F.col(text), T.StructType([T.StructField(f.name, _flat_type(f.dataType)) for f in kinds]), JSON)
    return {c: _whole(held[f"c{i}"], df.schema[c].dataType) for i, c in enumerate(columns)}


def row_hash(df: DataFrame, row: str) -> Column:
    """The hash of a struct column that holds all of df's columns, with the entries of maps in their own order."""
    return F.xxhash64(*(_flat(F.col(row)[f.name], f.dataType) for f in df.schema)) if df.columns else F.lit(0)
