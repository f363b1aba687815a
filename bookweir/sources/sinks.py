"""Results as JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweir.functions.times import epoch_micros


def _iso(ts: Column) -> Column:
    fraction = F.when(epoch_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def _plain(value: Column, kind: T.DataType) -> Column:
    """The value with times as ISO text and bytes as hex, at any depth."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _iso(value)
    if isinstance(kind, T.BinaryType):
        return F.when(F.octet_length(value) > 0, F.lower(F.hex(value)))
    if isinstance(kind, T.StructType):
        fields = [_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _plain(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _plain(item, kind.valueType))
    return value


def to_json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text per row; nulls are written, times are ISO in UTC, bytes are hex."""
    fields = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_json_rows(rows).write.mode(mode).text(path)
