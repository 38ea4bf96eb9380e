"""Schema questions answered from the plan alone: no job is run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .report import local_rows

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED) or "vector" in dtype.simpleString()


def fields(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return fields(df, is_numeric)


def text_columns(df: DataFrame) -> list[str]:
    return fields(df, is_text)


def temporal_columns(df: DataFrame) -> list[str]:
    return fields(df, is_temporal)


def flat_columns(df: DataFrame) -> list[str]:
    return fields(df, lambda d: not is_nested(d))


def physical_types(df: DataFrame) -> DataFrame:
    """``(column, physical_type, kind)`` straight from the schema."""

    def kind(d: T.DataType) -> str:
        if is_numeric(d):
            return "number"
        if is_text(d):
            return "string"
        if is_temporal(d):
            return "datetime"
        if isinstance(d, T.BooleanType):
            return "boolean"
        return "other"

    rows = [(f.name, f.dataType.simpleString(), kind(f.dataType)) for f in df.schema.fields]
    return local_rows(df, rows, "column string, physical_type string, kind string")
