"""Type classes used by the cleaning and profiling operators."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGRAL + FRACTIONAL
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return False
