"""Row filters on one column.

The value arrives as text, the way a user types it, and is turned into a
literal of the column's own type on the driver. Catalyst then sees a plain
``column <op> literal`` predicate, which reaches the Parquet/JDBC scan as a
pushed filter. A bad value fails here, before any job starts.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import col, field

# Accepted operator spellings (fixed values).
OPERATORS = {
    ">": "gt", "gt": "gt",
    "<": "lt", "lt": "lt",
    "==": "eq", "=": "eq", "eq": "eq",
    ">=": "gte", "gte": "gte",
    "<=": "lte", "lte": "lte",
    "!=": "ne", "ne": "ne",
}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_INT_RANGE = {T.ByteType: (-2**7, 2**7 - 1), T.ShortType: (-2**15, 2**15 - 1),
              T.IntegerType: (-2**31, 2**31 - 1), T.LongType: (-2**63, 2**63 - 1)}


def canonical_operator(operator: str) -> str:
    key = str(operator).strip().lower()
    if key not in OPERATORS:
        raise ValueError(f"Unknown operator: {operator!r}. Use one of {sorted(OPERATORS)}")
    return OPERATORS[key]


def _as_float(column: str, value: Any) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise ValueError(f"Value {value!r} is not a number; column {column!r} is numeric") from None


def typed_literal(dtype: T.DataType, column: str, value: Any) -> Column:
    """A literal of ``dtype`` for ``value`` (validated on the driver)."""
    if isinstance(dtype, T.BooleanType):
        text = str(value).strip().lower()
        if text in ("1", "1.0", "true", "t"):
            return F.lit(True)
        if text in ("0", "0.0", "false", "f"):
            return F.lit(False)
        raise ValueError(f"Value {value!r} is not a boolean; column {column!r} is boolean")
    if isinstance(dtype, _INTEGRAL):
        text = str(value).strip()
        try:
            exact = int(text)                      # exact, even beyond 2**53
        except ValueError:
            number = _as_float(column, value)
            exact = int(number) if number.is_integer() and math.isfinite(number) else None
        low, high = _INT_RANGE[type(dtype)]
        if exact is not None and low <= exact <= high:
            return F.lit(exact).cast(dtype)
        # Fractional or out of the type's range: compared as a double; Catalyst
        # unwraps the cast (or folds it to a constant), so the column side stays bare.
        return F.lit(float(exact) if exact is not None else _as_float(column, value))
    if isinstance(dtype, T.DecimalType):
        _as_float(column, value)
        return F.lit(decimal.Decimal(str(value).strip()))
    if isinstance(dtype, _NUMERIC):
        return F.lit(_as_float(column, value))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, (_dt.datetime, _dt.date)):
            text = value.isoformat()
        else:
            text = str(value).strip()
            try:
                _dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
            except ValueError:
                raise ValueError(f"Value {value!r} is not an ISO date/time; column {column!r} is {dtype.simpleString()}") from None
        # Folded into a typed literal at optimisation time.
        return F.lit(text).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    raise ValueError(f"Column {column!r} of type {dtype.simpleString()} cannot be filtered by value")


def _is_nan_value(value: Any) -> bool:
    try:
        return math.isnan(float(value))
    except (TypeError, ValueError):
        return False


def predicate(df: DataFrame, column: str, operator: str, value: Any) -> Column:
    """The boolean column for ``column <operator> value``.

    Missing values compare the way a pandas mask does: they never satisfy
    ``>``, ``<``, ``==``, ``>=``, ``<=`` and always satisfy ``!=``. For
    float/double columns NaN counts as missing (Spark would order it above
    every number); the value comparison stays a plain predicate, so it is
    still pushed into the scan, and the NaN guard is a separate conjunct.
    """
    op = canonical_operator(operator)
    f = field(df, column)
    c = col(column)
    floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
    if isinstance(f.dataType, _NUMERIC) and _is_nan_value(value):
        return F.lit(op == "ne")                      # nothing equals or orders against NaN
    lit = typed_literal(f.dataType, column, value)
    if op == "ne":
        # "!=" keeps rows whose value is null (and NaN), as a pandas mask does.
        return ~c.eqNullSafe(lit)
    cond = {"gt": c > lit, "lt": c < lit, "eq": c == lit, "gte": c >= lit, "lte": c <= lit}[op]
    return cond & ~F.isnan(c) if floating else cond


def filter_rows(df: DataFrame, column: str, operator: str, value: Any) -> DataFrame:
    """Keep rows where ``column <operator> value`` holds."""
    return df.filter(predicate(df, column, operator, value))
