"""Column operators: select (P1), add (T6), convert (T7), rename (T8), drop.

Each is a single ``Project`` in the logical plan; Catalyst folds chains of
them together and prunes the scan to the columns that survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import col, require_columns

# Type names a pandas user writes, mapped to Spark SQL types (fixed values).
TYPE_ALIASES = {
    "int": "bigint", "int64": "bigint", "Int64": "bigint", "long": "bigint",
    "int32": "int",
    "float": "double", "float64": "double", "double": "double",
    "float32": "float",
    "str": "string", "string": "string", "object": "string",
    "bool": "boolean",
    "datetime64[ns]": "timestamp", "datetime": "timestamp", "timestamp": "timestamp",
    "date": "date",
}


def spark_type_name(dtype: str) -> str:
    """Resolve a user type name; unknown names pass through as Spark SQL types."""
    name = str(dtype).strip()
    return TYPE_ALIASES.get(name, name)


def _check_new_name(df: DataFrame, new_name: str, replacing: str) -> None:
    """Refuse a name that would clash with another column. Spark resolves
    names case-insensitively, so ``A`` next to ``a`` would be ambiguous."""
    clash = [c for c in df.columns if c != replacing and c.lower() == new_name.lower()]
    if clash:
        what = "already exists" if clash[0] == new_name else f"would clash with {clash[0]!r}"
        raise ValueError(f"Column {new_name!r} {what}. Available: {df.columns}")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep exactly these columns, in this order."""
    require_columns(df, columns)
    return df.select(*[col(c) for c in columns])


def rename_column(df: DataFrame, old_name: str, new_name: str) -> DataFrame:
    """Rename one column (T8). Renaming onto another existing name is refused."""
    require_columns(df, [old_name])
    _check_new_name(df, new_name, replacing=old_name)
    return df.select(*[col(c).alias(new_name) if c == old_name else col(c) for c in df.columns])


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """Drop one column (T9); an unknown name is an error, not a no-op."""
    require_columns(df, [column])
    return df.select(*[col(c) for c in df.columns if c != column])


def add_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add or replace ``name`` with a Spark SQL scalar expression.

    Pandas-``eval`` habits that differ: use ``try_divide`` for division that
    may hit zero, ``floor(a / b)`` for floor division, ``pmod`` for a modulo
    that follows the divisor's sign.
    """
    value = F.expr(expression).alias(name)
    _check_new_name(df, name, replacing=name)
    if name in df.columns:
        return df.select(*[value if c == name else col(c) for c in df.columns])
    return df.select(*[col(c) for c in df.columns], value)


def strict_cast(c, target: str, label: str):
    """Cast that fails the job on a value that does not convert, whatever the
    session's ANSI setting: ``try_cast`` plus ``raise_error`` for non-null
    input that came out null. Lazy; no extra job."""
    converted = c.try_cast(target)
    return F.when(c.isNotNull() & converted.isNull(),
                  F.raise_error(F.concat(F.lit(f"Cannot convert {label} value '"), c.cast("string"),
                                         F.lit(f"' to {target}")))).otherwise(converted)


def convert_type(df: DataFrame, column: str, dtype: str, strict: bool = True) -> DataFrame:
    """Cast one column (T7). ``strict`` fails on values that do not convert;
    ``strict=False`` turns them into nulls (``try_cast``). Float to integer
    truncates toward zero; null stays null."""
    require_columns(df, [column])
    target = spark_type_name(dtype)
    c = col(column)
    converted = (strict_cast(c, target, repr(column)) if strict else c.try_cast(target)).alias(column)
    return df.select(*[converted if name == column else col(name) for name in df.columns])
