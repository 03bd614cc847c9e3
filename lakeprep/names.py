"""Column-name handling shared by every operator.

Names are compared exactly (case-sensitive), as a pandas user expects,
even though Spark's resolver is case-insensitive by default. Every name is
back-quoted before it reaches Spark, so ``adj close`` or ``adj.close`` work.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ColumnNotFound(ValueError):
    """Raised when a column is missing; the message lists what exists."""


def quote(name: str) -> str:
    """Back-quote one identifier (doubling embedded back-quotes)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """``F.col`` on a literal name, safe for spaces, dots and back-quotes."""
    return F.col(quote(name))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Fail early, listing the available columns, if any name is missing."""
    available = df.columns
    missing = [n for n in names if n not in available]
    if missing:
        shown = ", ".join(repr(m) for m in missing)
        raise ColumnNotFound(f"Column {shown} not found. Available: {available}")


def field(df: DataFrame, name: str):
    """The ``StructField`` of an existing column (exact-case lookup)."""
    require_columns(df, [name])
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise ColumnNotFound(name)  # pragma: no cover - require_columns caught it


def dedupe_names(names: list[str]) -> list[str]:
    """Make header names unique: a repeated ``a`` becomes ``a_1``, ``a_2``, ...
    Names are compared case-insensitively (Spark resolves ``A`` as ``a``),
    and an empty name becomes ``_c<position>``."""
    out: list[str] = []
    seen: set[str] = set()
    for pos, raw in enumerate(names):
        base = raw if raw else f"_c{pos}"
        candidate, k = base, 0
        while candidate.lower() in seen:
            k += 1
            candidate = f"{base}_{k}"
        seen.add(candidate.lower())
        out.append(candidate)
    return out
