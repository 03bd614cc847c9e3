"""Null and duplicate handling.

Missing means null, and for float/double columns NaN as well (a pandas user
cannot tell them apart).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import col, require_columns
from .fingerprints import marked, repeats
from .types import has_map, is_floating, is_numeric

FILL_TEXT = "Unknown"


def missing(name: str, dtype: T.DataType) -> Column:
    """True where the value is null (or NaN for float/double)."""
    c = col(name)
    if is_floating(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def without_nan(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into null (no-op for other types)."""
    c = col(name)
    if is_floating(dtype):
        return F.when(~F.isnan(c), c)
    return c


def drop_nulls(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value (C1); ``na.drop`` also treats NaN as missing."""
    if subset is not None:
        require_columns(df, subset)
    return df.na.drop(how=how, subset=list(subset) if subset is not None else None)


@dataclass
class FillReport:
    """What ``fill_nulls`` did per column."""
    means: dict[str, float | None] = dc_field(default_factory=dict)
    widened: list[str] = dc_field(default_factory=list)       # integral -> double
    text_filled: list[str] = dc_field(default_factory=list)
    left_null: list[str] = dc_field(default_factory=list)     # no mean / no text form
    stringified: list[str] = dc_field(default_factory=list)


def fill_nulls_with_report(df: DataFrame, text_value: str = FILL_TEXT,
                           stringify: bool = False) -> tuple[DataFrame, FillReport]:
    """Fill missing numbers with the column mean, missing text with ``text_value``.

    One aggregate pass computes every numeric mean and every null count; it
    is a partial (map-side) aggregate, so only one row per task crosses the
    shuffle. The fill itself is a single projection over the input.

    Integral columns that hold nulls become double first (the mean is
    fractional, as in pandas); decimals keep their type and get the mean
    rounded to it. Columns with no mean and no text form (all-null
    numerics, dates, timestamps, booleans, nested values) stay null and are
    listed in the report, unless ``stringify`` casts them to string and fills
    ``text_value``.
    """
    fields = df.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        aggs.append(F.count_if(missing(f.name, f.dataType)).alias(f"n{i}"))
        if is_numeric(f.dataType):
            own = without_nan(f.name, f.dataType)
            aggs.append(F.avg(own if isinstance(f.dataType, T.DecimalType) else own.cast("double")).alias(f"m{i}"))
    stats = df.agg(*aggs).first().asDict() if aggs else {}

    report = FillReport()
    out = []
    for i, f in enumerate(fields):
        c = col(f.name)
        nulls = stats.get(f"n{i}", 0) or 0
        if nulls == 0:
            out.append(c)
            continue
        if is_numeric(f.dataType):
            mean = stats.get(f"m{i}")
            report.means[f.name] = mean
            if mean is not None and isinstance(f.dataType, T.DecimalType):
                out.append(F.coalesce(c, F.lit(mean).cast(f.dataType)).alias(f.name))
                continue
            if mean is not None:
                if not is_floating(f.dataType):
                    report.widened.append(f.name)
                out.append(F.coalesce(without_nan(f.name, f.dataType).cast("double"),
                                      F.lit(float(mean))).alias(f.name))
                continue
        elif isinstance(f.dataType, T.StringType):
            report.text_filled.append(f.name)
            out.append(F.coalesce(c, F.lit(text_value)).alias(f.name))
            continue
        if stringify and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            report.stringified.append(f.name)
            out.append(F.coalesce(without_nan(f.name, f.dataType).cast("string"),
                                  F.lit(text_value)).alias(f.name))
        elif stringify:
            report.stringified.append(f.name)
            out.append(F.coalesce(F.to_json(c), F.lit(text_value)).alias(f.name))
        else:
            report.left_null.append(f.name)
            out.append(c)
    return df.select(*out), report


def fill_nulls(df: DataFrame, text_value: str = FILL_TEXT, stringify: bool = False) -> DataFrame:
    """``fill_nulls_with_report`` without the report."""
    return fill_nulls_with_report(df, text_value, stringify)[0]


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, wide: bool = False) -> DataFrame:
    """Drop repeated rows (C3); nulls compare equal, NaN is null. Output order is not kept.

    A hash aggregate on all columns with a map-side partial step: a row
    repeated a billion times leaves each task as one row, so a hot duplicate
    cannot pile up in one reducer.

    ``wide=True`` first finds by fingerprints which rows may have a copy
    (``fingerprints``): only these are shuffled, the others stay in their tasks.
    The data are read three times then and must read the same each time.
    """
    if subset is not None:
        require_columns(df, subset)
    bad = [f.name for f in df.schema.fields
           if (subset is None or f.name in subset) and has_map(f.dataType)]
    if bad:
        raise ValueError(f"Columns {bad} hold MAP values, which cannot be compared for duplicates")
    df = df.select(*[without_nan(f.name, f.dataType).alias(f.name) for f in df.schema.fields])
    if wide and df.columns:
        keys = [col(c) for c in (df.columns if subset is None else subset)]
        may_repeat = marked(keys, repeats(df, keys))
        return df.where(~may_repeat).unionAll(drop_duplicates(df.where(may_repeat), subset))
    return df.dropDuplicates(list(subset)) if subset is not None else df.dropDuplicates()


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row counter (C4). The count is filled in by whatever action
    runs on the returned DataFrame; no extra job is started."""
    obs = Observation(f"{name}_{uuid.uuid4().hex[:8]}")
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


class RowChange:
    """Rows before and after a transform (C4).

    ``after`` is counted by the first action that reads ``output`` in full. ``before`` counts the
    input on its own when asked for (for a Parquet source that reads footers only): a counter inside
    the plan would stop filters from reaching the scan, and would miss the rows that a limit skips.
    """

    def __init__(self, df: DataFrame, transform):
        self._input = df
        self._before: int | None = None
        self._after_obs = Observation(f"rows_after_{uuid.uuid4().hex[:8]}")     # several may sit in one plan
        self.output = transform(df).observe(self._after_obs, F.count(F.lit(1)).alias("rows"))

    @property
    def before(self) -> int:
        if self._before is None:
            self._before = self._input.count()
        return self._before

    @property
    def after(self) -> int:
        return self._after_obs.get["rows"]

    def message(self, label: str = "Rows") -> str:
        return f"{label}: {self.before} -> {self.after}"
