"""Profiles and reports.

Everything that can share a scan does: the null report, the profile and the
means are single aggregates; duplicates need one hash aggregate on all
columns (map-side combined). Results are small tables, one row per column.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import col, field, require_columns
from ..small import small_table
from .cleaning import missing, without_nan
from .fingerprints import marked, repeats
from .quantiles import exact_quantiles, linear_ranks, read_sketch, sketched, values_at_ranks
from .types import has_map, is_numeric, is_temporal

QUARTILES = (0.25, 0.5, 0.75)


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``column``, ``null_count`` (all columns, one pass)."""
    fields = df.schema.fields
    if not fields:
        return small_table(_spark(df), [], "column string, null_count bigint")
    wide = df.agg(*[F.count_if(missing(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)])
    stack = F.expr("stack({n}, {pairs}) as (`column`, null_count)".format(
        n=len(fields),
        pairs=", ".join(f"{_sql_str(f.name)}, c{i}" for i, f in enumerate(fields))))
    return wide.select(stack)


def null_report(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, with their null count (A1). Empty when none."""
    return null_counts(df).where(F.col("null_count") > 0)


def _sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _groupable(df: DataFrame) -> None:
    bad = [f.name for f in df.schema.fields if has_map(f.dataType)]
    if bad:
        raise ValueError(f"Columns {bad} hold MAP values, which cannot be compared for duplicates")


def _row_keys(df: DataFrame) -> DataFrame:
    """The whole row as one struct column ``row``, NaN as null; names inside are positions."""
    return df.select(F.struct(*[without_nan(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]).alias("row"))


def _whole_row(df: DataFrame) -> list:
    return [without_nan(f.name, f.dataType) for f in df.schema.fields]


def duplicate_count(df: DataFrame, wide: bool = False) -> DataFrame:
    """Rows that repeat an earlier row (A3), as one row ``duplicate_rows``.

    ``groupBy(all columns)`` keeps null-holding rows (``count(DISTINCT ...)``
    would skip them) and combines repeats map-side before the shuffle.
    ``wide=True`` reads the data twice and moves only fingerprints and rows that
    may have a copy (``fingerprints``); the data must read the same both times.
    """
    _groupable(df)
    if wide and df.columns:
        df = df.where(marked(_whole_row(df), repeats(df, _whole_row(df))))
    groups = _row_keys(df).groupBy("row").agg(F.count(F.lit(1)).alias("k"))
    return groups.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def dataset_profile(df: DataFrame, wide: bool = False) -> DataFrame:
    """Rows, columns, null cells and duplicate rows in one row (A2).

    Derived from the duplicate aggregate: within one all-column group every
    column is either null or not, so null cells are ``sum(k * nulls_in_key)``.
    One shuffle, no second scan. ``wide=True`` is as for :func:`duplicate_count`:
    two scans, and a shuffle whose size does not depend on the width of rows.
    """
    _groupable(df)
    fields = df.schema.fields
    if not fields:
        raise ValueError("dataset has no columns")
    if wide:
        nulls = sum((v.isNull().cast("bigint") for v in _whole_row(df)), F.lit(0).cast("bigint"))
        found = repeats(df, _whole_row(df), null_cells=nulls)
        copies = duplicate_count(df.where(marked(_whole_row(df), found)))
        return copies.select(F.coalesce(found.select("rows").scalar(), F.lit(0)).cast("bigint").alias("rows"),
                             F.lit(len(fields)).cast("bigint").alias("columns"),
                             F.coalesce(found.select("null_cells").scalar(), F.lit(0)).cast("bigint").alias("null_cells"), "duplicate_rows")
    nulls_in_row = sum((F.col(f"row.c{i}").isNull().cast("bigint") for i in range(len(fields))), F.lit(0))
    groups = (_row_keys(df).groupBy("row").agg(F.count(F.lit(1)).alias("_k"))
              .select("_k", nulls_in_row.alias("_nulls")))
    return groups.agg(
        F.coalesce(F.sum("_k"), F.lit(0)).cast("bigint").alias("rows"),
        F.lit(len(fields)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(F.col("_k") * F.col("_nulls")), F.lit(0)).cast("bigint").alias("null_cells"),
        F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def row_count(df: DataFrame) -> DataFrame:
    """``count(*)`` as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def column_means(df: DataFrame) -> DataFrame:
    """Mean of every numeric column, one row (A8); NaN counts as missing."""
    fields = [f for f in df.schema.fields if is_numeric(f.dataType)]
    if not fields:
        return _spark(df).range(1).select()
    return df.agg(*[F.avg(without_nan(f.name, f.dataType).cast("double")).alias(f.name) for f in fields])


def schema_report(df: DataFrame) -> DataFrame:
    """Name and type per column (A4): ``position, column, spark_type, nullable``."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return small_table(_spark(df), rows, "position int, column string, spark_type string, nullable boolean")


def schema_text(df: DataFrame) -> str:
    """The schema report as ``name: type`` lines, ready to write as a text file."""
    return "\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)


def save_schema_text(df: DataFrame, path: str) -> str:
    """Write the ``name: type`` lines as one text file in folder ``path`` (A4).

    The content is the schema (one line per column), so a single task
    writing it is bounded by the column count, not the data.
    """
    lines = [(line,) for line in schema_text(df).split("\n")] if df.columns else []
    (small_table(_spark(df), lines, "value string").coalesce(1)
     .write.mode("overwrite").text(path))
    return path


# ----------------------------------------------------------------------------- describe

NUMERIC_SCHEMA = ("column string, count bigint, mean double, std double, min double, "
                  "p25 double, p50 double, p75 double, max double")
TEXT_SCHEMA = "column string, count bigint, unique bigint, top string, freq bigint"
TIMESTAMP_SCHEMA = ("column string, count bigint, mean timestamp_ntz, min timestamp_ntz, "
                    "p25 timestamp_ntz, p50 timestamp_ntz, p75 timestamp_ntz, max timestamp_ntz")


def describe_numeric(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """count, mean, std (n-1), min, quartiles, max per numeric column (A5).

    One aggregate pass for the moments and a sketch, one more that makes the quartiles exact (``quantiles.py``)
    for all columns together; with ``exact=False`` they are ``percentile_approx`` and the second pass is saved.
    """
    require_columns(df, columns)
    for c in columns:
        if not is_numeric(field(df, c).dataType):
            raise ValueError(f"Column {c!r} is not numeric")
    values = {c: without_nan(c, field(df, c).dataType).cast("double") for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        v = values[c]
        aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}")]
        if exact:
            aggs += sketched(v, str(i), QUARTILES)
        else:
            aggs += [F.count(v).alias(f"n_{i}"), F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}"),
                     F.percentile_approx(v, list(QUARTILES), 10000).alias(f"q_{i}")]
    if not columns:
        return small_table(_spark(df), [], NUMERIC_SCHEMA)
    stats = df.agg(*aggs).first()
    counts = [stats[f"n_{i}"] for i in range(len(columns))]
    if exact:
        quantiles = exact_quantiles(df, [values[c] for c in columns], counts, QUARTILES,
                                    [read_sketch(stats, str(i)) for i in range(len(columns))])
    rows = []
    for i, c in enumerate(columns):
        if exact:
            qs = [quantiles[i][p] for p in QUARTILES]
        else:
            qs = list(stats[f"q_{i}"] or [None, None, None])
        rows.append((c, counts[i], stats[f"mean{i}"], stats[f"std{i}"], stats[f"lo_{i}"], *qs, stats[f"hi_{i}"]))
    return small_table(_spark(df), rows, NUMERIC_SCHEMA)


def describe_text(df: DataFrame, columns: Sequence[str], wide: bool = False) -> DataFrame:
    """count, unique, top, freq per column (A6); values compared as text.

    ``top`` is the most frequent value, ties broken by the smallest value.
    All columns are stacked into one ``(column, value)`` table, so one job
    serves them all: a map-side combined frequency table, then count,
    unique and the top pick per column (``min_by`` on ``(-freq, value)``).

    ``wide=True`` is for long, mostly different texts: a first pass finds by
    fingerprints which values may repeat, only these enter the frequency table,
    and the others count one each. The data must read the same both times.
    """
    require_columns(df, columns)
    if not columns:
        return small_table(_spark(df), [], TEXT_SCHEMA)
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("cid"), col(c).cast("string").alias("v"))
                                           for i, c in enumerate(columns)])))
    stacked = stacked.where(F.col("v").isNotNull())
    singles = {}
    if wide:
        key = [F.col("cid"), F.col("v")]
        may_repeat = marked(key, repeats(stacked, key))
        alone = stacked.where(~may_repeat).groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
        singles = {r["cid"]: (r["n"], r["least"]) for r in alone.collect()}        # one row per column
        stacked = stacked.where(may_repeat)
    freq = stacked.groupBy("cid", "v").agg(F.count(F.lit(1)).alias("k"))
    got = {r["cid"]: r for r in freq.groupBy("cid").agg(
        F.sum("k").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct((-F.col("k")).alias("nk"), F.col("v"))).alias("top"),
        F.max("k").alias("freq")).collect()}          # one row per column
    rows = []
    for i, c in enumerate(columns):
        r, (n, least) = got.get(i), singles.get(i, (0, None))
        tops = [(-r["freq"], r["top"])] if r else []
        freq, top = min(tops + [(-1, least)] * (n > 0), default=(None, None), key=lambda x: (x[0], x[1].encode()))
        rows.append((c, n + (r["count"] if r else 0), n + (r["unique"] if r else 0), top, -freq if freq else None))
    return small_table(_spark(df), rows, TEXT_SCHEMA)


def _from_micros(m: int | None) -> _dt.datetime | None:
    if m is None:
        return None
    return _dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=int(m))


def epoch_micros(name: str, dtype: T.DataType):
    """Microseconds since 1970-01-01 00:00 without any session time zone:
    wall-clock types (``timestamp_ntz``, ``date``) are measured as wall
    clock, ``timestamp`` as the instant (shown back in UTC)."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            col(name).cast("timestamp_ntz"))


def describe_timestamp(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, min, quartiles, max per date/timestamp column.

    Works on epoch microseconds (``avg``/``percentile`` refuse timestamps).
    The mean is exact: a decimal sum divided by the count, floored to the
    microsecond. Interpolated quartiles are floored to the microsecond too.
    """
    require_columns(df, columns)
    for c in columns:
        if not is_temporal(field(df, c).dataType):
            raise ValueError(f"Column {c!r} is not a date or timestamp")
    micros = {c: epoch_micros(c, field(df, c).dataType) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        m = micros[c]
        aggs += [F.sum(m.cast("decimal(38,0)")).alias(f"s{i}"), *sketched(m, str(i), QUARTILES)]
    if not columns:
        return small_table(_spark(df), [], TIMESTAMP_SCHEMA)
    stats = df.agg(*aggs).first()
    sketches = [read_sketch(stats, str(i)) for i in range(len(columns))]
    counts = [s.count for s in sketches]
    plans = [linear_ranks(n, QUARTILES) if n else {} for n in counts]
    got = values_at_ranks(df, [micros[c] for c in columns],
                          [[r for lo, hi, _ in pl.values() for r in (lo, hi)] for pl in plans], sketches)
    rows = []
    for i, c in enumerate(columns):
        n = counts[i]
        mean = int(stats[f"s{i}"]) // n if n else None
        qs: list = [None] * len(QUARTILES)
        if n:
            qs = []
            for p in QUARTILES:
                lo, hi, frac = plans[i][p]
                a, b = got[i][lo], got[i][hi]
                qs.append(a if a == b or frac == 0 else a + math.floor((b - a) * frac))
        rows.append((c, n, _from_micros(mean), _from_micros(sketches[i].least),
                     *[_from_micros(q) for q in qs], _from_micros(sketches[i].most)))
    return small_table(_spark(df), rows, TIMESTAMP_SCHEMA)


def compare_columns(df: DataFrame, col1: str, col2: str) -> DataFrame:
    """Describe two columns the way pandas ``describe`` picks a form:
    numeric columns win (others dropped); else timestamps; else text."""
    require_columns(df, [col1, col2])
    pair = [col1, col2] if col1 != col2 else [col1]
    kinds = {c: field(df, c).dataType for c in pair}
    numeric = [c for c in pair if is_numeric(kinds[c])]
    if numeric:
        return describe_numeric(df, numeric)
    temporal = [c for c in pair if is_temporal(kinds[c])]
    if temporal:
        return describe_timestamp(df, temporal)
    return describe_text(df, pair)


def describe_columns(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every requested column described in its own form, grouped by form."""
    columns = list(columns) if columns is not None else df.columns
    require_columns(df, columns)
    groups: dict[str, list[str]] = {"numeric": [], "timestamp": [], "text": []}
    for c in columns:
        t = field(df, c).dataType
        groups["numeric" if is_numeric(t) else "timestamp" if is_temporal(t) else "text"].append(c)
    out = {}
    if groups["numeric"]:
        out["numeric"] = describe_numeric(df, groups["numeric"])
    if groups["timestamp"]:
        out["timestamp"] = describe_timestamp(df, groups["timestamp"])
    if groups["text"]:
        out["text"] = describe_text(df, groups["text"])
    return out
