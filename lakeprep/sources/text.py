"""Delimited text (S1, S1b, S9) and JSON (S2) readers.

CSV is read as text first, the null tokens a pandas user expects are turned
into nulls, and then the column types are inferred in **one** aggregate
pass: each value gets the bit set of candidate types its text fits, and per
column a ``bit_and`` keeps the types that every value fits. Patterns, not
bare casts, decide: Spark's cast would accept ``1d`` as a double, ``yes`` as
a boolean and ``2024`` as a date.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import col, dedupe_names
from .lake import normalize_nan

# Text that means "missing" when pandas reads a CSV (fixed values, public pandas docs).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Type patterns (Java regex, matched against the whole value).
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?(inf|Inf|INF|infinity|Infinity))$"
BOOL_PATTERN = r"^(True|TRUE|true|False|FALSE|false)$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?$"
ZONED_TIMESTAMP_PATTERN = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?"
                           r"(Z|[+-][0-9]{2}:?[0-9]{2})$")

# What a caller may ask for when a record cannot be read -> Spark's reader mode.
BAD_RECORDS = {"fail": "FAILFAST", "null": "PERMISSIVE"}

CSV_OPTIONS = {"quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}
# A ragged row is one even where the query needs only some of its cells.
STRICT_CSV = {"mode": "FAILFAST", "columnPruning": "false", "enforceSchema": "false"}


# Candidate types in order of preference, with the bit each one owns.
TYPE_BITS = (("bigint", 1), ("double", 2), ("boolean", 4), ("date", 8), ("timestamp_ntz", 16), ("timestamp", 32))


def _type_mask(c: Column, infer_dates: bool) -> Column:
    """Bit set of the candidate types one (non-null) value fits.

    One ``CASE`` per value, first match wins, so most values cost one or two
    pattern tests: an integer also fits double; every other form fits only
    its own type. Patterns decide the form, a ``try_cast`` confirms the
    value is in range (bigint overflow, 2024-02-30).
    """
    mask = (F.when(c.rlike(INT_PATTERN) & c.try_cast("bigint").isNotNull(), F.lit(1 | 2))
            .when(c.rlike(FLOAT_PATTERN), F.lit(2))
            .when(c.rlike(BOOL_PATTERN), F.lit(4)))
    if infer_dates:
        mask = (mask.when(c.rlike(DATE_PATTERN) & c.try_cast("date").isNotNull(), F.lit(8))
                .when(c.rlike(TIMESTAMP_PATTERN) & c.try_cast("timestamp_ntz").isNotNull(), F.lit(16))
                .when(c.rlike(ZONED_TIMESTAMP_PATTERN) & c.try_cast("timestamp").isNotNull(), F.lit(32)))
    return mask.otherwise(F.lit(0))


def infer_types(df: DataFrame, infer_dates: bool = True) -> dict[str, str]:
    """Pick a type per string column with one aggregate over the data.

    Order of preference: bigint, double, boolean, date, timestamp without
    zone (``timestamp_ntz``), timestamp with a zone suffix (``timestamp``),
    string. A column with no value at all stays string. Per column the
    aggregate is a ``bit_and`` of the per-value type masks (nulls skipped),
    i.e. the types every value fits.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return {}
    aggs = []
    for i, name in enumerate(strings):
        c = col(name)
        aggs.append(F.count(c).alias(f"n{i}"))
        aggs.append(F.bit_and(F.when(c.isNotNull(), _type_mask(c, infer_dates))).alias(f"m{i}"))
    stats = df.agg(*aggs).first()
    out = {}
    for i, name in enumerate(strings):
        chosen = "string"
        mask = stats[f"m{i}"]
        if stats[f"n{i}"] and mask:
            chosen = next(t for t, bit in TYPE_BITS if mask & bit)
        out[name] = chosen
    return out


def cast_text(c: Column, type_name: str, strict: bool = False) -> Column:
    """Turn text into ``type_name``. Inferred types fit every value by
    construction; ``strict`` (a caller's schema) fails the job on a value
    that does not convert, whatever the session's ANSI setting."""
    if type_name == "boolean" and not strict:
        return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(c) == F.lit("true"))
    if type_name == "string":
        return c
    if strict:
        from ..operators.columns import strict_cast
        return strict_cast(c, type_name, "CSV")
    return c.cast(type_name)


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[cast_text(col(c), types[c]).alias(c) if c in types else col(c) for c in df.columns])


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    token_list = list(tokens)
    return df.select(*[F.when(~col(f.name).isin(token_list), col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else col(f.name)
                       for f in df.schema.fields])


def _raw_header(spark: SparkSession, path: str | Sequence[str], options: dict) -> list[str] | None:
    """The first file's header row as written (one-row job)."""
    first = spark.read.options(**{**options, "header": "false", "mode": "PERMISSIVE"}).csv(path).limit(1).collect()
    return [v if v is not None else "" for v in first[0]] if first else None


def _maybe_renamed(columns: list[str]) -> bool:
    # Spark renames a repeated header to name + position, and an empty one to _c + position.
    return any(c.endswith(str(i)) for i, c in enumerate(columns))


def _is_one_file(spark: SparkSession, path: str | Sequence[str]) -> bool:
    if not isinstance(path, str) or any(c in path for c in "*?[{"):
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def _headers(spark: SparkSession, path: str | Sequence[str], options: dict, names: list[str]) -> dict[tuple, list[str]]:
    """Files by the order in which their header row has the columns ``names``.

    A header row is the first row of a file whose cells are the names in any order; the driver gets one
    such row per file, as it lists the files anyway. A file without one is an error.
    """
    raw = spark.read.options(**{**options, "header": "false", "mode": "PERMISSIVE"}).csv(path)
    cells = F.array(*[F.coalesce(col(c), F.lit("")) for c in raw.columns])
    wanted = F.lit(sorted(names))
    found = (raw.select(cells.alias("cells"), F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"))
             .where(F.array_sort("cells") == wanted).groupBy("file").agg(F.min_by("cells", "at").alias("cells")).collect())
    without = set(raw.inputFiles()) - {r["file"] for r in found}
    if without:
        raise ValueError(f"header is not {names} in any order: {sorted(without)[:5]}")
    out: dict[tuple, list[str]] = {}
    for r in found:
        literal = re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(r["file"]))
        out.setdefault(tuple(r["cells"]), []).append(literal)
    return out


def read_csv(spark: SparkSession, path: str | Sequence[str], header: bool = True,
             multiline: bool | None = None, sep: str = ",", infer: bool = True, infer_dates: bool = True,
             null_tokens: Sequence[str] = NULL_TOKENS, schema: T.StructType | str | None = None,
             encoding: str = "UTF-8", bad_rows: str = "fail", by_name: bool = False) -> DataFrame:
    """Read CSV with header and inferred types (S1; S9 over a lake path or glob).

    A row with more or fewer cells than the header fails the job; with ``bad_rows="null"`` missing cells are
    null and those beyond the header are left out. Each file's header is checked: a file with other columns,
    or the same ones in another order, fails too. ``by_name=True`` reads such a folder by column name, at the
    cost of one more pass that finds the header rows.

    ``multiline`` allows newlines inside quoted fields but makes each file a single task. By default it is on
    for a single file and off for folders, globs and lists, whose files then split. Repeated header names
    become ``a, a_1`` (compared case-insensitively, as Spark resolves names). A given ``schema`` skips
    inference: values are cast to it and a value that does not convert fails the job. ``encoding`` names the
    file charset (e.g. ``ISO-8859-1`` for many exports).
    """
    if bad_rows not in BAD_RECORDS:
        raise ValueError(f"bad_rows must be one of {sorted(BAD_RECORDS)}")
    if multiline is None:
        multiline = _is_one_file(spark, path)
    options = {**CSV_OPTIONS, **STRICT_CSV, "mode": BAD_RECORDS[bad_rows], "header": str(bool(header)).lower(),
               "multiLine": str(bool(multiline)).lower(), "sep": sep, "inferSchema": "false", "encoding": encoding}
    raw = spark.read.options(**options).csv(path)
    names = raw.columns
    repeated = False
    if header and _maybe_renamed(names):
        first = _raw_header(spark, path, options)
        if first is not None and len(first) == len(names):
            lowered = [n.lower() for n in first]
            repeated = len(set(lowered)) != len(lowered) or "" in first
            if repeated:
                if by_name:
                    raise ValueError(f"columns of a repeated or empty name cannot be read by name: {first}")
                if len(raw.inputFiles()) > 1 and len(_headers(spark, path, options, first)) > 1:
                    raise ValueError(f"files differ in the order of their columns {first}")
                names = dedupe_names(first)
                # Spark's own names for these columns are no header's, so its check would refuse every file
                raw = spark.read.options(**{**options, "enforceSchema": "true"}).csv(path).toDF(*names)
    if header and by_name and names:
        parts = [spark.read.options(**options).csv(files).select(*[col(c) for c in names])
                 for _, files in sorted(_headers(spark, path, options, names).items())]
        raw = reduce(DataFrame.union, parts)
    df = null_tokens_to_null(raw, null_tokens)
    if schema is not None:
        target = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if len(target.fields) != len(df.columns):
            raise ValueError(f"schema has {len(target.fields)} columns, file has {len(df.columns)}")
        return df.select(*[cast_text(col(c), f.dataType.simpleString(), strict=True).alias(f.name)
                           for c, f in zip(df.columns, target.fields)])
    if not infer:
        return df
    return apply_types(df, infer_types(df, infer_dates))


def _starts_with_array(spark: SparkSession, path: str | Sequence[str]) -> bool:
    start = F.substr(F.ltrim("value"), F.lit(1), F.lit(1))             # one character reaches the driver
    first = spark.read.text(path).select(start.alias("c")).where("c != ''").limit(1).collect()
    return bool(first) and first[0]["c"] == "["


def read_json(spark: SparkSession, path: str | Sequence[str], multiline: bool | None = None,
              nan_as_null: bool = True, schema: T.StructType | str | None = None,
              bad_records: str = "fail") -> DataFrame:
    """Read JSON records (S2): a file holding one array of records, or JSON Lines.

    A record that does not parse fails the job; ``bad_records="null"`` reads it as nulls instead.

    ``multiline=None`` looks at the first non-blank line to tell them apart.
    JSON Lines files split across tasks; array files are one task each.
    Nested objects and arrays become struct and array columns.
    """
    if multiline is None:
        multiline = _starts_with_array(spark, path)
    if bad_records not in BAD_RECORDS:
        raise ValueError(f"bad_records must be one of {sorted(BAD_RECORDS)}")
    reader = spark.read.option("multiLine", str(bool(multiline)).lower()).option("mode", BAD_RECORDS[bad_records])
    temporal: dict[str, str] = {}
    if schema is not None:
        target = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        # Dates and times are read as text and cast, which accepts any ISO
        # fraction length (the JSON parser wants one exact pattern).
        read_fields = []
        for f in target.fields:
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                temporal[f.name] = f.dataType.simpleString()
                read_fields.append(T.StructField(f.name, T.StringType(), True))
            else:
                read_fields.append(f)
        reader = reader.schema(T.StructType(read_fields))
    df = reader.json(path)
    if temporal:
        strict = bad_records == "fail"
        df = df.select(*[(cast_text(col(c), temporal[c], strict=True) if strict else col(c).try_cast(temporal[c])).alias(c)
                         if c in temporal else col(c) for c in df.columns])
    return normalize_nan(df) if nan_as_null else df


__all__ = ["NULL_TOKENS", "apply_types", "dedupe_names", "infer_types", "null_tokens_to_null",
           "read_csv", "read_json"]
