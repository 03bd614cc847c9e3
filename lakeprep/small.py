"""Small result tables (reports, descriptions) built JVM-side.

``spark.createDataFrame(list)`` ships the rows through a Python RDD, which
starts Python workers just to unpickle a handful of rows. Reports here are
bounded by the column or step count, so they are written as literals in a
one-partition plan instead: no Python worker, one task.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """``rows`` of numbers and texts by way of one JSON literal: for some thousands of rows, where a literal per
    cell would make a plan too large. Doubles come back bit by bit, infinities and NaN included."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    body = json.dumps([dict(zip(names, row)) for row in rows], default=str)
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(body), f"array<struct<{schema_of(schema)}>>", {"mode": "FAILFAST"})))


def schema_of(schema: str) -> str:
    """A DDL field list as the inside of a struct type."""
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def _literal(value, dtype: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(value, (_dt.datetime, _dt.date)):
        return F.lit(value.isoformat()).cast(dtype)
    return F.lit(value).cast(dtype)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A DataFrame holding ``rows`` (a short list) with the given schema."""
    st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    one = spark.range(0, 1 if rows else 0, 1, 1)
    if not rows:
        return one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(row, st.fields)])
               for row in rows]
    return one.select(F.inline(F.array(*structs)))
