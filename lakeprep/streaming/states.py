"""Profiles of an appended dataset from states kept per epoch (A1, A2, A8 over an R2 sink).

A dataset that grows by epochs need not be read again to profile it. Each committed epoch gets a state beside
the data, written once and committed by a marker of its own:

* ``cells``: per column its rows, missing values, and the sum and number of its numeric values;
* ``prints``: the 128-bit fingerprints of its rows with their counts, 24 bytes a distinct row.

States of several epochs add up, so a profile reads the data of new epochs only and merges small tables. When
more than ``FOLD`` states have gathered they are added up into one that covers them all. Rows are told apart by
their fingerprints alone here: counting two different rows as copies takes equal hashes of 128 bits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import missing, without_nan
from ..operators.fingerprints import fingerprint
from ..operators.types import is_numeric
from ..sinks import commits
from .refresh import committed_epochs

STATES, FOLD = "_states", 50
_STATE = re.compile(r"^epochs=(\d+)-(\d+)$")


def _root(sink: str) -> str:
    return f"{sink.rstrip('/')}/{STATES}"


def _covering(spark: SparkSession, sink: str) -> list[tuple[int, int]]:
    """Committed states ``(first, last epoch)``, widest first where one holds another."""
    found = sorted(((int(m[1]), int(m[2])) for n in commits.committed(spark, _root(sink)) if (m := _STATE.match(n))), key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for first, last in found:
        if not out or last > out[-1][1]:
            out.append((first, last))
    return out


def _cells(df: DataFrame) -> DataFrame:
    """One row per column: ``place, name, rows, nulls, total, numbers``."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        value = without_nan(f.name, f.dataType).cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        aggs += [F.count_if(missing(f.name, f.dataType)).alias(f"m{i}"), F.sum(value).alias(f"t{i}"), F.count(value).alias(f"n{i}")]
    each = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(is_numeric(f.dataType)).alias("numeric"), F.col("rows"),
                     F.col(f"m{i}").alias("nulls"), F.col(f"t{i}").alias("total"), F.col(f"n{i}").alias("numbers"))
            for i, f in enumerate(df.schema.fields)]
    return df.agg(*aggs).select(F.inline(F.array(*each)))


def _prints(df: DataFrame) -> DataFrame:
    first, second = fingerprint([without_nan(f.name, f.dataType) for f in df.schema.fields])
    return df.select(first.alias("f1"), second.alias("f2")).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("k"))


def _read(spark: SparkSession, sink: str, part: str, states: list[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{_root(sink)}/epochs={a}-{b}/{part}" for a, b in states])


def _summed_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("place", "name", "numeric").agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", "total", "numbers")])


def _summed_prints(prints: DataFrame) -> DataFrame:
    return prints.groupBy("f1", "f2").agg(F.sum("k").alias("k"))


def _write(spark: SparkSession, sink: str, span: tuple[int, int], cells: DataFrame, prints: DataFrame) -> None:
    name = f"epochs={span[0]}-{span[1]}"
    for part, df in (("cells", cells.coalesce(1)), ("prints", prints)):          # cells: one row per column
        df.write.mode("overwrite").parquet(f"{_root(sink)}/{name}/{part}")
    commits.commit(spark, _root(sink), name, {"epochs": list(span)})


def update_states(spark: SparkSession, sink: str) -> list[int]:
    """Take the states of committed epochs that have none; returns these epochs. One writer at a time."""
    known = _covering(spark, sink)
    new = [e for e in committed_epochs(spark, sink) if not any(a <= e <= b for a, b in known)]
    for e in new:
        rows = spark.read.parquet(f"{sink.rstrip('/')}/epoch={e}")
        _write(spark, sink, (e, e), _cells(rows), _prints(rows))
    states = _covering(spark, sink)
    if len(states) > FOLD:
        whole = (states[0][0], states[-1][1])
        _write(spark, sink, whole, _summed_cells(_read(spark, sink, "cells", states)), _summed_prints(_read(spark, sink, "prints", states)))
        for a, b in states:
            commits.forget(spark, _root(sink), f"epochs={a}-{b}")
    return new


def _current(spark: SparkSession, sink: str, part: str) -> DataFrame:
    update_states(spark, sink)
    states = _covering(spark, sink)
    if not states:
        raise ValueError(f"nothing refreshed yet under {sink}")
    return _read(spark, sink, part, states)


def appended_profile(spark: SparkSession, sink: str) -> DataFrame:
    """``rows, columns, null_cells, duplicate_rows`` of all committed epochs together (A2)."""
    cells = _summed_cells(_current(spark, sink, "cells"))
    copies = _summed_prints(_current(spark, sink, "prints")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    whole = cells.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("null_cells"))
    return whole.select("rows", F.col("columns").cast("bigint").alias("columns"), "null_cells",
                        copies.scalar().cast("bigint").alias("duplicate_rows"))


def appended_null_report(spark: SparkSession, sink: str) -> DataFrame:
    """Columns that hold missing values, with their number (A1)."""
    cells = _summed_cells(_current(spark, sink, "cells"))
    return cells.where(F.col("nulls") > 0).select(F.col("name").alias("column"), F.col("nulls").alias("null_count"))


def appended_means(spark: SparkSession, sink: str) -> DataFrame:
    """``column, mean`` of every numeric column (A8); null where it has no value."""
    cells = _summed_cells(_current(spark, sink, "cells"))
    return cells.where("numeric").select(F.col("name").alias("column"), F.try_divide("total", "numbers").alias("mean"))
