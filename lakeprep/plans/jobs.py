"""One-application jobs: source -> recipe -> sink, with a step report.

Each step runs in order and a failed step stops the job; the report is a
small DataFrame ``step, status, rows, location, detail`` (one row per step).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from ..operators.cleaning import counted
from ..operators.columns import select_columns
from ..small import small_table
from ..sinks.files import StoreReport, store_parquet
from ..sinks.tables import store_table
from ..sources.jdbc import JdbcTarget, read_jdbc
from ..sources.lake import read_parquet
from .recipe import Recipe

REPORT_SCHEMA = "step string, status string, rows bigint, location string, detail string"


class JobFailed(RuntimeError):
    """A job step failed; ``report`` holds the step table, the cause is chained."""

    def __init__(self, step: str, report: DataFrame, cause: Exception) -> None:
        super().__init__(f"step {step!r} failed: {type(cause).__name__}: {cause}")
        self.step, self.report = step, report


@dataclass
class JobResult:
    report: DataFrame
    output: DataFrame | None
    stored: StoreReport | None


def run_store_job(spark: SparkSession, source: Callable[[SparkSession], DataFrame],
                  sink: Callable[[DataFrame], StoreReport], recipe: Recipe | None = None,
                  count_steps: bool = False) -> JobResult:
    """Load, transform and store in one application (R1); a failed step raises :class:`JobFailed`.

    ``count_steps`` reports the rows that were loaded and those each step of the recipe left, one line a
    step. The counters ride on the job that stores (no job of their own), but a counter between a source
    and a filter keeps the filter from the scan. Rows a ``preview`` never reads are not counted before it.
    """
    rows: list[tuple] = []
    counters: list[tuple[str, Observation]] = []

    def watched(label: str, frame: DataFrame) -> DataFrame:
        if not count_steps:
            return frame
        frame, counter = counted(frame, f"step{len(counters)}")
        counters.append((label, counter))
        return frame

    df = out = None
    stored = None
    stage = "load"
    try:
        df = source(spark)
        rows.append(("load", "ok", None, None, f"{len(df.columns)} columns"))
        df = watched("load", df)
        stage = "transform"
        out = recipe.apply(df, lambda step, frame: watched(step.op, frame)) if recipe is not None else df
        rows.append(("transform", "ok", None, None, f"{len(recipe) if recipe else 0} steps"))
        stage = "store"
        stored = sink(out)
        rows.append(("store", "ok", stored.rows, stored.location, stored.format))
    except Exception as e:
        rows.append((stage, "failed", None, None, f"{type(e).__name__}: {e}"))
        for later in ("load", "transform", "store")[("load", "transform", "store").index(stage) + 1:]:
            rows.append((later, "skipped", None, None, None))
        raise JobFailed(stage, small_table(spark, rows, REPORT_SCHEMA), e) from e
    if counters:
        found = [(label, counter.get["rows"]) for label, counter in counters]
        steps = [(f"transform {i}", "ok", n, None, label) for i, (label, n) in enumerate(found[1:], 1)]
        rows = [("load", "ok", found[0][1], None, rows[0][4]), rows[1], *steps, rows[2]]
    report = small_table(spark, rows, REPORT_SCHEMA)
    return JobResult(report, out, stored)


def database_to_lake(spark: SparkSession, target: JdbcTarget, table: str, base: str,
                     provider: str = "parquet", identifier: str | None = None,
                     partition_column: str | None = None, num_partitions: int = 8,
                     location: str | None = None, predicates: Sequence[str] | None = None,
                     single_task: bool = False, balance: bool = False) -> JobResult:
    """Database table -> lake Parquet folder or table (R3), read in parallel slices."""
    def source(s):
        return read_jdbc(s, target, table, partition_column, num_partitions, predicates=predicates, single_task=single_task,
                         balance=balance)

    if provider == "folder":
        def sink(df):
            return store_parquet(df, base, table)
    else:
        def sink(df):
            return store_table(df, identifier or table, provider=provider, location=location)
    return run_store_job(spark, source, sink)


def parquet_to_table(spark: SparkSession, path: str, columns: Sequence[str], identifier: str,
                     provider: str = "iceberg", location: str | None = None) -> JobResult:
    """Lake Parquet -> selected columns -> create-or-replace table (K9).

    ``location`` places a Parquet-provider table's files (an external table);
    without it the catalog's warehouse is used.
    """
    return run_store_job(spark, lambda s: select_columns(read_parquet(s, path), columns),
                         lambda df: store_table(df, identifier, provider=provider, location=location))
