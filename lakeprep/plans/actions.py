"""Run one ``NAME[:arg...]`` action on a dataset, the way a chat command would.

Transform actions (FILTER, SORT, RENAME, DROP_COLUMN, REMOVE_NULLS,
REMOVE_DUPLICATES) return the new dataset; report actions (FIND_NULLS,
DETECT_SCHEMA, COMPARE) leave the dataset as it is and return a report
table. Storage and scheduling actions are not data steps: use
``lakeprep.sinks`` / ``lakeprep.plans.jobs`` / ``lakeprep.streaming``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.profiling import compare_columns, null_report, schema_report
from .recipe import Recipe

REPORTS = ("FIND_NULLS", "DETECT_SCHEMA", "COMPARE")


@dataclass
class ActionResult:
    data: DataFrame                 # the dataset after the action
    report: DataFrame | None = None  # set by report actions


def _name_and_rest(action: str) -> tuple[str, str]:
    text = action.strip()
    if text.startswith("ACTION:"):
        text = text[len("ACTION:"):]
    name, _, rest = text.partition(":")
    return name.strip().upper(), rest


def apply_action(df: DataFrame, action: str) -> ActionResult:
    name, rest = _name_and_rest(action)
    if name == "FIND_NULLS":
        return ActionResult(df, null_report(df))
    if name == "DETECT_SCHEMA":
        return ActionResult(df, schema_report(df))
    if name == "COMPARE":
        parts = [p.strip() for p in rest.split(":")]
        if len(parts) != 2 or not all(parts):
            raise ValueError("COMPARE needs two columns: COMPARE:col1:col2")
        return ActionResult(df, compare_columns(df, parts[0], parts[1]))
    return ActionResult(Recipe.from_actions([action]).apply(df))


def apply_actions(df: DataFrame, actions: list[str]) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Apply actions in order; returns the final dataset and the reports made on the way."""
    reports: list[tuple[str, DataFrame]] = []
    for a in actions:
        result = apply_action(df, a)
        df = result.data
        if result.report is not None:
            reports.append((a, result.report))
    return df, reports
