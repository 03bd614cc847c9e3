"""Datasets in a lake folder that are replaced under running readers (K1, K2, K5 by versions).

``publish`` writes a dataset to a version folder of its own below ``root`` and commits it by a marker
(``commits``): readers get the old version or the new one, never a part, and there is no moment without a
dataset. The marker records format, schema and rows, so CSV and JSON come back with their types. Older
versions but the ``keep`` newest are deleted after the commit. A job that fails or is lost before it leaves
the dataset as it was; :func:`sweep` deletes what such jobs left behind.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..small import small_table
from . import commits
from .files import StoreReport, write_csv, write_json, write_parquet

FORMATS = {"parquet": write_parquet, "csv": write_csv, "json": write_json}


def publish(df: DataFrame, root: str, form: str = "parquet", keep: int = 0, **options) -> StoreReport:
    """Write a new version and make it the current one; ``options`` go to the writer of the format."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {sorted(FORMATS)}, not {form!r}")
    if keep < 0:
        raise ValueError("keep must not be negative")
    spark, root, version = df.sparkSession, root.rstrip("/"), commits.new_version()
    try:
        report = FORMATS[form](df, f"{root}/{version}", "errorifexists", **options)
    except Exception:
        commits.remove(spark, f"{root}/{version}")
        raise
    said = {"format": form, "schema": json.loads(df.schema.json()), "rows": report.rows,
            "sep": options.get("sep", ","), "at": _dt.datetime.now(_dt.timezone.utc).isoformat()}
    commits.commit(spark, root, version, said)
    for old in [v for v in versions(spark, root) if v < version][:-keep or None]:
        commits.forget(spark, root, old)
    return report


def versions(spark: SparkSession, root: str) -> list[str]:
    """Committed versions, oldest first (a listing of markers, no data read)."""
    return [v for v in commits.committed(spark, root) if commits.is_version(v)]


def read_published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version, or a named one that is still kept."""
    from ..sources.text import read_csv, read_json

    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"Not found: {version or 'a published version'} under {root}")
    version = version or known[-1]
    said, place = commits.content(spark, root, version), f"{root.rstrip('/')}/{version}"
    schema = T.StructType.fromJson(said["schema"])
    if said["format"] == "csv":
        # texts may hold line breaks, and words that elsewhere stand for null are themselves; an empty text is null
        return read_csv(spark, place, schema=schema, sep=said["sep"], multiline=True, null_tokens=("",))
    if said["format"] == "json":
        return read_json(spark, place, schema=schema)
    return spark.read.parquet(place).select(*[f"`{n.replace('`', '``')}`" for n in schema.fieldNames()])


def publish_log(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed version: ``version, format, rows, at``."""
    rows = [(v, c["format"], c["rows"], c["at"]) for v in versions(spark, root) for c in [commits.content(spark, root, v)]]
    return small_table(spark, rows, "version string, format string, rows bigint, at string")


def sweep(spark: SparkSession, root: str, older_than: _dt.timedelta = _dt.timedelta(days=7)) -> list[str]:
    """Delete version folders without a marker that began before ``older_than`` ago: writers that were lost."""
    limit = commits.version_time(_dt.datetime.now(_dt.timezone.utc) - older_than)
    known = set(commits.committed(spark, root))
    lost = [v for v in commits.sub_folders(spark, root) if commits.is_version(v) and v not in known and v < limit]
    for v in lost:
        commits.remove(spark, f"{root.rstrip('/')}/{v}")
    return lost
