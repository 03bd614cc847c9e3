"""File sinks: CSV (K1), JSON Lines (K2), lake Parquet (K5), CSV landing (K7).

Writers run on the executors, one file per task; nothing is gathered on
the driver. Row counts come from an ``Observation`` on the written
DataFrame, so reporting them costs no extra job.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import col, require_columns
from ..operators.types import NESTED
from . import commits


@dataclass(frozen=True)
class StoreReport:
    location: str
    rows: int
    columns: int
    format: str


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    obs = Observation(f"store-{uuid.uuid4().hex[:8]}")
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


# Full microsecond precision in text output (Spark's default keeps milliseconds).
TEXT_TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
}


def _flat_for_csv(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested values; write them as JSON text."""
    if not any(isinstance(f.dataType, NESTED) for f in df.schema.fields):
        return df
    return df.select(*[F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, NESTED) else col(f.name)
                       for f in df.schema.fields])


def sized(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The rows dealt anew so that files come out even (one shuffle, AQE's rebalance).

    Tasks get about ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` each: small ones are joined, and a
    value of ``partition_by`` that holds most rows is cut. With ``partition_by`` a folder gets files from
    the few tasks that hold its value instead of one from every task.
    """
    return df.hint("rebalance", *(partition_by or []))


def clustered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in ranges of ``columns`` and sorted within: row groups get narrow bounds that filters can skip by."""
    keys = [col(c) for c in columns]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def lookup_options(columns: list[str]) -> dict[str, str]:
    """Parquet writer options for Bloom filters on ``columns``, sized by the distinct values of each row group."""
    out = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return out | ({"parquet.bloom.filter.adaptive.enabled": "true"} if columns else {})


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",", rebalance: bool = False) -> StoreReport:
    """CSV with header (K1): nulls as empty fields, RFC-4180 quoting; ``sep``
    for other delimiters (tab for TSV); ``rebalance`` as in :func:`write_parquet`."""
    out, obs = _observed(sized(_flat_for_csv(df)) if rebalance else _flat_for_csv(df))
    # Spark trims leading/trailing spaces on write by default; keep values as they are.
    _written(df.sparkSession, path, mode, lambda place, how: (
        out.write.mode(how).options(**TEXT_TIME_OPTIONS).option("header", "true").option("quote", '"')
        .option("escape", '"').option("nullValue", "").option("sep", sep)
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(place)))
    return StoreReport(path, obs.get["rows"], len(df.columns), "csv")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> StoreReport:
    """JSON Lines, one record per row (K2). Null fields are written, so an
    all-null column still comes back when the folder is read."""
    out, obs = _observed(df)
    _written(df.sparkSession, path, mode, lambda place, how: (
        out.write.mode(how).options(**TEXT_TIME_OPTIONS).option("ignoreNullFields", "false").json(place)))
    return StoreReport(path, obs.get["rows"], len(df.columns), "json")


def parquet_location(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def laid_out(df: DataFrame, partition_by: list[str] | None, rebalance: bool, cluster_by: list[str] | None) -> DataFrame:
    if rebalance and cluster_by:
        raise ValueError("give one of rebalance= and cluster_by=: both deal the rows anew")
    require_columns(df, [*(partition_by or []), *(cluster_by or [])])
    if cluster_by:
        return clustered(df, [*(partition_by or []), *cluster_by])
    return sized(df, partition_by) if rebalance else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                  rebalance: bool = False, cluster_by: list[str] | None = None, lookup: list[str] | None = None) -> StoreReport:
    """Parquet at ``path``.

    ``rebalance`` evens out file sizes (:func:`sized`); ``cluster_by`` keeps equal and close values of its
    columns together (:func:`clustered`); ``lookup`` adds Bloom filters, so a search for one value of these
    columns skips the row groups that do not hold it. Filters need no change to profit.
    """
    require_columns(df, lookup or [])
    out, obs = _observed(laid_out(df, partition_by, rebalance, cluster_by))

    def write(place: str, how: str) -> None:
        writer = out.write.mode(how).options(**lookup_options(lookup or []))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(place)

    _written(df.sparkSession, path, mode, write)
    return StoreReport(path, obs.get["rows"], len(df.columns), "parquet")


def store_parquet(df: DataFrame, base: str, name: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                  rebalance: bool = False, cluster_by: list[str] | None = None, lookup: list[str] | None = None) -> StoreReport:
    """Store as ``<base>/<name>.parquet`` and report rows and columns (K5).

    ``partition_by`` writes one folder per value of those columns, so later
    filters on them prune whole folders (``PartitionFilters``). The other
    options are those of :func:`write_parquet`.
    """
    return write_parquet(df, parquet_location(base, name), mode, partition_by, rebalance, cluster_by, lookup)


#: How a landing writes a null; a text that begins with a backslash gets one more in front.
LANDED_NULL = "\\N"


def landing_name(name: str) -> str:
    """A new landing folder, sortable within its dataset: ``<name>/<UTC time>-<random>``.

    Datasets have folders of their own, so no name is the beginning of another's landings.
    """
    if not name or name in (".", "..") or any(c in name for c in "/\\*?[]{}:") or name.startswith(("_", ".")):
        raise ValueError(f"dataset name {name!r} must be a single plain path part")
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return f"{name}/{stamp}-{uuid.uuid4().hex[:8]}"


def _marked_nulls(df: DataFrame) -> DataFrame:
    """Every column as text in which null, empty and any other text stay apart."""
    out = []
    for f in _flat_for_csv(df).schema.fields:
        c = col(f.name)
        text = c if isinstance(f.dataType, T.StringType) else c.cast("string")
        if isinstance(f.dataType, T.TimestampType):
            text = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        text = F.when(text.startswith("\\"), F.concat(F.lit("\\"), text)).otherwise(text)
        out.append(F.coalesce(text, F.lit(LANDED_NULL)).alias(f.name))
    return _flat_for_csv(df).select(*out)


def unmarked(c):
    """The text a landing stands for; null for its null mark."""
    return F.when(c == LANDED_NULL, None).when(c.startswith("\\"), F.substr(c, F.lit(2))).otherwise(c)


def land_csv(df: DataFrame, base: str, name: str, rebalance: bool = False) -> StoreReport:
    """Land the dataset as CSV under ``<base>/input/`` in a **new** folder (K7).

    A file stream remembers files by path, so overwriting one landing in
    place would never be seen again; every landing gets a fresh name. Nulls
    are written as ``LANDED_NULL``, so that texts such as ``NA`` or an empty
    one come back as they were. The folder is written under ``<base>/staging/`` and renamed into ``input/``
    once complete, so a stream never lists a half-written landing.
    """
    spark = df.sparkSession
    folder = landing_name(name)
    staging = f"{base.rstrip('/')}/staging/{folder}"
    final = f"{base.rstrip('/')}/input/{folder}"
    report = write_csv(_marked_nulls(df), staging, rebalance=rebalance)
    commits.rename(spark, staging, final)
    return StoreReport(final, report.rows, report.columns, "csv")


def _written(spark, path: str, mode: str, write: Callable[[str, str], None]) -> None:
    """Run ``write(path, mode)``; an overwrite of an existing folder is written beside it and takes its place.

    Spark empties a folder before it writes there, which loses data that is read from the same folder, or
    everything if the job fails. Renames are cheap on HDFS and local disks; object stores copy. A job that
    stops between the two renames leaves the path empty and both datasets beside it: :func:`finish_swap`,
    run by the next write and by ``read_parquet``, puts the new one in place. Where readers must never meet
    an empty path, store a table (``sinks.tables``) or refresh (``streaming.refresh``).
    """
    place = path.rstrip("/")
    finish_swap(spark, place)
    if mode != "overwrite" or not commits.exists(spark, place):
        write(path, mode)
        return
    mark = uuid.uuid4().hex[:8]
    write(f"{place}.new-{mark}", "errorifexists")
    commits.rename(spark, place, f"{place}.old-{mark}")
    commits.rename(spark, f"{place}.new-{mark}", place)
    commits.remove(spark, f"{place}.old-{mark}")
    spark.catalog.refreshByPath(path)


def finish_swap(spark, path: str) -> bool:
    """Complete an overwrite of ``path`` that stopped between its two renames; True if there was one.

    Both folders beside the path carry the same mark then, and the new one is complete: its writer had
    returned before the first rename.
    """
    place = path.rstrip("/")
    if commits.exists(spark, place) or "/" not in place:
        return False
    parent, name = place.rsplit("/", 1)
    beside = commits.sub_folders(spark, parent)
    marks = [n.removeprefix(f"{name}.old-") for n in beside if n.startswith(f"{name}.old-")]
    for mark in marks:
        if f"{name}.new-{mark}" in beside:
            commits.rename(spark, f"{place}.new-{mark}", place)
            commits.remove(spark, f"{place}.old-{mark}")
            return True
    return False
