"""Catalog tables: dataset snapshots (K3) and create-or-replace stores (K6).

``provider="iceberg"`` uses the DataSource V2 ``writeTo(...).createOrReplace()`` path with Parquet data files
(needs an Iceberg catalog on the classpath).

``provider="parquet"`` keeps a session-catalog Parquet table whose files are versions. A replacement is written
in full to a new folder in ``<first location>__versions``, committed there by a marker (``sinks.commits``) and
published by one change of the table's location: a reader gets the old rows or the new ones, and there is no moment without a table. The
version it replaces is deleted then, but for the ``keep`` newest. Catalogs of this kind cannot change the
columns of a table in place: a replacement with other columns or partitions is registered under a second name
and takes the first by two renames; stopped between them, it is completed by the next save or ``load_saved``.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..names import col, quote
from . import commits
from .files import StoreReport, laid_out, lookup_options

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def check_identifier(identifier: str, max_parts: int = 3) -> str:
    """Validate ``[catalog.][schema.]table``; each part a plain identifier."""
    parts = identifier.split(".")
    if not 1 <= len(parts) <= max_parts or not all(_IDENT.match(p) for p in parts):
        raise ValueError(f"Invalid table identifier {identifier!r}: use letters, digits and _ "
                         f"in at most {max_parts} dot-separated parts")
    return identifier


def _observed(df: DataFrame, label: str) -> tuple[DataFrame, Observation]:
    obs = Observation(label)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def save_snapshot(df: DataFrame, name: str, location: str | None = None, keep: int = 0) -> StoreReport:
    """Save the dataset as a Parquet catalog table (K3); types are kept.

    ``location`` makes it an external table at a path of the caller's choice (later versions beside it),
    otherwise the warehouse is used. The report names the folder that holds the rows just saved.
    """
    check_identifier(name)
    out, obs = _observed(df, f"snapshot-{name}")
    _replace_table(df.sparkSession, out, name, location, keep=keep)
    return StoreReport(table_location(df.sparkSession, name), obs.get["rows"], len(df.columns), "parquet-table")


VERSIONS = "__versions"


def _versions_root(spark: SparkSession, name: str, location: str | None) -> str:
    """Folder of a table's later versions: beside the caller's location or its database's managed tables."""
    if location:
        return f"{location.rstrip('/')}{VERSIONS}"
    *database, table = name.split(".")
    place = spark.catalog.getDatabase(".".join(database) or spark.catalog.currentDatabase()).locationUri
    return f"{place.rstrip('/')}/{table.lower()}{VERSIONS}"


def _layout(spark: SparkSession, name: str) -> tuple:
    """Columns and partition columns of a table, and whether its files are Parquet."""
    columns = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields]
    partitions = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    provider = next((r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect() if r[0] == "Provider"), None)
    return columns, partitions, (provider or "").lower() == "parquet"


@contextmanager
def _partitions_in_files(spark: SparkSession):
    """Tables made here find their partitions in the folder they point at, so the location says all."""
    key = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _replace_table(spark: SparkSession, df: DataFrame, name: str, location: str | None = None,
                   options: dict[str, str] | None = None, partition_by: list[str] | None = None, keep: int = 0) -> None:
    """Write ``df`` as a new version of a Parquet table and publish it; the data may come from the table."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    finish_replace(spark, name)
    there, partition_by = spark.catalog.tableExists(name), list(partition_by or [])
    writer = df.write.format("parquet").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not there and not (location and commits.exists(spark, location)):
        if location:
            writer = writer.option("path", location)
        with _partitions_in_files(spark):
            writer.saveAsTable(name)                                # managed without a location: dropping it drops its files
        return
    root, version = _versions_root(spark, name, location), commits.new_version()
    place = f"{root}/{version}"
    try:
        writer.save(place)
    except Exception:
        commits.remove(spark, place)
        raise
    commits.commit(spark, root, version, {"table": name})
    former = _own_folder(spark, name, location) if there else None
    columns = [f for f in df.schema.fields if f.name not in partition_by] + [f for c in partition_by for f in df.schema.fields if f.name == c]
    if not there:
        _register(spark, name, place, columns, partition_by)
    elif _layout(spark, name) == ([(f.name, f.dataType.simpleString()) for f in columns], partition_by, True):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{_sql_text(place)}'")
        spark.catalog.refreshTable(name)
    else:
        mark = uuid.uuid4().hex[:8]
        _register(spark, f"{name}_new_{mark}", place, columns, partition_by)
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_{mark}")
        spark.sql(f"ALTER TABLE {name}_new_{mark} RENAME TO {name}")
        spark.sql(f"DROP TABLE {name}_old_{mark}")
    _clean(spark, root, version, former, keep)


def _sql_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _register(spark: SparkSession, name: str, place: str, columns: list, partition_by: list[str]) -> None:
    """An external table on a folder that is there already."""
    said = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in columns)
    parts = f" PARTITIONED BY ({', '.join(map(quote, partition_by))})" if partition_by else ""
    with _partitions_in_files(spark):
        spark.sql(f"CREATE TABLE {name} ({said}) USING parquet{parts} LOCATION '{_sql_text(place)}'")


def _own_folder(spark: SparkSession, name: str, location: str | None) -> str | None:
    """The folder a table's rows are in, if it is the table's own to delete: a version, a managed table's, or the
    location the caller named. The files of other external tables are left alone."""
    place = table_location(spark, name)
    own = (commits.is_version(place.rstrip("/").rsplit("/", 1)[-1]) or spark.catalog.getTable(name).tableType == "MANAGED"
           or location and _same_place(spark, location) == _same_place(spark, place))
    return place if own else None


def _clean(spark: SparkSession, root: str, version: str, former: str | None, keep: int) -> None:
    """Delete what the new version replaces: earlier versions under its root but the ``keep`` newest, and the
    folder the table had elsewhere. Unfinished folders of other writers have no marker and are left alone."""
    older = [v for v in commits.committed(spark, root) if commits.is_version(v) and v < version]
    for old in older[:-keep or None]:
        commits.forget(spark, root, old)
    if former and len(older) >= keep:                               # the first folder is older than any version
        above, last = former.rstrip("/").rsplit("/", 1)
        if not commits.is_version(last):
            commits.remove(spark, former)
        elif _same_place(spark, above) != _same_place(spark, root):
            commits.forget(spark, above, last)


def _same_place(spark: SparkSession, path: str) -> str:
    fs, place = commits.file_system(spark, path)
    return fs.makeQualified(place).toString()


def finish_replace(spark: SparkSession, name: str) -> bool:
    """Complete a replacement with other columns that stopped between its two renames; True if there was one."""
    if spark.catalog.tableExists(name):
        return False
    *database, table = name.split(".")
    prefix = f"{'.'.join(database)}." if database else ""
    tables = spark.catalog.listTables(".".join(database)) if database else spark.catalog.listTables()
    names = {t.name for t in tables if not t.isTemporary}
    for mark in sorted(n.removeprefix(f"{table.lower()}_new_") for n in names if n.startswith(f"{table.lower()}_new_")):
        if f"{table.lower()}_old_{mark}" in names:
            spark.sql(f"ALTER TABLE {prefix}{table}_new_{mark} RENAME TO {name}")
            spark.sql(f"DROP TABLE {prefix}{table}_old_{mark}")
            return True
    return False


def current_version(spark: SparkSession, location: str) -> str | None:
    """The newest version of the table first saved at ``location``, if it was replaced since."""
    root = f"{location.rstrip('/')}{VERSIONS}"
    versions = [v for v in commits.committed(spark, root) if commits.is_version(v)]
    return f"{root}/{versions[-1]}" if versions else None


def store_table(df: DataFrame, identifier: str, provider: str = "iceberg",
                location: str | None = None, properties: dict[str, str] | None = None,
                count_rows: bool = True, partition_by: list[str] | None = None, keep: int = 0, rebalance: bool = False,
                cluster_by: list[str] | None = None, lookup: list[str] | None = None) -> StoreReport:
    """Create or replace a table with the dataset (K6); ``keep`` older versions of a Parquet table stay.

    ``rebalance``, ``cluster_by`` and ``lookup`` are those of ``write_parquet`` (Bloom filters: Parquet tables).

    The location reported is the table's real location as the catalog
    records it, not a guessed path. Rows are counted while writing.
    """
    check_identifier(identifier)
    spark = df.sparkSession
    df = laid_out(df, partition_by, rebalance, cluster_by)
    out, obs = _observed(df, f"store-{identifier}") if count_rows else (df, None)
    if provider == "iceberg":
        writer = out.writeTo(identifier).using("iceberg").tableProperty("write.format.default", "parquet")
        for key, value in (properties or {}).items():
            writer = writer.tableProperty(key, value)
        if partition_by:
            writer = writer.partitionedBy(*[col(c) for c in partition_by])
        writer.createOrReplace()
    elif provider == "parquet":
        _replace_table(spark, out, identifier, location, lookup_options(lookup or []) | (properties or {}), partition_by, keep)
    else:
        raise ValueError(f"provider must be 'iceberg' or 'parquet', not {provider!r}")
    rows = obs.get["rows"] if obs is not None else -1
    return StoreReport(table_location(spark, identifier), rows, len(df.columns), provider)


def table_location(spark, identifier: str) -> str:
    """Where the catalog says the table's data lives (bounded metadata query)."""
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {identifier}").collect():
        if r[0] == "Location":
            return r[1]
    raise LookupError(f"the catalog records no location for {identifier}")
