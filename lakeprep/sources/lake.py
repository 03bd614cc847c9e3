"""Lake Parquet and saved datasets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import col
from ..small import small_table
from ..operators.types import is_floating
from ..sinks.files import finish_swap
from ..sinks.tables import current_version, finish_replace


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in float/double columns (pandas has one missing value).

    Off by default for Parquet: a filter on the rewritten column can no
    longer be pushed into the scan. Text sources never produce NaN (the
    ``NaN`` token is read as null), JSON can.
    """
    floats = {f.name for f in df.schema.fields if is_floating(f.dataType)}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
                       for c in df.columns])


def read_parquet(spark: SparkSession, path: str, nan_as_null: bool = False) -> DataFrame:
    """Read lake Parquet (S8); column pruning and filter pushdown are Catalyst's.

    A path that an overwrite left empty when it was stopped is completed first (``finish_swap``).
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        if any(c in path for c in "*?[{") or not finish_swap(spark, path):
            raise
        df = spark.read.parquet(path)
    return normalize_nan(df) if nan_as_null else df


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(table_path(sf_dir, name))


def load_saved(spark: SparkSession, name: str) -> DataFrame:
    """Reload a saved dataset (S4) by table name, or by path when ``name``
    looks like one (holds ``/``). A missing one is a clear ``Not found``."""
    if "/" in name:
        name = current_version(spark, name) or name                 # a replaced table's newest version
        try:
            return spark.read.parquet(name)
        except Exception as e:  # noqa: BLE001 - Spark words "missing path" in several ways
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                raise ValueError(f"Not found: {name}") from None
            raise
    if not spark.catalog.tableExists(name) and not finish_replace(spark, name):
        raise ValueError(f"Not found: {name}")
    return spark.table(name)


def list_saved(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Saved datasets of a database as a table (S5): ``name, database, is_temporary``.

    Catalog metadata only (one row per table), so building it on the driver is bounded
    by the number of tables, not by data size.
    """
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    rows = [(t.name, t.database, bool(t.isTemporary)) for t in tables]
    return small_table(spark, rows, "name string, database string, is_temporary boolean")
