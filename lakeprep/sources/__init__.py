"""Readers. ``load`` picks one by file extension (case-insensitive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lake import read_parquet
from .text import read_csv, read_json

READERS = {
    ".csv": read_csv,
    ".json": read_json,
    ".jsonl": read_json,
    ".parquet": read_parquet,
}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read ``path`` with the reader its extension names.

    A trailing ``/`` or glob keeps the extension of the pattern, e.g.
    ``landing/*.csv``. Any other extension is refused.
    """
    stem = path.rstrip("/").lower()
    for ext, reader in READERS.items():
        if stem.endswith(ext):
            return reader(spark, path, **options)
    raise ValueError(f"no reader for {path!r}; known extensions are {sorted(READERS)}")


__all__ = ["READERS", "load", "read_csv", "read_json", "read_parquet"]
