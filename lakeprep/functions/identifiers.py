"""Identifier and lake-path clean-up as column expressions.

All built from JVM string functions, so they run inside whole-stage
codegen over a column of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default lake prefix for a bare path (fixed value).
DEFAULT_LAKE_PREFIX = "hdfs://localhost:9000"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def _underscored(c: Column) -> Column:
    # ".py" anywhere is removed first, then space, "-" and "." become "_".
    no_py = F.replace(c, F.lit(".py"), F.lit(""))
    return F.regexp_replace(no_py, r"[ .\-]", "_")


def last_part(c: Column) -> Column:
    """The text after the last ``/`` once trailing ``/`` are removed."""
    trimmed = F.regexp_replace(c, "/+$", "")
    return F.when(F.instr(c, "/") > 0, F.element_at(F.split(trimmed, "/"), -1)).otherwise(c)


def clean_identifier(c: Column | str, lower: bool = True, keep_last_part: bool = True) -> Column:
    """Table-name clean-up (F1; F2 with ``lower=False, keep_last_part=False``):
    trim, drop ``.py``, turn space/``-``/``.`` into ``_``, lower-case, and keep
    the last path part when the text is a path."""
    out = _underscored(strip_ws(c))
    if lower:
        out = F.lower(out)
    if keep_last_part:
        out = last_part(out)
    return out


def job_identifier(c: Column | str) -> Column:
    """Job-name clean-up (F2): as ``clean_identifier`` but case is kept."""
    return clean_identifier(c, lower=False, keep_last_part=False)


def folder_name(c: Column | str) -> Column:
    """Folder name (F4): last path part for a full ``hdfs://`` URL, then
    spaces to ``_`` and lower case."""
    s = strip_ws(c)
    leaf = F.element_at(F.split(F.regexp_replace(s, "/+$", ""), "/"), -1)
    picked = F.when(s.startswith("hdfs://"), leaf).otherwise(s)
    return F.lower(F.replace(picked, F.lit(" "), F.lit("_")))


def split_lake_path(c: Column | str, default_prefix: str = DEFAULT_LAKE_PREFIX) -> Column:
    """Lake path split (F3) into a struct ``full, base, name``.

    ``http(s)://`` schemes become ``hdfs://``; a bare path gets the default
    prefix. ``base`` is everything before the last ``/`` (after trailing
    ``/`` are dropped) and ``name`` the rest with ``-``, ``.`` and spaces
    as ``_``, lower case (``data`` when there is no ``/``).
    """
    s = F.regexp_replace(strip_ws(c), r"^https?://", "hdfs://")
    bare = F.regexp_replace(s, "^/+|/+$", "")
    full = F.when(s.startswith("hdfs://"), s).otherwise(F.concat(F.lit(default_prefix.rstrip("/") + "/"), bare))
    stripped = F.regexp_replace(full, "/+$", "")
    has_slash = F.instr(stripped, "/") > 0
    base = F.when(has_slash, F.regexp_extract(stripped, r"^(.*)/[^/]*$", 1)).otherwise(stripped)
    leaf = F.regexp_extract(stripped, r"([^/]*)$", 1)
    name = F.when(has_slash, F.lower(F.regexp_replace(leaf, r"[-. ]", "_"))).otherwise(F.lit("data"))
    return F.struct(full.alias("full"), base.alias("base"), name.alias("name"))
