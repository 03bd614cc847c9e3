"""Sorting and previews (O1, O2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import col, require_columns
from .fingerprints import marked, repeats
from .types import has_map, is_floating

ASCENDING = ("asc", "ascending")
DESCENDING = ("desc", "descending")


def _is_ascending(order: str) -> bool:
    word = str(order).strip().lower()
    if word in ASCENDING:
        return True
    if word in DESCENDING:
        return False
    raise ValueError(f"Unknown sort order {order!r}; use asc/ascending or desc/descending")


def sort_keys(df: DataFrame, column: str, order: str = "asc",
              tie_breakers: Sequence[str] = ()) -> list[Column]:
    """Sort expressions with missing values last in both directions.

    For float/double columns NaN is missing too: a leading ``isnan`` key
    keeps it at the end even when descending (Spark alone would put NaN,
    its largest value, first).
    """
    require_columns(df, [column, *tie_breakers])
    c = col(column)
    first = c.asc_nulls_last() if _is_ascending(order) else c.desc_nulls_last()
    dtype = next(f.dataType for f in df.schema.fields if f.name == column)
    lead = [F.isnan(c).asc()] if dtype.typeName() in ("float", "double") else []
    return [*lead, first, *(col(t).asc_nulls_last() for t in tie_breakers)]


def row_hash(df: DataFrame) -> Column:
    """A deterministic 64-bit hash of the row's columns that can be hashed (not those that hold maps)."""
    return F.xxhash64(F.lit(0), *[col(f.name) for f in df.schema.fields if not has_map(f.dataType)])


def sort_rows(df: DataFrame, column: str, order: str = "asc",
              tie_breakers: Sequence[str] = (), split_ties: bool = True, split_copies: bool = False) -> DataFrame:
    """Total sort by one column (O1): a range-partitioned shuffle, then local sorts.

    Rows that tie on the sort keys come in no particular order (as with an
    unstable sort). ``split_ties`` makes that order a deterministic row hash
    and adds it as a last key, so the range partitioner can cut a run of one
    hot value across many tasks instead of sending it all to one. Rows that are equal in every
    hashed column stay together, unless ``split_copies`` numbers the copies of each row as one more
    key (:func:`numbered_copies`), which costs two more passes over data that must read the same.
    """
    if split_copies:
        keys = sort_keys(df, column, order, tie_breakers)
        numbered, number = numbered_copies(df)
        return numbered.orderBy(*keys, row_hash(df).asc(), F.col(number).asc()).drop(number)
    keys = sort_keys(df, column, order, tie_breakers)
    if split_ties:
        keys.append(row_hash(df).asc())
    return df.orderBy(*keys)


def numbered_copies(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a column that numbers the copies of each, and that column's name.

    Rows whose fingerprint occurs once get 0. The others are grouped whole, a row with its count, so
    a row that holds most of the data travels as one; runs of copies are cut into pieces, the pieces
    dealt over all tasks and unrolled there. The numbers depend on the rows alone, so a task that
    runs again deals every copy as before.
    """
    bad = [f.name for f in df.schema.fields if has_map(f.dataType)]
    if bad:
        raise ValueError(f"Columns {bad} hold MAP values, which cannot be compared for copies")
    number, names = "__copy__", df.columns
    found = repeats(df, [col(c) for c in names])
    may_repeat = marked([col(c) for c in names], found)
    # grouping takes -0.0 for 0.0; which of them it was comes back from its text
    signs = {f.name: F.when(col(f.name) == 0, col(f.name).cast("string") == "-0.0") for f in df.schema.fields if is_floating(f.dataType)}
    groups = (df.where(may_repeat).groupBy(*[col(c) for c in names], *[s.alias(f"__sign_{names.index(c)}__") for c, s in signs.items()])
              .agg(F.count(F.lit(1)).alias("__run__")))
    back = [F.when(F.col(f"__sign_{i}__"), F.lit(-0.0).cast(df.schema[c].dataType)).otherwise(col(c)).alias(c) if c in signs else col(c)
            for i, c in enumerate(names)]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.greatest(F.lit(1000).cast("long"), (found.select("rows").scalar() / (64 * tasks)).cast("long"))
    pieces = groups.select(*back, "__run__", piece.alias("__piece__")).withColumn(
        "__start__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__run__") - 1, F.col("__piece__"))))
    dealt = pieces.repartition(tasks, row_hash(df), F.col("__start__"))
    last = F.least(F.col("__start__") + F.col("__piece__"), F.col("__run__")) - 1
    copies = dealt.select(*[col(c) for c in names], F.explode(F.sequence(F.col("__start__"), last)).alias(number))
    alone = df.where(~may_repeat).withColumn(number, F.lit(0).cast("long"))
    return alone.unionAll(copies), number


def preview(df: DataFrame, n: int = 100, order_by: str | None = None,
            order: str = "asc", tie_breakers: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows (O2). With ``order_by`` it is a top-k: every task keeps
    its own best ``n`` and only those meet in the final merge, so no full sort."""
    if n < 0:
        raise ValueError("n must be >= 0")
    if order_by is None:
        return df.limit(n)
    return df.orderBy(*sort_keys(df, order_by, order, tie_breakers)).limit(n)
