"""Database tables over JDBC.

Credentials are arguments (or come from the caller's environment); none are
stored here. Table names are validated before they reach any SQL text.
A partitioned read splits the key range into ``num_partitions`` parallel
queries; the bounds come from one ``min/max`` query pushed to the database.
With ``balance=True`` they come from counts of key ranges, which the database
groups: ranges that hold too many rows are counted again in finer ones, so a
hot range gets slices of its own (``balanced_ranges``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sinks.tables import check_identifier


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    user: str | None = None
    password: str | None = None
    driver: str | None = None

    def options(self) -> dict[str, str]:
        out = {"url": self.url}
        if self.user is not None:
            out["user"] = self.user
        if self.password is not None:
            out["password"] = self.password
        if self.driver is not None:
            out["driver"] = self.driver
        return out


def _query(spark: SparkSession, target: JdbcTarget, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**target.options()).option("query", sql).load()


def table_bounds(spark: SparkSession, target: JdbcTarget, table: str, column: str) -> tuple:
    check_identifier(table)
    check_identifier(column, max_parts=1)
    row = _query(spark, target, f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}").first()
    return row["lo"], row["hi"]


#: Key ranges per slice that the database counts at once, and how often a crowded range is counted in finer ones.
RANGES_A_SLICE, COUNT_ROUNDS = 16, 12


def balanced_ranges(count: Callable[[int, int, int], dict[int, int]], lo: int, hi: int, slices: int) -> list[tuple[int, int, int]]:
    """Half-open ranges ``(first key, end, rows)`` that cover ``lo`` to ``hi`` with about equal rows.

    ``count(a, b, width)`` gives the rows of the keys from ``a`` to before ``b`` by ``(key - a) // width``,
    empty ranges left out. Ranges of more than an eighth of a slice are counted again in finer ones until
    they are light or a single key; then neighbours are joined. A slice holds at most 9/8 of an equal
    share, or one key.
    """
    if slices < 1:
        raise ValueError("slices must be at least 1")
    fine: list[tuple[int, int, int]] = []
    open_ranges, most = [(lo, hi + 1)], None
    for _ in range(COUNT_ROUNDS):
        crowded = []
        for a, b in open_ranges:
            width = max(1, -(-(b - a) // (RANGES_A_SLICE * slices)))
            found = count(a, b, width)
            if most is None:
                most = max(1, sum(found.values()) // (8 * slices))
            for k, rows in sorted(found.items()):
                part = (a + k * width, min(b, a + (k + 1) * width))
                if rows > most and part[1] - part[0] > 1:
                    crowded.append((*part, rows))
                else:
                    fine.append((*part, rows))
        if not crowded:
            break
        open_ranges = [(a, b) for a, b, _ in crowded]
    else:
        fine += crowded                                             # no finer: they stay as they are
    fine.sort()
    share = max(1, -(-sum(rows for _, _, rows in fine) // slices))
    out: list[list[int]] = []
    for a, b, rows in fine:
        if out and out[-1][2] + rows <= share + share // 8:
            out[-1][1], out[-1][2] = b, out[-1][2] + rows
        else:
            out.append([a, b, rows])
    return [(a, b, rows) for a, b, rows in out]


def range_predicates(column: str, ranges: Sequence[tuple[int, int, int]]) -> list[str]:
    """Conditions that put every row into one slice: the first takes nulls and all smaller keys, the last all larger."""
    check_identifier(column, max_parts=1)
    starts = [int(a) for a, _, _ in ranges][1:]
    if not starts:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(starts, starts[1:])]
    return [f"{column} < {starts[0]} OR {column} IS NULL", *middle, f"{column} >= {starts[-1]}"]


def balanced_predicates(spark: SparkSession, target: JdbcTarget, table: str, column: str, slices: int) -> list[str]:
    """Predicates for ``read_jdbc`` from counts that the database takes; ``column`` holds whole numbers."""
    lo, hi = table_bounds(spark, target, table, column)
    if lo is None:
        return ["1 = 1"]
    if int(lo) != lo or int(hi) != hi:
        raise ValueError(f"balance=True needs whole numbers in {column!r}")

    def count(a: int, b: int, width: int) -> dict[int, int]:
        rows = _query(spark, target, count_sql(table, column, a, b, width)).collect()      # slices * RANGES_A_SLICE rows
        return {int(r[0]): int(r[1]) for r in rows}

    return range_predicates(column, balanced_ranges(count, int(lo), int(hi), slices))


def count_sql(table: str, column: str, a: int, b: int, width: int) -> str:
    """Rows per key range, grouped where the table is."""
    check_identifier(table)
    check_identifier(column, max_parts=1)
    bucket = f"FLOOR(({column} - ({int(a)})) / {int(width)})"
    return (f"SELECT bucket, COUNT(*) AS n FROM (SELECT {bucket} AS bucket FROM {table} "
            f"WHERE {column} >= {int(a)} AND {column} < {int(b)}) keys GROUP BY bucket")


def read_jdbc(spark: SparkSession, target: JdbcTarget, table: str, partition_column: str | None = None,
              num_partitions: int = 8, fetch_size: int = 10_000, predicates: Sequence[str] | None = None,
              single_task: bool = False, balance: bool = False) -> DataFrame:
    """Read a whole table (S6) in parallel slices.

    Slices are ``num_partitions`` equal ranges of a numeric or date ``partition_column``; with ``balance``,
    about as many ranges of equal rows, by counts (whole-number keys); or one per entry of ``predicates``
    (conditions that split the rows). Reading through
    one connection into one task must be asked for with ``single_task=True``.
    """
    check_identifier(table)
    if sum((partition_column is not None, predicates is not None, bool(single_task))) != 1:
        raise ValueError("give one of partition_column=, predicates= or single_task=True")
    if balance:
        if partition_column is None:
            raise ValueError("balance=True needs partition_column=")
        predicates = balanced_predicates(spark, target, table, partition_column, num_partitions)
    if predicates is not None:
        properties = {k: v for k, v in target.options().items() if k != "url"} | {"fetchsize": str(fetch_size)}
        return spark.read.jdbc(target.url, table, predicates=list(predicates), properties=properties)
    reader = (spark.read.format("jdbc").options(**target.options())
              .option("dbtable", table).option("fetchsize", str(fetch_size)))
    if partition_column:
        lo, hi = table_bounds(spark, target, table, partition_column)
        if lo is not None and hi is not None and lo != hi:
            reader = (reader.option("partitionColumn", partition_column)
                      .option("lowerBound", str(lo)).option("upperBound", str(hi))
                      .option("numPartitions", str(num_partitions)))
    return reader.load()


@dataclass(frozen=True)
class Lookup:
    table: str
    exists: bool
    rows: int | None


def lookup_table(spark: SparkSession, target: JdbcTarget, table: str) -> Lookup:
    """Does the table exist, and how many rows (S7). The count runs in the database."""
    check_identifier(table)
    try:
        row = _query(spark, target, f"SELECT COUNT(*) AS n FROM {table}").first()
    except Exception as e:  # noqa: BLE001 - drivers word "missing table" differently
        text = str(e).lower()
        if any(k in text for k in ("not found", "does not exist", "doesn't exist", "no such table", "unknown table")):
            return Lookup(table, False, None)
        raise
    return Lookup(table, True, int(row[0]))
