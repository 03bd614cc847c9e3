"""Write to database tables over JDBC (K4) and copy tables to the lake (K8).

Each task opens its own connection and inserts its partition in batches;
``num_partitions`` bounds the number of concurrent connections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.jdbc import JdbcTarget, read_jdbc
from .files import StoreReport, land_csv
from .tables import check_identifier


def write_jdbc(df: DataFrame, target: JdbcTarget, table: str, mode: str = "overwrite",
               num_partitions: int | None = None, batch_size: int = 10_000) -> DataFrame:
    """Replace (or append to) a database table with the dataset (K4)."""
    check_identifier(table)
    writer = (df.write.format("jdbc").options(**target.options()).option("dbtable", table)
              .option("batchsize", str(batch_size)).mode(mode))
    if num_partitions:
        writer = writer.option("numPartitions", str(num_partitions))
    writer.save()
    return df


def copy_table_to_lake(spark: SparkSession, target: JdbcTarget, table: str, base: str,
                       partition_column: str | None = None, num_partitions: int = 8,
                       predicates: Sequence[str] | None = None, single_task: bool = False, balance: bool = False) -> StoreReport:
    """Database table -> landed CSV under ``<base>/input/`` (K8); no local copy. Slices as in ``read_jdbc``."""
    return land_csv(read_jdbc(spark, target, table, partition_column, num_partitions, predicates=predicates,
                              single_task=single_task, balance=balance), base, table)
