"""How many Spark jobs each operator costs (the "one pass" claims of the README)."""

import os
import statistics
import tempfile
import uuid

import pytest

from lakeprep import operators as ops
from lakeprep.sources.text import infer_types, null_tokens_to_null

from conftest import SF_SMALL, task_totals


def jobs(spark, action) -> int:
    """Spark jobs started by ``action``. AQE is switched off while counting:
    it runs every shuffle stage as a job of its own, which would count
    stages rather than passes over the data."""
    group = f"count-{uuid.uuid4().hex[:8]}"
    sc = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sc.setJobGroup(group, group)
    try:
        action()
    finally:
        sc.setJobGroup("", "")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return len(sc.statusTracker().getJobIdsForGroup(group))


@pytest.fixture()
def orders(spark):
    return spark.read.parquet(f"{SF_SMALL}/orders.parquet")


def test_single_job_operators(spark, orders):
    assert jobs(spark, lambda: ops.null_report(orders).collect()) == 1
    assert jobs(spark, lambda: ops.dataset_profile(orders).collect()) == 1
    assert jobs(spark, lambda: ops.duplicate_count(orders).collect()) == 1
    # one pass for both columns, plus the trivial job that materialises the small result table
    assert jobs(spark, lambda: ops.describe_text(orders, ["o_orderstatus", "o_orderpriority"]).collect()) == 2
    text = null_tokens_to_null(orders.selectExpr(*[f"cast({c} as string) as {c}" for c in orders.columns]))
    assert jobs(spark, lambda: infer_types(text)) == 1


def test_fill_is_two_passes(spark, orders):
    # one aggregate for means and null counts, one for the result
    assert jobs(spark, lambda: ops.fill_nulls(orders).collect()) == 2


def scans(spark, table, action) -> float:
    """How many times ``action`` reads ``table``'s rows, by the tasks' input counters."""
    return task_totals(spark, action, "inputRecords") / table.count()


def test_describe_reads_twice_whatever_the_columns(spark):
    """Moments and sketch, then the pass that makes the quartiles exact."""
    lineitem = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    numbers = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    for columns in (numbers[5:6], numbers):
        assert round(scans(spark, lineitem, lambda: ops.describe_numeric(lineitem, columns).collect())) == 2
    assert round(scans(spark, lineitem, lambda: ops.describe_timestamp(lineitem, ["l_shipdate"]).collect())) == 2


def test_describe_reads_three_times_with_many_values(spark, monkeypatch):
    from lakeprep.operators import quantiles
    monkeypatch.setattr(quantiles, "FEW", 40)
    lineitem = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    assert scans(spark, lineitem, lambda: ops.describe_numeric(lineitem, ["l_orderkey", "l_extendedprice"]).collect()) < 3.2


def test_describe_counts_many_values_in_one_pass(spark, monkeypatch):
    """Moments and sketch, one counting pass, and the counted values (some hundredths of so small a table) again."""
    from lakeprep.operators import quantiles
    monkeypatch.setattr(quantiles, "FEW", 40)
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) as a", "id % 5 as b")
    path = os.path.join(tempfile.mkdtemp(prefix="lakeprep-t-"), "t")
    df.write.parquet(path)
    table = spark.read.parquet(path)
    assert scans(spark, table, lambda: ops.describe_numeric(table, ["a", "b"]).collect()) < 2.5
    assert [r["p50"] for r in ops.describe_numeric(table, ["a", "b"]).collect()] == [statistics.median(x) for x in zip(*table.collect())]
