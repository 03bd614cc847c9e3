import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeprep.operators import (compare_columns, dataset_profile, describe_numeric, describe_text,
                                describe_timestamp, drop_duplicates, drop_nulls, duplicate_count,
                                fill_nulls, fill_nulls_with_report, null_counts, null_report, schema_report)
from lakeprep.operators import quantiles as q

from conftest import SF_SMALL


@pytest.fixture()
def nulls_mixed(spark):
    data = [(1.0, 1, "a", True, dt.datetime(2024, 1, 1), None),
            (None, None, None, None, None, None),
            (float("nan"), 3, "c", False, dt.datetime(2024, 1, 3), None),
            (4.0, 4, "d", True, dt.datetime(2024, 1, 4), None)]
    return spark.createDataFrame(data, "x double, i bigint, s string, b boolean, t timestamp_ntz, z double")


def test_drop_nulls_treats_nan_as_missing(nulls_mixed):
    assert drop_nulls(nulls_mixed.drop("z")).count() == 2
    assert drop_nulls(nulls_mixed, subset=["i"]).count() == 3


def test_fill_nulls(nulls_mixed):
    out, report = fill_nulls_with_report(nulls_mixed)
    r = {row.i: row for row in out.collect()}
    assert dict(out.dtypes)["i"] == "double"                # widened like pandas
    assert r[None] is None if None in r else True
    filled = out.where(F.col("s") == "Unknown").first()
    assert filled.x == pytest.approx(2.5) and filled.i == pytest.approx(8 / 3)
    assert out.where(F.isnan("x")).count() == 0            # NaN filled too
    assert set(report.left_null) == {"b", "t", "z"}
    out2 = fill_nulls(nulls_mixed, stringify=True)
    assert dict(out2.dtypes)["b"] == "string" and out2.where(F.col("z") == "Unknown").count() == 4


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "y")], "a int, b string")
    assert drop_duplicates(df).count() == 3
    assert duplicate_count(df).first().duplicate_rows == 2
    m = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    with pytest.raises(ValueError, match="MAP"):
        drop_duplicates(m)


def test_null_report_and_profile(nulls_mixed):
    rep = {r["column"]: r["null_count"] for r in null_report(nulls_mixed).collect()}
    assert rep == {"x": 2, "i": 1, "s": 1, "b": 1, "t": 1, "z": 4}
    assert null_counts(nulls_mixed.select("s")).count() == 1
    prof = dataset_profile(nulls_mixed).first()
    assert (prof.rows, prof.columns, prof.null_cells, prof.duplicate_rows) == (4, 6, 10, 0)
    no_nulls = null_report(nulls_mixed.select("s").na.drop())
    assert no_nulls.count() == 0


def test_profile_is_one_shuffle(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("source", "lang")
    plan = dataset_profile(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_schema_report(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    got = [(r.position, r.column, r.spark_type) for r in schema_report(o).collect()]
    assert got[0] == (1, "o_orderkey", "bigint") and got[4] == (5, "o_orderdate", "timestamp_ntz")


def _pandas_describe(values):
    s = pd.Series(values, dtype="float64")
    return s.describe()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=40))
def test_describe_numeric_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = describe_numeric(df, ["v"]).first()
    want = _pandas_describe(values)
    assert got["count"] == int(want["count"])
    for mine, theirs in [("mean", "mean"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"),
                         ("max", "max"), ("std", "std")]:
        w = want[theirs]
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert got[mine] is None or math.isnan(got[mine])
        else:
            assert got[mine] == pytest.approx(w, rel=1e-9, abs=1e-6)


def test_nan_is_null_in_keys_and_working_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 0.5)], "_k int, _nulls double")
    assert drop_duplicates(df).count() == 2
    assert duplicate_count(df).first()[0] == 1
    assert tuple(dataset_profile(df).first()) == (3, 2, 2, 1)


def test_fill_keeps_decimals(spark):
    df = spark.createDataFrame([("12345678901234567890.12",), (None,)], "d string").selectExpr("cast(d as decimal(38,2)) d")
    out = fill_nulls(df)
    assert out.schema["d"].dataType == df.schema["d"].dataType
    assert {str(r[0]) for r in out.collect()} == {"12345678901234567890.12"}


def test_sort_with_a_map_column(spark):
    from lakeprep.operators import sort_rows
    df = spark.createDataFrame([(2, {"a": 1}), (1, {"b": 2})], "k int, m map<string,int>")
    assert [r["k"] for r in sort_rows(df, "k").collect()] == [1, 2]


def test_quantiles_when_brackets_must_narrow(spark, monkeypatch):
    monkeypatch.setattr(q, "FEW", 3)
    monkeypatch.setattr(q, "ACCURACY", 40)
    rng = np.random.default_rng(11)
    cols = [rng.normal(size=800), np.concatenate([np.zeros(395), np.full(395, 9.0), rng.uniform(0, 9, 10)]), np.arange(800.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols)], "a double, b double, c double")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = q.exact_quantiles(df, [F.col("a"), F.col("b"), F.col("c")], [800] * 3, [0.0, 0.25, 0.495, 0.5, 0.75, 1.0])
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        for values, res in zip(cols, got):
            for p, v in res.items():
                assert v == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_quantiles_outside_their_interval_are_found(spark, monkeypatch):
    """A sketch that is wrong costs another pass, never a wrong value."""
    values = np.random.default_rng(5).normal(size=900)
    df = spark.createDataFrame([(float(x),) for x in values], "a double")
    for few in (5, 20_000):
        monkeypatch.setattr(q, "FEW", few)
        for lie in ((values.max(), values.max()), (values.min(), values.min()), (5.0, 6.0), (-9.0, -8.0), (0.0, 0.0)):
            sketch = q.Sketched(900, float(values.min()), float(values.max()), [lie])
            got = q.exact_quantiles(df, [F.col("a")], [900], [0.0, 0.3, 0.5, 1.0], [sketch])[0]
            for p, v in got.items():
                assert v == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_quantiles_of_decimals_and_of_columns_with_unlike_intervals(spark, monkeypatch):
    df = spark.range(101).selectExpr("cast(id as decimal(12,2)) / 4 as a", "if(id < 3, cast(id as decimal(12,2)) / 4, null) as b", "cast(null as decimal(18,8)) as c")
    cols = [F.col(c).cast("decimal(18,8)") for c in "abc"]
    for few in (20_000, 3):
        monkeypatch.setattr(q, "FEW", few)
        for small in (5_000, 1):
            monkeypatch.setattr(q, "SMALL", small)
            assert q.exact_quantiles(df, cols, [101, 3, 0], [0.5, 1.0]) == [{0.5: 12.5, 1.0: 25.0}, {0.5: 0.25, 1.0: 0.5}, {0.5: None, 1.0: None}]


def test_quantiles_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(q, "FEW", 50)
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=900), np.full(600, 3.0)])    # one hot value holds 40 %
    b = rng.integers(0, 20, size=1500).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = q.exact_quantiles(df, [F.col("a"), F.col("b")], [1500, 1500], [0.0, 0.1, 0.5, 0.9, 1.0])
    for col_vals, res in zip((a, b), got):
        for p, v in res.items():
            assert v == pytest.approx(float(np.quantile(col_vals, p)), rel=1e-12, abs=1e-12)


def test_describe_text_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    r = describe_text(df, ["s"]).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, "a", 2)


def test_describe_timestamp(spark):
    ts = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4), None]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    r = describe_timestamp(df, ["t"]).first()
    s = pd.Series(ts[:3])
    assert r["count"] == 3 and r["min"] == ts[0] and r["max"] == ts[2]
    assert r["mean"] == s.mean().to_pydatetime()
    assert r["p25"] == s.quantile(0.25).to_pydatetime() and r["p50"] == s.quantile(0.5).to_pydatetime()


def test_compare_columns_dispatch(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", False)], "n int, s string, b boolean")
    assert [r["column"] for r in compare_columns(df, "n", "s").collect()] == ["n"]
    assert "top" in compare_columns(df, "s", "b").columns


def test_describe_approximate(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    exact = describe_numeric(li, ["l_quantity"]).first()
    approx = describe_numeric(li, ["l_quantity"], exact=False).first()
    assert approx["count"] == exact["count"] and approx["mean"] == pytest.approx(exact["mean"])
    for p in ("p25", "p50", "p75"):
        assert abs(approx[p] - exact[p]) <= 1.0           # l_quantity is integral 1..50


def test_describe_timestamp_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(q, "FEW", 40)
    monkeypatch.setattr(q, "ACCURACY", 100)
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    r = describe_timestamp(o, ["o_orderdate"]).first()
    s = o.select("o_orderdate").toPandas()["o_orderdate"]
    assert r["count"] == len(s) and r["min"] == s.min().to_pydatetime() and r["max"] == s.max().to_pydatetime()
    for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        want = s.quantile(p)
        assert abs((r[name] - want.to_pydatetime()).total_seconds()) < 1e-5, name
