"""Operators against pandas on random small frames with nulls (hypothesis)."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from lakeprep.operators import (drop_duplicates, drop_nulls, duplicate_count, fill_nulls, filter_rows,
                                null_report, sort_rows)

row = st.tuples(st.one_of(st.none(), st.integers(-5, 5)),
                st.one_of(st.none(), st.sampled_from([-1.5, 0.0, 2.25, 3.0])),
                st.one_of(st.none(), st.sampled_from(["a", "b", "c"])))
frames = st.lists(row, min_size=0, max_size=25)
SCHEMA = "i bigint, x double, s string"
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def to_pandas(rows):
    pdf = pd.DataFrame(rows, columns=["i", "x", "s"])
    pdf["i"] = pd.array([r[0] for r in rows], dtype="Int64").astype("float64") if rows else pd.Series(dtype="float64")
    pdf["x"] = pd.Series([r[1] for r in rows], dtype="float64")
    pdf["s"] = pd.Series([r[2] for r in rows], dtype="object")
    return pdf


def canon(records):
    def key(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (1, "")
        return (0, repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(tuple(key(v) for v in r) for r in records)


def spark_records(df):
    return [tuple(r) for r in df.collect()]


def pandas_records(pdf):
    return [tuple(None if (isinstance(v, float) and math.isnan(v)) or v is None else v for v in r)
            for r in pdf.itertuples(index=False, name=None)]


@SETTINGS
@given(frames, st.sampled_from([">", "<", "==", ">=", "<=", "!="]), st.sampled_from(["0", "2", "-1"]))
def test_filter_numeric(spark, rows, op, value):
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows)
    ops = {">": pdf["i"] > float(value), "<": pdf["i"] < float(value), "==": pdf["i"] == float(value),
           ">=": pdf["i"] >= float(value), "<=": pdf["i"] <= float(value), "!=": pdf["i"] != float(value)}
    assert canon(spark_records(filter_rows(df, "i", op, value))) == canon(pandas_records(pdf[ops[op]]))


@SETTINGS
@given(frames, st.sampled_from(["==", "!=", ">"]), st.sampled_from(["a", "b"]))
def test_filter_text(spark, rows, op, value):
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows)
    mask = {"==": pdf["s"] == value, "!=": pdf["s"] != value,
            ">": pdf["s"].map(lambda v: v is not None and v > value).astype(bool)}[op]
    assert canon(spark_records(filter_rows(df, "s", op, value))) == canon(pandas_records(pdf[mask]))


@SETTINGS
@given(frames, st.sampled_from(["asc", "desc"]))
def test_sort_matches_pandas_order_of_keys(spark, rows, order):
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows).sort_values("x", ascending=order == "asc", na_position="last")
    got = [r.x for r in sort_rows(df, "x", order).select("x").collect()]
    want = [None if math.isnan(v) else v for v in pdf["x"]]
    assert got == want


@SETTINGS
@given(frames)
def test_nulls_and_duplicates(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows)
    assert canon(spark_records(drop_nulls(df))) == canon(pandas_records(pdf.dropna()))
    assert canon(spark_records(drop_duplicates(df))) == canon(pandas_records(pdf.drop_duplicates()))
    assert duplicate_count(df).first().duplicate_rows == int(pdf.duplicated().sum())
    want = {k: int(v) for k, v in pdf.isnull().sum().items() if v > 0}
    assert {r["column"]: r["null_count"] for r in null_report(df).collect()} == want


@SETTINGS
@given(frames)
def test_fill_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows)
    want = pdf.fillna(pdf.mean(numeric_only=True)).fillna("Unknown")
    got = fill_nulls(df)
    for name in ("i", "x"):
        g = sorted((v for v in (r[0] for r in got.select(name).collect())), key=lambda v: (v is None, v or 0))
        w = sorted((None if isinstance(v, str) or (isinstance(v, float) and math.isnan(v)) else v
                    for v in want[name]), key=lambda v: (v is None, v or 0))
        assert len(g) == len(w)
        for a, b in zip(g, w):
            assert (a is None and b is None) or a == pytest.approx(b)
    assert sorted(r[0] for r in got.select("s").collect()) == sorted(want["s"])


@SETTINGS
@given(frames)
def test_profile_matches_pandas(spark, rows):
    from lakeprep.operators import dataset_profile
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows)
    p = dataset_profile(df).first()
    assert (p.rows, p.columns, p.null_cells, p.duplicate_rows) == (
        len(pdf), 3, int(pdf.isnull().sum().sum()), int(pdf.duplicated().sum()))


import datetime as dt  # noqa: E402

ts_rows = st.lists(st.tuples(st.integers(0, 9), st.one_of(st.none(), st.sampled_from(
    [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 3)]))), max_size=20)


@SETTINGS
@given(ts_rows, st.sampled_from([">", "<", "==", ">=", "<=", "!="]),
       st.sampled_from(["2024-01-02", "2024-01-02 12:00:00", "2024-01-03T00:00:00"]))
def test_filter_timestamp(spark, rows, op, value):
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz")
    pdf = pd.DataFrame({"k": [r[0] for r in rows], "t": pd.to_datetime(pd.Series([r[1] for r in rows],
                                                                                   dtype="object"))})
    v = pd.Timestamp(value)
    mask = {">": pdf["t"] > v, "<": pdf["t"] < v, "==": pdf["t"] == v, ">=": pdf["t"] >= v,
            "<=": pdf["t"] <= v, "!=": pdf["t"] != v}[op]
    got = sorted(r.k for r in filter_rows(df, "t", op, value).collect())
    assert got == sorted(pdf[mask]["k"].tolist())


@SETTINGS
@given(frames, st.sampled_from(["asc", "desc"]))
def test_sort_text_matches_pandas(spark, rows, order):
    df = spark.createDataFrame(rows, SCHEMA)
    pdf = to_pandas(rows).sort_values("s", ascending=order == "asc", na_position="last")
    got = [r.s for r in sort_rows(df, "s", order).select("s").collect()]
    assert got == [None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in pdf["s"]]


@SETTINGS
@given(frames)
def test_describe_text_matches_pandas(spark, rows):
    from lakeprep.operators import describe_text
    df = spark.createDataFrame(rows, SCHEMA)
    s = to_pandas(rows)["s"].dropna()
    r = describe_text(df, ["s"]).first()
    assert (r["count"], r["unique"]) == (len(s), s.nunique())
    if len(s):
        counts = s.value_counts()
        assert r["freq"] == counts.max()
        assert r["top"] == min(v for v, c in counts.items() if c == counts.max())   # ties: smallest value
    else:
        assert r["top"] is None and r["freq"] is None
