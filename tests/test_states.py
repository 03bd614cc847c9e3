"""Profiles of an appended dataset from the states of its epochs."""

import pytest
from pyspark.sql import functions as F

from lakeprep import operators as ops
from lakeprep.session import scratch_path
from lakeprep.sinks import commits
from lakeprep.sinks.files import land_csv
from lakeprep.streaming import states
from lakeprep.streaming.refresh import read_refreshed, refresh_once

KIND = "a bigint, b double, s string"
PARTS = [[(1, 1.5, "x"), (2, None, "y"), (1, 1.5, "x"), (None, None, None)], [(1, 1.5, "x"), (3, float("nan"), ""), (None, None, None)],
         [(9, -2.0, None)], [(1, 1.5, "x")] * 5]


def land(spark, base, sink, rows):
    df = spark.createDataFrame(rows, KIND)
    land_csv(df, base, "d")
    refresh_once(spark, base, "d", sink, df.schema, "append")


def agrees(spark, sink):
    whole = read_refreshed(spark, sink, "append")
    assert states.appended_profile(spark, sink).collect() == ops.dataset_profile(whole).collect()
    assert sorted(states.appended_null_report(spark, sink).collect()) == sorted(ops.null_report(whole).collect())
    means = {r["column"]: r["mean"] for r in states.appended_means(spark, sink).collect()}
    assert means == pytest.approx(ops.column_means(whole).first().asDict())


def test_states_add_up_to_the_full_profile(spark, monkeypatch):
    monkeypatch.setattr(states, "FOLD", 2)                           # the third epoch folds three states into one
    base, sink = scratch_path(spark, "states"), scratch_path(spark, "states-table")
    with pytest.raises(ValueError, match="nothing refreshed"):
        states.appended_profile(spark, sink)
    for i, rows in enumerate(PARTS):
        land(spark, base, sink, rows)
        agrees(spark, sink)
        spans = states._covering(spark, sink)
        assert spans == [[(0, 0)], [(0, 0), (1, 1)], [(0, 2)], [(0, 2), (3, 3)]][i]
    assert states.update_states(spark, sink) == []


def test_only_new_epochs_are_read(spark):
    """Old epochs may even be gone: their states are enough."""
    base, sink = scratch_path(spark, "states-new"), scratch_path(spark, "states-new-table")
    land(spark, base, sink, PARTS[0])
    assert states.update_states(spark, sink) == [0]
    whole = read_refreshed(spark, sink, "append").unionAll(spark.createDataFrame(PARTS[1], KIND))
    want = ops.dataset_profile(whole.select(*[F.when(~F.isnan("b"), F.col("b")).alias("b") if c == "b" else c for c in whole.columns])).collect()
    land(spark, base, sink, PARTS[1])
    commits.remove(spark, f"{sink}/epoch=0")
    assert states.update_states(spark, sink) == [1]
    assert states.appended_profile(spark, sink).collect() == want


def test_a_state_that_covers_another_counts_once(spark):
    """The fold was committed, the job lost before the folded states were deleted."""
    base, sink = scratch_path(spark, "states-lost"), scratch_path(spark, "states-lost-table")
    for rows in PARTS[:2]:
        land(spark, base, sink, rows)
        states.update_states(spark, sink)
    spans = states._covering(spark, sink)
    states._write(spark, sink, (0, 1), states._summed_cells(states._read(spark, sink, "cells", spans)),
                  states._summed_prints(states._read(spark, sink, "prints", spans)))
    assert states._covering(spark, sink) == [(0, 1)]
    agrees(spark, sink)
