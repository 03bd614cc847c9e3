"""Duplicates by fingerprints: equal results to whole-row grouping, and how much they move."""

import pytest
from pyspark.sql import functions as F

from lakeprep import operators as ops
from lakeprep.operators import fingerprints

from conftest import task_totals


def table(spark, copies=True):
    rows = [(i, f"text {i}", float(i)) for i in range(60)] + [(None, "a", None), ("".strip() or None, None, float("nan")), (None, None, None)]
    if copies:
        rows += [(1, "text 1", 1.0)] * 5 + [(None, "a", None), (2, "text 2", float("nan")), (2, "text 2", None), (0, "text 0", -0.0)]
    return spark.createDataFrame(rows, "a int, b string, c double").repartition(4, "b")


def rows(df):
    return sorted(map(str, df.collect()))


def same_results(df):
    for subset in (None, ["a"], ["b", "c"]):
        narrow, wide = ops.drop_duplicates(df, subset), ops.drop_duplicates(df, subset, wide=True)
        if subset is None:
            assert rows(narrow) == rows(wide)
        else:
            assert rows(narrow.select(subset)) == rows(wide.select(subset))
    assert ops.duplicate_count(df).collect() == ops.duplicate_count(df, wide=True).collect()
    assert ops.dataset_profile(df).collect() == ops.dataset_profile(df, wide=True).collect()
    text = df.select("b", F.col("a").cast("string").alias("a"), F.lit(None).cast("string").alias("none"))
    assert rows(ops.describe_text(text, text.columns)) == rows(ops.describe_text(text, text.columns, wide=True))


@pytest.mark.parametrize("bits", [1 << 22, 64])
def test_wide_forms_equal_the_others(spark, monkeypatch, bits):
    monkeypatch.setattr(fingerprints, "BITS", bits)                  # 64: nearly every row seems to have a copy
    for copies in (True, False):
        same_results(table(spark, copies))
    same_results(table(spark).limit(0))


def test_equal_fingerprints_of_different_rows(spark, monkeypatch):
    honest = fingerprints.fingerprint
    monkeypatch.setattr(fingerprints, "fingerprint", lambda values: [F.pmod(honest(values)[0], F.lit(5)), F.lit(0).cast("long")])
    same_results(table(spark))


def shuffled(spark, action) -> int:
    return task_totals(spark, action, "shuffleWriteBytes")


def test_shuffle_does_not_grow_with_the_width_of_rows(spark):
    def wide(times):
        return spark.range(3000).select("id", F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(times)]).alias("text"))
    for form in (lambda df: ops.duplicate_count(df, wide=True), lambda df: ops.drop_duplicates(df, wide=True),
                 lambda df: ops.dataset_profile(df, wide=True), lambda df: ops.describe_text(df, ["text"], wide=True)):
        narrow, broad = (shuffled(spark, lambda n=n: form(wide(n)).write.format("noop").mode("overwrite").save()) for n in (1, 40))
        assert broad < 1.1 * narrow
    assert shuffled(spark, lambda: ops.duplicate_count(wide(40)).collect()) > 5 * shuffled(spark, lambda: ops.duplicate_count(wide(40), wide=True).collect())
