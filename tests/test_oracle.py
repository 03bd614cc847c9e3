"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402

from conftest import SF_SMALL  # noqa: E402


def test_every_query_has_an_oracle():
    # the library's own queries; those of the optional subpackage are held against brute force in tests/llm
    missing = set(entry._QUERIES) - set(entry.oracle_sql())
    assert not missing, missing


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 100 and "o_totalprice" in df.columns


def test_queries_match_duckdb(spark):
    failures = [(n, d) for n, status, d in compare(spark, SF_SMALL, list(entry._QUERIES)) if status == "FAIL"]
    assert not failures, failures


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
WITH_SIDE_EFFECTS = {"csv_roundtrip", "csv_infer_types", "csv_events_values", "json_roundtrip", "json_infer",
                     "parquet_roundtrip", "snapshot_roundtrip", "land_and_refresh",
                     "land_and_append", "store_job", "dedupe_row_change", "lake_to_table", "snapshot_replace", "land_two_datasets",
                     "land_text_tokens", "csv_folder_reordered", "saved_datasets", "snapshot_replace_location",
                     "snapshot_new_columns", "refresh_during_batch", "parquet_lookup", "parquet_rebalanced", "profile_append", "store_job_steps",
                     "publish_versions"}


def test_no_python_in_query_plans(spark):
    for name, fn in entry._QUERIES.items():
        if name in WITH_SIDE_EFFECTS:
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(node in plan for node in PYTHON_NODES), name
