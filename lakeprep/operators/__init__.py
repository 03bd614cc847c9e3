"""DataFrame -> DataFrame operators."""

from .cleaning import RowChange, counted, drop_duplicates, drop_nulls, fill_nulls, fill_nulls_with_report
from .columns import add_column, convert_type, drop_column, rename_column, select_columns
from .filters import filter_rows
from .ordering import preview, sort_rows
from .profiling import (column_means, compare_columns, dataset_profile, describe_columns,
                        describe_numeric, describe_text, describe_timestamp, duplicate_count,
                        null_counts, null_report, row_count, save_schema_text, schema_report,
                        schema_text)

__all__ = [
    "RowChange", "add_column", "column_means", "compare_columns", "convert_type", "counted", "dataset_profile",
    "describe_columns", "describe_numeric", "describe_text", "describe_timestamp", "drop_column",
    "drop_duplicates", "drop_nulls", "duplicate_count", "fill_nulls", "fill_nulls_with_report",
    "filter_rows", "null_counts", "null_report", "preview", "rename_column", "row_count",
    "save_schema_text", "schema_report", "schema_text", "select_columns", "sort_rows",
]
