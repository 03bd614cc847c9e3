"""

Every query reads the driver's parquet tables under ``sf_dir`` (whole
tables, no row subsets) and runs the package's operators on them. Nulls and
duplicates do not occur in those tables, so where an operator is about
missing values the query injects nulls with a value condition, written the
same way on both sides.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprep import operators as ops
from lakeprep.functions.identifiers import clean_identifier, folder_name, job_identifier, split_lake_path
from lakeprep.functions.rules import classify, rule
from lakeprep.plans.jobs import parquet_to_table, run_store_job
from lakeprep.plans.recipe import Recipe
from lakeprep.session import scratch_path
from lakeprep.small import small_table
from lakeprep.sinks.files import land_csv, store_parquet, write_csv, write_json
from lakeprep.sinks.published import publish, read_published, versions
from lakeprep.sinks.tables import save_snapshot, store_table
from lakeprep.sources.lake import list_saved, load_saved, read_table
from lakeprep.sources.text import read_csv, read_json
from lakeprep.streaming.refresh import read_refreshed, refresh_once
from lakeprep.streaming.states import appended_profile, update_states

try:
    import corpus_pipeline
    from lakeprep.llm import queries as llm_queries
except ImportError as missing:                  # the subpackage and the libraries only it needs are optional
    if missing.name not in ("corpus_pipeline", "lakeprep.llm", "lakeprep.llm.queries"):
        warnings.warn(f"training-data operators are left out: {missing}", stacklevel=2)
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), places).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# --------------------------------------------------------------------------- flagship

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-0 slice: lake Parquet -> filter -> descending sort -> 100-row preview."""
    orders = _t(spark, sf_dir, "orders")
    big = ops.filter_rows(orders, "o_totalprice", ">", "1000")
    return ops.preview(big, 100, order_by="o_totalprice", order="desc", tie_breakers=["o_orderkey"])


def entry(spark: SparkSession) -> DataFrame:
    return flagship(spark, SMOKE_DIR)


# --------------------------------------------------------------------------- filters T1-T5

def filter_gt(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "lineitem"), "l_quantity", ">", "45")


def filter_lt(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "lt", "2000")


def filter_eq(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "lineitem"), "l_linenumber", "==", "3")


def filter_gte(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "lineitem"), "l_discount", ">=", "0.09")


def filter_lte(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "lineitem"), "l_tax", "lte", "0.02")


def _orders_status_nulls(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))


def filter_ne_nulls(spark, sf_dir):
    return ops.filter_rows(_orders_status_nulls(spark, sf_dir), "o_orderstatus", "!=", "O")


def filter_text(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "orders"), "o_orderpriority", ">", "3-MEDIUM")


def filter_timestamp(spark, sf_dir):
    return ops.filter_rows(_t(spark, sf_dir, "orders"), "o_orderdate", ">=", "1998-01-01")


def filter_boolean(spark, sf_dir):
    o = ops.add_column(_t(spark, sf_dir, "orders"), "is_big", "o_totalprice > 200000")
    return ops.filter_rows(o, "is_big", "=", "1")


# --------------------------------------------------------------------------- sort O1/O2

def sort_asc_top(spark, sf_dir):
    return ops.preview(_t(spark, sf_dir, "orders"), 100, order_by="o_totalprice", order="asc",
                       tie_breakers=["o_orderkey"])


def _lineitem_price_nulls(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.withColumn("l_extendedprice",
                         F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_extendedprice")))


def sort_desc_nulls_top(spark, sf_dir):
    return ops.preview(_lineitem_price_nulls(spark, sf_dir), 100, order_by="l_extendedprice",
                       order="descending", tie_breakers=["l_orderkey", "l_linenumber"])


def sort_asc_nulls_top(spark, sf_dir):
    return ops.preview(_lineitem_price_nulls(spark, sf_dir), 100, order_by="l_extendedprice",
                       order="asc", tie_breakers=["l_orderkey", "l_linenumber"])


def sort_full(spark, sf_dir):
    return ops.sort_rows(_t(spark, sf_dir, "orders"), "o_orderdate", "desc", tie_breakers=["o_orderkey"])


# --------------------------------------------------------------------------- columns P1 T6-T9

def select_columns(spark, sf_dir):
    return ops.select_columns(_t(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_retailprice"])


def rename_column(spark, sf_dir):
    return ops.rename_column(_t(spark, sf_dir, "customer"), "c_acctbal", "account_balance")


def drop_column(spark, sf_dir):
    return ops.drop_column(_t(spark, sf_dir, "customer"), "c_mktsegment")


def add_column(spark, sf_dir):
    return ops.add_column(_t(spark, sf_dir, "lineitem"), "revenue", "l_extendedprice * (1 - l_discount)")


def add_column_case(spark, sf_dir):
    return ops.add_column(_t(spark, sf_dir, "lineitem"), "size_class",
                          "CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END")


def convert_to_long(spark, sf_dir):
    li = ops.select_columns(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return ops.convert_type(li, "l_extendedprice", "int64")


def convert_to_string(spark, sf_dir):
    o = ops.select_columns(_t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])
    return ops.convert_type(o, "o_custkey", "str")


def convert_to_timestamp(spark, sf_dir):
    ev = ops.select_columns(_t(spark, sf_dir, "events"), ["event_id", "ts"])
    as_text = ops.convert_type(ev, "ts", "string")
    return ops.convert_type(as_text, "ts", "timestamp_ntz")


def convert_try(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("amount"))
    return ops.convert_type(o, "amount", "float64", strict=False)


# --------------------------------------------------------------------------- cleaning C1-C3

def _lineitem_with_nulls(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linestatus") == "F", None).otherwise(F.col("l_partkey")).alias("l_partkey"),
        F.when(F.col("l_quantity") < 5, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_extendedprice")


def drop_nulls(spark, sf_dir):
    return ops.drop_nulls(_lineitem_with_nulls(spark, sf_dir))


def fill_nulls(spark, sf_dir):
    return _round_doubles(ops.fill_nulls(_lineitem_with_nulls(spark, sf_dir)))


def _doc_source_lang(spark, sf_dir):
    return ops.select_columns(_t(spark, sf_dir, "documents"), ["source", "lang"])


def drop_duplicates(spark, sf_dir):
    return ops.drop_duplicates(_doc_source_lang(spark, sf_dir))


def duplicate_count(spark, sf_dir):
    return ops.duplicate_count(_doc_source_lang(spark, sf_dir))


# --------------------------------------------------------------------------- profiling A1-A9

def _orders_with_nulls(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate", "o_orderpriority")


def null_report(spark, sf_dir):
    return ops.null_report(_orders_with_nulls(spark, sf_dir))


def null_counts(spark, sf_dir):
    return ops.null_counts(_orders_with_nulls(spark, sf_dir))


def fill_nulls_stringify(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return ops.fill_nulls(o, stringify=True)


def compare_text(spark, sf_dir):
    return ops.compare_columns(_t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def dataset_profile(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(
        "source", F.when(F.col("lang") == "de", None).otherwise(F.col("lang")).alias("lang"))
    return ops.dataset_profile(d)


def schema_report(spark, sf_dir):
    return ops.schema_report(_t(spark, sf_dir, "lineitem"))


def row_count(spark, sf_dir):
    return ops.row_count(_t(spark, sf_dir, "lineitem"))


def column_means(spark, sf_dir):
    return _round_doubles(ops.column_means(_t(spark, sf_dir, "part")))


def describe_numeric(spark, sf_dir):
    return _round_doubles(ops.describe_numeric(_t(spark, sf_dir, "lineitem"),
                                               ["l_quantity", "l_extendedprice", "l_discount"]))


def describe_text(spark, sf_dir):
    return ops.describe_text(_t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


def describe_timestamp(spark, sf_dir):
    return ops.describe_timestamp(_t(spark, sf_dir, "orders"), ["o_orderdate"])


def compare_columns(spark, sf_dir):
    return _round_doubles(ops.compare_columns(_t(spark, sf_dir, "lineitem"), "l_tax", "l_returnflag"))



# --------------------------------------------------------------------------- sources and sinks
# Each round trip writes the whole table to a fresh folder under the shared
# scratch root (spark.checkpoint.dir), then reads it back with our readers.

def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv-roundtrip")
    write_csv(_t(spark, sf_dir, "orders"), path)
    return read_csv(spark, path)


def csv_infer_types(spark, sf_dir):
    path = scratch_path(spark, "csv-infer")
    write_csv(_t(spark, sf_dir, "events"), path)
    return ops.schema_report(read_csv(spark, path))


def csv_events_values(spark, sf_dir):
    path = scratch_path(spark, "csv-events")
    write_csv(_t(spark, sf_dir, "events"), path)
    return read_csv(spark, path)


def csv_folder_reordered(spark, sf_dir):
    """Two exports of one table in one folder, the second with its columns in another order."""
    events, path = _t(spark, sf_dir, "events"), scratch_path(spark, "csv-orders")
    early = F.col("event_id") % 2 == 0
    write_csv(events.where(early), path)
    write_csv(events.where(~early).select(*reversed(events.columns)), path, mode="append")
    return read_csv(spark, path, by_name=True)


def saved_datasets(spark, sf_dir):
    """Saved datasets by name, with the rows that each holds."""
    mark = "_" + uuid.uuid4().hex[:12]
    for name in ("customer", "orders"):
        save_snapshot(_t(spark, sf_dir, name), name + mark)
    saved = [r["name"] for r in list_saved(spark).where(F.col("name").endswith(mark)).orderBy("name").collect()]
    counts = [load_saved(spark, n).agg(F.lit(n.removesuffix(mark)).alias("dataset"), F.count("*").alias("rows")) for n in saved]
    return counts[0].unionByName(counts[1])


def json_roundtrip(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    path = scratch_path(spark, "json-roundtrip")
    write_json(events, path)
    return read_json(spark, path, schema=events.schema)


def json_infer(spark, sf_dir):
    path = scratch_path(spark, "json-infer")
    write_json(_t(spark, sf_dir, "customer"), path)
    return read_json(spark, path)


def parquet_roundtrip(spark, sf_dir):
    base = scratch_path(spark, "lake")
    report = store_parquet(_t(spark, sf_dir, "lineitem"), base, "lineitem")
    return spark.read.parquet(report.location)


def snapshot_roundtrip(spark, sf_dir):
    name = "snapshot_" + scratch_path(spark, "x").rsplit("-", 1)[-1]
    save_snapshot(_t(spark, sf_dir, "customer"), name, location=scratch_path(spark, "snapshot"))
    return load_saved(spark, name)


def land_and_refresh(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    base = scratch_path(spark, "landing")
    land_csv(orders, base, "orders")
    return refresh_once(spark, base, "orders", f"{base}/tables/orders", schema=orders.schema,
                        checkpoint=f"{base}/checkpoints/orders")


def land_and_append(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    base = scratch_path(spark, "landing")
    land_csv(orders.where(F.col("o_orderstatus") == "F"), base, "orders")
    land_csv(orders.where(F.col("o_orderstatus") != "F"), base, "orders")
    return refresh_once(spark, base, "orders", f"{base}/tables/orders", schema=orders.schema,
                        mode="append", checkpoint=f"{base}/checkpoints/orders")


# --------------------------------------------------------------------------- functions F1-F5

def classify_rules(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", classify("text").alias("label"))


LANGUAGE_RULES = (
    rule("english", ["the "], none_of=[" le ", " der "]),
    rule("french", [" le ", " les "]),
    rule("spanish", [" el ", " los "]),
    rule("german", [" der ", " die "]),
)


def classify_rules_custom(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", classify("text", LANGUAGE_RULES, default="other").alias("label"))


def clean_identifier_q(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", clean_identifier("url").alias("table_name"),
                    job_identifier("url").alias("job_name"), folder_name("url").alias("folder"))


def split_lake_path_q(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    parts = split_lake_path("url")
    return p.select("page_id", parts["full"].alias("full_path"), parts["base"].alias("base_path"),
                    parts["name"].alias("name"))


def clean_identifier_docs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", clean_identifier(F.concat_ws(" ", "source", "lang", "doc_id")).alias("table_name"))


# --------------------------------------------------------------------------- recipes and jobs R1 R4

RECIPE = Recipe([
    ("filter", {"column": "l_extendedprice", "operator": ">", "value": "50000"}),
    ("fill_nulls", {}),
    ("select", {"columns": ["l_returnflag", "l_quantity"]}),
    ("drop_duplicates", {}),
    ("preview", {"n": 100, "order_by": "l_quantity", "order": "desc", "tie_breakers": ["l_returnflag"]}),
])


def recipe_chain(spark, sf_dir):
    return _round_doubles(RECIPE.apply(_lineitem_with_nulls(spark, sf_dir)))


def recipe_actions(spark, sf_dir):
    r = Recipe.from_actions(["ACTION:FILTER:o_orderdate:>=:1997-06-01 00:00:00", "ACTION:RENAME:o_totalprice:price",
                             "ACTION:DROP_COLUMN:o_custkey", "ACTION:REMOVE_DUPLICATES"])
    return r.apply(_t(spark, sf_dir, "orders"))


def store_job(spark, sf_dir):
    base = scratch_path(spark, "job")
    recipe = Recipe([("filter", {"column": "l_shipdate", "operator": "<", "value": "1995-06-01"}),
                     ("rename", {"old_name": "l_extendedprice", "new_name": "price"}),
                     ("drop_column", {"column": "l_tax"})])
    result = run_store_job(spark, lambda s: _t(s, sf_dir, "lineitem"),
                           lambda df: store_parquet(df, base, "lineitem_early"), recipe)
    if result.stored is None:
        raise RuntimeError(result.report.collect())
    return spark.read.parquet(result.stored.location)

def dedupe_row_change(spark, sf_dir):
    change = ops.RowChange(_doc_source_lang(spark, sf_dir), ops.drop_duplicates)
    change.output.write.format("noop").mode("overwrite").save()     # fills ``after``; ``before`` is a count of its own
    return small_table(spark, [(change.before, change.after)], "rows_before bigint, rows_after bigint")


def lake_to_table(spark, sf_dir):
    name = "lake_" + scratch_path(spark, "x").rsplit("-", 1)[-1]
    result = parquet_to_table(spark, f"{sf_dir.rstrip('/')}/part.parquet",
                              ["p_partkey", "p_brand", "p_size"], name, provider="parquet",
                              location=scratch_path(spark, "lake-table"))
    if result.stored is None:
        raise RuntimeError(result.report.collect())
    return spark.table(name)


# --------------------------------------------------------------------------- whole rows, replace in place

def _documents_twice(spark, sf_dir):
    """Documents and themselves again, with a NaN or null measure for part of the rows."""
    d = _t(spark, sf_dir, "documents")
    measure = F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))
    nulls = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars").cast("double"))
    return d.withColumn("measure", measure).unionByName(d.withColumn("measure", nulls))


def drop_duplicates_full(spark, sf_dir):
    return ops.drop_duplicates(_documents_twice(spark, sf_dir))


def duplicate_count_full(spark, sf_dir):
    return ops.duplicate_count(_documents_twice(spark, sf_dir))


def profile_full(spark, sf_dir):
    return ops.dataset_profile(_documents_twice(spark, sf_dir))


def _lineitem_crowded(spark, sf_dir):
    """Seven of eight rows are one row, the others differ."""
    rare = "l_orderkey % 8 = 0"
    return _t(spark, sf_dir, "lineitem").selectExpr(f"if({rare}, l_quantity, 25.0D) AS quantity", f"if({rare}, l_orderkey, 0L) AS orderkey")


def store_job_steps(spark, sf_dir):
    """Rows that each step of a stored recipe left."""
    recipe = Recipe.from_actions(["FILTER:l_quantity:>:25", "REMOVE_NULLS:fill", "REMOVE_DUPLICATES"])
    base = scratch_path(spark, "steps")
    result = run_store_job(spark, lambda s: _lineitem_with_nulls(s, sf_dir).drop("l_extendedprice"),
                           lambda df: store_parquet(df, base, "steps"), recipe, count_steps=True)
    return result.report.select("step", "status", "rows")


def profile_append(spark, sf_dir):
    """Documents land in two parts, the second with copies of the first; each profile reads new epochs only."""
    docs = _t(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    base, sink = scratch_path(spark, "append"), scratch_path(spark, "append-table")
    for part in (docs, docs.where(F.col("source") == docs.select(F.min("source")).scalar())):
        land_csv(part, base, "docs")
        refresh_once(spark, base, "docs", sink, docs.schema, "append")
        update_states(spark, sink)
    return appended_profile(spark, sink)


def sort_copies(spark, sf_dir):
    return ops.sort_rows(_lineitem_crowded(spark, sf_dir), "quantity", split_copies=True)


def parquet_lookup(spark, sf_dir):
    """One part's items from a store with Bloom filters, one order's from its clustering."""
    report = store_parquet(_t(spark, sf_dir, "lineitem"), scratch_path(spark, "lookup"), "lineitem", cluster_by=["l_orderkey"], lookup=["l_partkey"])
    stored = spark.read.parquet(report.location)
    return ops.filter_rows(stored, "l_partkey", "=", "7").unionByName(ops.filter_rows(stored, "l_orderkey", "=", "7"))


def parquet_rebalanced(spark, sf_dir):
    report = store_parquet(_t(spark, sf_dir, "lineitem"), scratch_path(spark, "even"), "lineitem", partition_by=["l_returnflag"], rebalance=True)
    return spark.read.parquet(report.location)


def drop_duplicates_wide(spark, sf_dir):
    return ops.drop_duplicates(_documents_twice(spark, sf_dir), wide=True)


def duplicate_count_wide(spark, sf_dir):
    return ops.duplicate_count(_documents_twice(spark, sf_dir), wide=True)


def profile_wide(spark, sf_dir):
    return ops.dataset_profile(_documents_twice(spark, sf_dir), wide=True)


def describe_text_wide(spark, sf_dir):
    return ops.describe_text(_t(spark, sf_dir, "documents"), ["text", "lang"], wide=True)


def describe_numeric_all(spark, sf_dir):
    return _round_doubles(ops.describe_numeric(_t(spark, sf_dir, "lineitem"), _LINEITEM_NUMBERS))


def fill_nulls_decimal(spark, sf_dir):
    price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("decimal(20,2)"))
    return ops.fill_nulls(_t(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")))


def land_two_datasets(spark, sf_dir):
    """Two datasets under one base whose names begin alike; one is refreshed."""
    base, orders = scratch_path(spark, "two-landings"), _t(spark, sf_dir, "orders")
    land_csv(orders.where("o_orderstatus = 'F'"), base, "orders")
    land_csv(orders.where("o_orderstatus = 'O'"), base, "orders-eu")
    return refresh_once(spark, base, "orders", f"{base}/table", orders.schema, "replace")


def _orders_with_tokens(spark, sf_dir):
    token = (F.when(F.col("o_orderkey") % 5 == 0, F.lit("NA")).when(F.col("o_orderkey") % 5 == 1, F.lit("None"))
             .when(F.col("o_orderkey") % 5 == 2, F.lit("")).when(F.col("o_orderkey") % 5 == 3, F.lit("\\N")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", token.alias("word"))


def land_text_tokens(spark, sf_dir):
    base, df = scratch_path(spark, "token-landings"), _orders_with_tokens(spark, sf_dir)
    land_csv(df, base, "words")
    return refresh_once(spark, base, "words", f"{base}/table", df.schema, "append")


def snapshot_replace(spark, sf_dir):
    name = "orders_" + uuid.uuid4().hex[:12]
    save_snapshot(_t(spark, sf_dir, "orders"), name)
    save_snapshot(ops.filter_rows(load_saved(spark, name), "o_orderstatus", "=", "F"), name)
    return load_saved(spark, name)


def snapshot_replace_location(spark, sf_dir):
    """A snapshot replaced in place, read from the folders its two reports name, and by name."""
    name, place = "located_" + uuid.uuid4().hex[:12], scratch_path(spark, "located")
    orders = _t(spark, sf_dir, "orders")
    save_snapshot(orders, name, location=place)
    report = save_snapshot(ops.filter_rows(load_saved(spark, name), "o_orderstatus", "=", "F"), name, location=place)
    said = spark.read.parquet(report.location)
    return said.withColumn("seen", F.lit("location")).unionByName(load_saved(spark, name).withColumn("seen", F.lit("name")))


def publish_versions(spark, sf_dir):
    """A published dataset replaced twice, in three formats; the newest version and the one before it."""
    events, root = _t(spark, sf_dir, "events"), scratch_path(spark, "published")
    publish(events, root, "json")
    publish(ops.filter_rows(events, "value", ">", "50"), root, "csv", keep=1)
    publish(ops.filter_rows(read_published(spark, root), "value", ">", "80"), root, "parquet", keep=1)
    before = read_published(spark, root, versions(spark, root)[0])
    return read_published(spark, root).withColumn("seen", F.lit("now")).unionByName(before.withColumn("seen", F.lit("before")))


def snapshot_new_columns(spark, sf_dir):
    """A partitioned table replaced by one with other columns, then by more rows of these."""
    name = "reshaped_" + uuid.uuid4().hex[:12]
    orders = _t(spark, sf_dir, "orders")
    store_table(orders, name, provider="parquet", partition_by=["o_orderstatus"])
    store_table(ops.drop_column(spark.table(name), "o_totalprice"), name, provider="parquet", partition_by=["o_orderpriority"])
    store_table(ops.filter_rows(spark.table(name), "o_orderstatus", "!=", "P"), name, provider="parquet", partition_by=["o_orderpriority"])
    return spark.table(name).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


def refresh_during_batch(spark, sf_dir):
    """What readers see while an epoch is written, after it was refused, and after the next one."""
    orders = _t(spark, sf_dir, "orders")
    base, table, seen = scratch_path(spark, "during"), scratch_path(spark, "during-table"), scratch_path(spark, "during-seen")
    land_csv(orders, base, "orders")
    refresh_once(spark, base, "orders", table, orders.schema)
    land_csv(ops.filter_rows(orders, "o_orderstatus", "=", "F"), base, "orders")

    def refuse(rows, epoch):
        read_refreshed(spark, table).withColumn("seen", F.lit("during")).write.mode("overwrite").parquet(f"{seen}/during")
        raise ValueError("not this one")

    try:
        refresh_once(spark, base, "orders", table, orders.schema, check=refuse)
    except Exception as refused:  # noqa: BLE001 - the stream's own error class wraps it
        if "not this one" not in str(refused):
            raise
    read_refreshed(spark, table).withColumn("seen", F.lit("refused")).write.parquet(f"{seen}/refused")
    after = refresh_once(spark, base, "orders", table, orders.schema).withColumn("seen", F.lit("after"))
    return spark.read.parquet(f"{seen}/during", f"{seen}/refused").unionByName(after)


# --------------------------------------------------------------------------- registry

_LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "filter_gt": filter_gt, "filter_lt": filter_lt, "filter_eq": filter_eq,
    "filter_gte": filter_gte, "filter_lte": filter_lte, "filter_ne_nulls": filter_ne_nulls,
    "filter_text": filter_text, "filter_timestamp": filter_timestamp, "filter_boolean": filter_boolean,
    "sort_asc_top": sort_asc_top, "sort_desc_nulls_top": sort_desc_nulls_top,
    "sort_asc_nulls_top": sort_asc_nulls_top, "sort_full": sort_full,
    "select_columns": select_columns, "rename_column": rename_column, "drop_column": drop_column,
    "add_column": add_column, "add_column_case": add_column_case,
    "convert_to_long": convert_to_long, "convert_to_string": convert_to_string,
    "convert_to_timestamp": convert_to_timestamp, "convert_try": convert_try,
    "drop_nulls": drop_nulls, "fill_nulls": fill_nulls,
    "drop_duplicates": drop_duplicates, "duplicate_count": duplicate_count,
    "null_report": null_report, "null_counts": null_counts, "fill_nulls_stringify": fill_nulls_stringify,
    "compare_text": compare_text, "dataset_profile": dataset_profile, "schema_report": schema_report,
    "row_count": row_count, "column_means": column_means,
    "describe_numeric": describe_numeric, "describe_text": describe_text,
    "describe_timestamp": describe_timestamp, "compare_columns": compare_columns,
    "csv_roundtrip": csv_roundtrip, "csv_infer_types": csv_infer_types, "csv_events_values": csv_events_values,
    "csv_folder_reordered": csv_folder_reordered, "saved_datasets": saved_datasets,
    "json_roundtrip": json_roundtrip, "json_infer": json_infer, "parquet_roundtrip": parquet_roundtrip,
    "snapshot_roundtrip": snapshot_roundtrip,
    "land_and_refresh": land_and_refresh,
    "land_and_append": land_and_append,
    "classify_rules": classify_rules, "classify_rules_custom": classify_rules_custom,
    "clean_identifier": clean_identifier_q, "clean_identifier_docs": clean_identifier_docs,
    "split_lake_path": split_lake_path_q,
    "recipe_chain": recipe_chain, "recipe_actions": recipe_actions, "store_job": store_job,
    "dedupe_row_change": dedupe_row_change, "lake_to_table": lake_to_table,
    "land_two_datasets": land_two_datasets, "land_text_tokens": land_text_tokens,
    "drop_duplicates_full": drop_duplicates_full, "duplicate_count_full": duplicate_count_full, "profile_full": profile_full,
    "describe_numeric_all": describe_numeric_all, "fill_nulls_decimal": fill_nulls_decimal, "snapshot_replace": snapshot_replace,
    "snapshot_replace_location": snapshot_replace_location, "snapshot_new_columns": snapshot_new_columns,
    "refresh_during_batch": refresh_during_batch, "publish_versions": publish_versions,
    "store_job_steps": store_job_steps, "profile_append": profile_append, "sort_copies": sort_copies, "parquet_lookup": parquet_lookup, "parquet_rebalanced": parquet_rebalanced,
    "drop_duplicates_wide": drop_duplicates_wide, "duplicate_count_wide": duplicate_count_wide,
    "profile_wide": profile_wide, "describe_text_wide": describe_text_wide,
}

_LI_NULLS = """(SELECT l_orderkey, l_linenumber,
        CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS l_quantity,
        CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_partkey END AS l_partkey,
        CASE WHEN l_quantity < 5 THEN NULL ELSE l_returnflag END AS l_returnflag,
        l_extendedprice FROM lineitem)"""

_LI_PRICE_NULLS = """(SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END
        AS l_extendedprice) FROM lineitem)"""

_ORDERS_NULLS = """(SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
        CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS o_totalprice,
        o_orderdate, o_orderpriority FROM orders)"""


def _describe_num_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", ROUND(AVG({c}), 4) AS mean,
            ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 4) AS "min",
            ROUND(QUANTILE_CONT({c}, 0.25), 4) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 4) AS p50,
            ROUND(QUANTILE_CONT({c}, 0.75), 4) AS p75, ROUND(MAX({c}), 4) AS "max" FROM {table}""")
    return " UNION ALL ".join(parts)


def _describe_text_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST(SUM(k) AS BIGINT) AS "count", COUNT(*) AS "unique",
            ARG_MIN(v, (-k, v)) AS top, MAX(k) AS freq
            FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS k FROM {table}
                  WHERE {c} IS NOT NULL GROUP BY 1)""")
    return " UNION ALL ".join(parts)


def _ts_q(c: str, p: float) -> str:
    return f"MAKE_TIMESTAMP(CAST(FLOOR(QUANTILE_CONT(EPOCH_US({c}), {p})) AS BIGINT))"


_DOCUMENTS_TWICE = """(SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS measure FROM documents
        UNION ALL SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END FROM documents)"""

_ORACLE: dict[str, str] = {
    "drop_duplicates_full": f"SELECT DISTINCT * FROM {_DOCUMENTS_TWICE}",
    "duplicate_count_full": f"""SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {_DOCUMENTS_TWICE})) AS BIGINT)
        AS duplicate_rows FROM {_DOCUMENTS_TWICE}""",
    "profile_full": f"""SELECT COUNT(*) AS "rows", CAST(6 AS BIGINT) AS "columns",
        CAST(COUNT(*) * 6 - COUNT(doc_id) - COUNT(text) - COUNT(lang) - COUNT(source) - COUNT(n_chars) - COUNT(measure) AS BIGINT) AS null_cells,
        CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {_DOCUMENTS_TWICE})) AS BIGINT) AS duplicate_rows
        FROM {_DOCUMENTS_TWICE}""",
    "describe_numeric_all": _describe_num_sql("lineitem", _LINEITEM_NUMBERS),
    "fill_nulls_decimal": """SELECT o_orderkey, COALESCE(price, CAST((SUM(price) OVER ()) / (COUNT(price) OVER ()) AS DECIMAL(20,2))) AS price
        FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS price FROM orders)""",
    "land_two_datasets": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "land_text_tokens": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN '\\N' END AS word
        FROM orders""",
    "snapshot_replace": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "store_job_steps": f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_returnflag FROM {_LI_NULLS} WHERE l_quantity > 25),
        n(loaded, kept, once) AS (SELECT (SELECT count(*) FROM lineitem), (SELECT count(*) FROM f), (SELECT count(*) FROM (SELECT DISTINCT * FROM f)))
        SELECT step, 'ok' AS status, CAST(k AS BIGINT) AS "rows" FROM n, LATERAL (VALUES ('load', loaded), ('transform', NULL), ('transform 1', kept),
            ('transform 2', kept), ('transform 3', once), ('store', once)) steps(step, k)""",
    "profile_append": """WITH d AS (SELECT * REPLACE (CASE WHEN lang <> 'de' THEN lang END AS lang) FROM documents),
        d2 AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE source = (SELECT min(source) FROM d))
        SELECT count(*) AS "rows", CAST(5 AS BIGINT) AS "columns",
            CAST(5 * count(*) - count(doc_id) - count(text) - count(lang) - count(source) - count(n_chars) AS BIGINT) AS null_cells,
            CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d2)) AS BIGINT) AS duplicate_rows FROM d2""",
    "sort_copies": """SELECT CASE WHEN l_orderkey % 8 = 0 THEN l_quantity ELSE 25.0 END AS quantity,
        CASE WHEN l_orderkey % 8 = 0 THEN l_orderkey ELSE 0 END AS orderkey FROM lineitem ORDER BY quantity""",
    "parquet_lookup": "SELECT * FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT * FROM lineitem WHERE l_orderkey = 7",
    "parquet_rebalanced": "SELECT * FROM lineitem",
    "snapshot_replace_location": """SELECT * FROM orders, (VALUES ('location'), ('name')) places(seen) WHERE o_orderstatus = 'F'""",
    "snapshot_new_columns": "SELECT * EXCLUDE (o_totalprice) FROM orders WHERE o_orderstatus <> 'P'",
    "publish_versions": """SELECT *, 'now' AS seen FROM events WHERE value > 80 UNION ALL SELECT *, 'before' FROM events WHERE value > 50""",
    "refresh_during_batch": """SELECT * FROM orders, (VALUES ('during'), ('refused')) places(seen)
        UNION ALL SELECT *, 'after' FROM orders WHERE o_orderstatus = 'F'""",
    "flagship": "SELECT * FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "filter_gt": "SELECT * FROM lineitem WHERE l_quantity > 45",
    "filter_lt": "SELECT * FROM lineitem WHERE l_extendedprice < 2000",
    "filter_eq": "SELECT * FROM lineitem WHERE l_linenumber = 3",
    "filter_gte": "SELECT * FROM lineitem WHERE l_discount >= CAST(0.09 AS DOUBLE)",
    "filter_lte": "SELECT * FROM lineitem WHERE l_tax <= CAST(0.02 AS DOUBLE)",
    "filter_ne_nulls": """SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority FROM orders
        WHERE NULLIF(o_orderstatus, 'P') IS DISTINCT FROM 'O'""",
    "filter_text": "SELECT * FROM orders WHERE o_orderpriority > '3-MEDIUM'",
    "filter_timestamp": "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "filter_boolean": """SELECT * FROM (SELECT *, o_totalprice > 200000 AS is_big FROM orders)
        WHERE is_big = TRUE""",
    "sort_asc_top": "SELECT * FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 100",
    "sort_desc_nulls_top": f"""SELECT * FROM {_LI_PRICE_NULLS}
        ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100""",
    "sort_asc_nulls_top": f"""SELECT * FROM {_LI_PRICE_NULLS}
        ORDER BY l_extendedprice ASC NULLS LAST, l_orderkey, l_linenumber LIMIT 100""",
    "sort_full": "SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey",
    "select_columns": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "rename_column": """SELECT c_custkey, c_name, c_nationkey, c_acctbal AS account_balance, c_mktsegment
        FROM customer""",
    "drop_column": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer",
    "add_column": "SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem",
    "add_column_case": """SELECT *, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size_class
        FROM lineitem""",
    "convert_to_long": """SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_extendedprice) AS BIGINT) AS l_extendedprice
        FROM lineitem""",
    "convert_to_string": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
    "convert_to_timestamp": "SELECT event_id, CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS ts FROM events",
    "convert_try": """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR)
        ELSE o_orderpriority END AS DOUBLE) AS amount FROM orders""",
    "drop_nulls": f"""SELECT * FROM {_LI_NULLS} WHERE l_quantity IS NOT NULL AND l_partkey IS NOT NULL
        AND l_returnflag IS NOT NULL""",
    "fill_nulls": f"""SELECT l_orderkey, l_linenumber,
        ROUND(COALESCE(l_quantity, AVG(l_quantity) OVER ()), 4) AS l_quantity,
        ROUND(COALESCE(CAST(l_partkey AS DOUBLE), AVG(l_partkey) OVER ()), 4) AS l_partkey,
        COALESCE(l_returnflag, 'Unknown') AS l_returnflag,
        ROUND(l_extendedprice, 4) AS l_extendedprice FROM {_LI_NULLS}""",
    "drop_duplicates": "SELECT DISTINCT source, lang FROM documents",
    "duplicate_count": """SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT source, lang FROM documents))
        AS BIGINT) AS duplicate_rows FROM documents""",
    "null_report": f"""SELECT * FROM (
        SELECT 'o_orderkey' AS "column", COUNT(*) - COUNT(o_orderkey) AS null_count FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_orderstatus', COUNT(*) - COUNT(o_orderstatus) FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_totalprice', COUNT(*) - COUNT(o_totalprice) FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_orderdate', COUNT(*) - COUNT(o_orderdate) FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_orderpriority', COUNT(*) - COUNT(o_orderpriority) FROM {_ORDERS_NULLS})
        WHERE null_count > 0""",
    "null_counts": f"""
        SELECT 'o_orderkey' AS "column", COUNT(*) - COUNT(o_orderkey) AS null_count FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_orderstatus', COUNT(*) - COUNT(o_orderstatus) FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_totalprice', COUNT(*) - COUNT(o_totalprice) FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_orderdate', COUNT(*) - COUNT(o_orderdate) FROM {_ORDERS_NULLS}
        UNION ALL SELECT 'o_orderpriority', COUNT(*) - COUNT(o_orderpriority) FROM {_ORDERS_NULLS}""",
    "fill_nulls_stringify": """SELECT o_orderkey,
        COALESCE(CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS VARCHAR), 'Unknown')
            AS o_orderdate,
        COALESCE(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END, 'Unknown')
            AS o_orderpriority FROM orders""",
    "compare_text": _describe_text_sql("orders", ["o_orderstatus", "o_orderpriority"]),
    "dataset_profile": """WITH d AS (SELECT source, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang FROM documents)
        SELECT COUNT(*) AS "rows", CAST(2 AS BIGINT) AS "columns",
            CAST(SUM(CASE WHEN source IS NULL THEN 1 ELSE 0 END + CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS BIGINT)
                AS null_cells,
            COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT source, lang FROM d)) AS duplicate_rows
        FROM d""",
    "schema_report": """SELECT * FROM (VALUES
        (1, 'l_orderkey', 'bigint', TRUE), (2, 'l_partkey', 'bigint', TRUE), (3, 'l_suppkey', 'bigint', TRUE),
        (4, 'l_linenumber', 'int', TRUE), (5, 'l_quantity', 'double', TRUE), (6, 'l_extendedprice', 'double', TRUE),
        (7, 'l_discount', 'double', TRUE), (8, 'l_tax', 'double', TRUE), (9, 'l_returnflag', 'string', TRUE),
        (10, 'l_linestatus', 'string', TRUE), (11, 'l_shipdate', 'timestamp_ntz', TRUE))
        AS t(position, "column", spark_type, nullable)""",
    "row_count": "SELECT COUNT(*) AS \"rows\" FROM lineitem",
    "column_means": """SELECT ROUND(AVG(p_partkey), 4) AS p_partkey, ROUND(AVG(p_size), 4) AS p_size,
        ROUND(AVG(p_retailprice), 4) AS p_retailprice FROM part""",
    "describe_numeric": _describe_num_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]),
    "describe_text": _describe_text_sql("orders", ["o_orderpriority", "o_orderstatus"]),
    "describe_timestamp": f"""SELECT 'o_orderdate' AS "column", COUNT(o_orderdate) AS "count",
        MAKE_TIMESTAMP(CAST(SUM(EPOCH_US(o_orderdate)) // COUNT(o_orderdate) AS BIGINT)) AS mean,
        MIN(o_orderdate) AS "min", {_ts_q('o_orderdate', 0.25)} AS p25, {_ts_q('o_orderdate', 0.5)} AS p50,
        {_ts_q('o_orderdate', 0.75)} AS p75, MAX(o_orderdate) AS "max" FROM orders""",
    "compare_columns": _describe_num_sql("lineitem", ["l_tax"]),
}


for _name in ("drop_duplicates", "duplicate_count", "profile"):      # another way to the same result
    _ORACLE[f"{_name}_wide"] = _ORACLE[f"{_name}_full"]
_ORACLE["describe_text_wide"] = _describe_text_sql("documents", ["text", "lang"])


def _duck_strip(x: str) -> str:
    return f"REGEXP_REPLACE({x}, '^\\s+|\\s+$', '', 'g')"


def _duck_last_part(x: str) -> str:
    return (f"(CASE WHEN INSTR({x}, '/') > 0 THEN STRING_SPLIT(REGEXP_REPLACE({x}, '/+$', ''), '/')[-1] "
            f"ELSE {x} END)")


def _duck_underscored(x: str) -> str:
    return f"REGEXP_REPLACE(REPLACE({_duck_strip(x)}, '.py', ''), '[ .\\-]', '_', 'g')"


_S = "REGEXP_REPLACE(" + _duck_strip("url") + ", '^https?://', 'hdfs://')"
_FULL = (f"(CASE WHEN STARTS_WITH({_S}, 'hdfs://') THEN {_S} "
         f"ELSE CONCAT('hdfs://localhost:9000/', REGEXP_REPLACE({_S}, '^/+|/+$', '', 'g')) END)")
_STRIPPED = f"REGEXP_REPLACE({_FULL}, '/+$', '')"

_ORACLE.update({
    "csv_roundtrip": "SELECT * FROM orders",
    "csv_infer_types": """SELECT * FROM (VALUES (1, 'event_id', 'bigint', TRUE), (2, 'ts', 'timestamp_ntz', TRUE),
        (3, 'user_id', 'bigint', TRUE), (4, 'event_type', 'string', TRUE), (5, 'value', 'double', TRUE),
        (6, 'props', 'string', TRUE)) AS t(position, "column", spark_type, nullable)""",
    "csv_events_values": "SELECT * FROM events",
    "csv_folder_reordered": "SELECT * FROM events",
    "saved_datasets": """SELECT 'customer' AS dataset, COUNT(*) AS "rows" FROM customer
        UNION ALL SELECT 'orders', COUNT(*) FROM orders""",
    "json_roundtrip": "SELECT * FROM events",
    "json_infer": """SELECT c_acctbal, c_custkey, c_mktsegment, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey
        FROM customer""",
    "parquet_roundtrip": "SELECT * FROM lineitem",
    "snapshot_roundtrip": "SELECT * FROM customer",
    "land_and_refresh": "SELECT * FROM orders",
    "land_and_append": "SELECT * FROM orders",
    "classify_rules": """SELECT doc_id, CASE
        WHEN contains(t, 'schedule') OR contains(t, 'scheduled') OR contains(t, 'cron') THEN 'RUN_AIRFLOW_SCHEDULE'
        WHEN contains(t, 'airflow') OR contains(t, 'run on') OR contains(t, 'trigger') THEN 'RUN_AIRFLOW'
        WHEN contains(t, 'push sql to hdfs') OR contains(t, 'mysql to hdfs') OR contains(t, 'sql to hdfs') THEN 'MYSQL_TO_HDFS'
        WHEN contains(t, 'push to mysql') OR contains(t, 'push to sql') OR contains(t, 'store in mysql')
            OR contains(t, 'save to mysql') OR contains(t, 'store in sql') THEN 'PUSH_MYSQL'
        WHEN contains(t, 'iceberg') OR contains(t, 'icebeg') OR contains(t, 'icberg') OR contains(t, 'isberg') OR contains(t, 'icebrg')
            OR contains(t, 'icebr') OR contains(t, 'icebe') OR contains(t, 'ice berg') THEN 'STORE_HDFS_ICEBERG'
        WHEN contains(t, 'store') OR contains(t, 'push') OR contains(t, 'save') OR contains(t, 'upload') OR contains(t, 'hdfs') THEN 'STORE_HDFS'
        WHEN contains(t, 'clean null') OR contains(t, 'remove null') OR contains(t, 'drop null') THEN 'REMOVE_NULLS:drop'
        WHEN contains(t, 'fill null') THEN 'REMOVE_NULLS:fill'
        WHEN contains(t, 'duplicate') THEN 'REMOVE_DUPLICATES'
        WHEN contains(t, 'find null') THEN 'FIND_NULLS'
        WHEN contains(t, 'schema') THEN 'DETECT_SCHEMA'
        WHEN contains(t, 'pyspark') THEN 'GENERATE_PYSPARK'
        WHEN contains(t, 'pipeline') THEN 'BUILD_PIPELINE'
        WHEN contains(t, 'sql') AND NOT contains(t, 'mysql') THEN 'GENERATE_SQL'
        WHEN contains(t, 'mysql') OR contains(t, 'load mysql') OR contains(t, 'from mysql') THEN 'LOAD_MYSQL'
        ELSE 'UNKNOWN' END AS label FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""",
    "classify_rules_custom": """SELECT conv_id, turn, CASE
        WHEN contains(t, 'the ') AND NOT contains(t, ' le ') AND NOT contains(t, ' der ') THEN 'english'
        WHEN contains(t, ' le ') OR contains(t, ' les ') THEN 'french'
        WHEN contains(t, ' el ') OR contains(t, ' los ') THEN 'spanish'
        WHEN contains(t, ' der ') OR contains(t, ' die ') THEN 'german'
        ELSE 'other' END AS label FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)""",
    "clean_identifier": f"""SELECT page_id, {_duck_last_part('LOWER(' + _duck_underscored('url') + ')')} AS table_name,
        {_duck_underscored('url')} AS job_name,
        LOWER(REPLACE(CASE WHEN STARTS_WITH({_duck_strip('url')}, 'hdfs://')
            THEN STRING_SPLIT(REGEXP_REPLACE({_duck_strip('url')}, '/+$', ''), '/')[-1]
            ELSE {_duck_strip('url')} END, ' ', '_')) AS folder FROM pages""",
    "clean_identifier_docs": f"""SELECT doc_id,
        {_duck_last_part('LOWER(' + _duck_underscored("CONCAT_WS(' ', source, lang, CAST(doc_id AS VARCHAR))") + ')')}
        AS table_name FROM documents""",
    "split_lake_path": f"""SELECT page_id, {_FULL} AS full_path,
        CASE WHEN INSTR({_STRIPPED}, '/') > 0 THEN REGEXP_EXTRACT({_STRIPPED}, '^(.*)/[^/]*$', 1)
            ELSE {_STRIPPED} END AS base_path,
        CASE WHEN INSTR({_STRIPPED}, '/') > 0
            THEN LOWER(REGEXP_REPLACE(REGEXP_EXTRACT({_STRIPPED}, '([^/]*)$', 1), '[-. ]', '_', 'g'))
            ELSE 'data' END AS name FROM pages""",
    "recipe_chain": f"""WITH f AS (SELECT * FROM {_LI_NULLS} WHERE l_extendedprice > 50000),
        filled AS (SELECT COALESCE(l_returnflag, 'Unknown') AS l_returnflag,
                          COALESCE(l_quantity, AVG(l_quantity) OVER ()) AS l_quantity FROM f)
        SELECT l_returnflag, ROUND(l_quantity, 4) AS l_quantity FROM (SELECT DISTINCT l_returnflag, l_quantity FROM filled)
        ORDER BY l_quantity DESC NULLS LAST, l_returnflag LIMIT 100""",
    "recipe_actions": """SELECT DISTINCT o_orderkey, o_orderstatus, o_totalprice AS price, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'""",
    "dedupe_row_change": """SELECT COUNT(*) AS rows_before,
        (SELECT COUNT(*) FROM (SELECT DISTINCT source, lang FROM documents)) AS rows_after FROM documents""",
    "lake_to_table": "SELECT p_partkey, p_brand, p_size FROM part",
    "store_job": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice AS price,
        l_discount, l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'""",
})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm_queries is None:
        return dict(_QUERIES)
    return _QUERIES | llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if llm_queries is None:
        return dict(_ORACLE)
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return _ORACLE | llm_queries.ORACLE | pipeline_sql
