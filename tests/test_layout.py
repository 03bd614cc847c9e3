"""Where rows go: sorts of copies, sizes of files, row groups skipped, database slices."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeprep import operators as ops
from lakeprep.operators.ordering import numbered_copies
from lakeprep.session import scratch_path
from lakeprep.sinks.files import land_csv, store_parquet, write_parquet
from lakeprep.sinks.tables import store_table
from lakeprep.sources.jdbc import balanced_ranges, count_sql, range_predicates, read_jdbc

from conftest import SF_SMALL, task_totals


def crowded(spark, n=40_000):
    """Nine of ten rows are one row."""
    return spark.range(n).selectExpr("if(id % 10 = 0, id, -1) AS k", "if(id % 10 = 0, id / 7, 0.5D) AS x")


def parts(df) -> list[int]:
    found = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    return sorted(r["n"] for r in found)


def test_sorted_copies_are_dealt_evenly(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = crowded(spark)
        assert parts(ops.sort_rows(df, "k"))[-1] > 30_000             # without it one task holds the copies
        out = ops.sort_rows(df, "k", split_copies=True)
        sizes = parts(out)
        assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
        keys = [r["k"] for r in out.select("k").collect()]
        assert keys == sorted(keys) and out.columns == df.columns
        assert Counter(map(tuple, out.collect())) == Counter(map(tuple, df.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sorted_copies_keep_every_value(spark):
    rows = [(0.0, "a"), (-0.0, "a"), (0.0, "a"), (None, "a"), (float("nan"), "a"), (float("nan"), "a"), (1.5, None), (1.5, None), (None, None)]
    df = spark.createDataFrame(rows * 3, "x double, s string")
    for order in ("asc", "desc"):
        out = ops.sort_rows(df, "x", order, split_copies=True).collect()
        assert Counter((str(r["x"]), r["s"]) for r in out) == Counter((str(x), s) for x, s in rows * 3)
        values = [r["x"] for r in out if r["x"] is not None and not math.isnan(r["x"])]
        assert values == sorted(values, reverse=order == "desc")
        assert all(r["x"] is None or math.isnan(r["x"]) for r in out[len(values):])
    assert ops.sort_rows(df.limit(0), "x", split_copies=True).collect() == []
    with pytest.raises(ValueError, match="MAP"):
        ops.sort_rows(df.withColumn("m", F.create_map(F.lit(1), F.lit(2))), "x", split_copies=True)


def test_copies_are_numbered_by_the_rows_alone(spark):
    seen = []
    for df in (crowded(spark, 5000).repartition(3), crowded(spark, 5000).coalesce(1).orderBy("x")):
        numbered, number = numbered_copies(df)
        seen.append(Counter(map(tuple, numbered.collect())))
        assert all(n == 1 for n in seen[-1].values()) and number in numbered.columns
    assert seen[0] == seen[1]


def files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.startswith("part-")]


def test_rebalanced_stores_have_few_even_files(spark):
    df = spark.range(0, 60_000, 1, 32).selectExpr("if(id % 20 = 0, concat('rare', id % 3), 'hot') AS p", "id", "sha2(cast(id AS string), 256) AS t")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        base = scratch_path(spark, "even")
        many = files(store_parquet(df, base, "plain", partition_by=["p"]).location)
        few = files(store_parquet(df, base, "even", partition_by=["p"], rebalance=True).location)
        hot = sorted(os.path.getsize(f) for f in few if "p=hot" in f)
        assert len(many) > 100 and len(few) <= 16 and 2 <= len(hot) and hot[-1] < 3 * hot[0]
        assert spark.read.parquet(f"{base}/even.parquet").count() == 60_000
        small = df.where("id < 64")
        assert len(files(store_parquet(small, base, "small", rebalance=True).location)) == 1
        assert len(files(land_csv(small, base, "landed", rebalance=True).location)) == 1
        store_table(small, "even_table", provider="parquet", location=f"{base}/table", partition_by=["p"], rebalance=True)
        assert len(files(f"{base}/table")) == len({r["p"] for r in small.select("p").distinct().collect()})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    with pytest.raises(ValueError, match="one of"):
        store_parquet(df, base, "both", rebalance=True, cluster_by=["id"])
    with pytest.raises(ValueError, match="nothing"):
        store_parquet(df, base, "unknown", cluster_by=["nothing"])


def rows_read(spark, action) -> int:
    return task_totals(spark, action, "inputRecords")


def test_lookups_skip_row_groups(spark):
    """Bounds help no column that lies in random order; a Bloom filter does."""
    df = spark.range(0, 80_000, 1, 8).selectExpr("pmod(xxhash64(id), 1000003) * 2 AS key", "id", "sha2(cast(id AS string), 256) AS t")
    base, wanted = scratch_path(spark, "lookups"), [r["key"] for r in df.where("id % 20000 = 77").collect()]
    for name, options in (("plain", {}), ("bloom", {"lookup": ["key"]}), ("both", {"lookup": ["key"], "cluster_by": ["id"]})):
        write_parquet(df, f"{base}/{name}", **options)
    read = {}
    for name in ("plain", "bloom", "both"):
        stored = spark.read.parquet(f"{base}/{name}")
        for key in wanted:
            want = df.where(F.col("key") == key).count()
            read[name] = read.get(name, 0) + rows_read(spark, lambda: ops.filter_rows(stored, "key", "=", str(key)).collect())
            assert ops.filter_rows(stored, "key", "=", str(key)).count() == want
        read[f"{name} absent"] = rows_read(spark, lambda: ops.filter_rows(stored, "key", "=", "777").collect())
    assert read["plain"] >= 4 * 79_000 and read["bloom"] < read["plain"] / 3 and read["both"] < read["plain"] / 2
    assert read["plain absent"] >= 79_000 and read["bloom absent"] <= 10_000
    narrow = rows_read(spark, lambda: ops.filter_rows(spark.read.parquet(f"{base}/both"), "id", "=", "77").collect())
    assert narrow < 45_000


def counter(keys):
    return lambda a, b, width: dict(Counter((k - a) // width for k in keys if a <= k < b))


def test_database_slices_hold_equal_shares():
    rng = random.Random(8)
    for keys in ([*range(1000)], [rng.randrange(10 ** 9) for _ in range(900)] + [rng.randrange(5000) for _ in range(3000)],
                 [int(1.001 ** rng.randrange(20_000)) for _ in range(4000)], [7] * 50, [-5, -4, 10 ** 15] + [*range(2000)]):
        for slices in (1, 3, 8):
            ranges = balanced_ranges(counter(keys), min(keys), max(keys), slices)
            assert sum(n for _, _, n in ranges) == len(keys) and ranges == sorted(ranges)
            share, held = len(keys) / slices, Counter(keys)
            for a, b, n in ranges:
                assert n == sum(c for k, c in held.items() if a <= k < b)
                assert n <= 2 * share or len({k for k in held if a <= k < b}) == 1
            assert len(ranges) <= 2 * slices + 1


def test_a_hot_key_is_a_slice_of_its_own():
    keys = [*range(1000)] + [500] * 5000
    ranges = balanced_ranges(counter(keys), 0, 999, 6)
    assert max(ranges, key=lambda r: r[2])[:2][0] <= 500 and max(n for _, _, n in ranges) <= 5300
    assert max(n for a, b, n in ranges if not a <= 500 < b) <= 2 * 1000


def test_slice_predicates_take_every_row_once(spark):
    keys = [None, -10, 0, 1, 1, 2, 5, 9, 40, 41, 1000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for slices in (1, 2, 4, 20):
        ranges = balanced_ranges(counter([k for k in keys if k is not None]), -10, 1000, slices)
        found = [r["k"] for p in range_predicates("k", ranges) for r in df.where(p).collect()]
        assert sorted(found, key=str) == sorted(keys, key=str)
    assert range_predicates("k", []) == ["1 = 1"]
    with pytest.raises(ValueError):
        range_predicates("k; DROP", [])


def test_slices_from_counts_that_the_engine_groups(spark):
    """The counting statement itself, on a table this session knows."""
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").selectExpr("if(l_linenumber > 2, l_orderkey % 40, l_orderkey) AS k").createOrReplaceTempView("sliced")

    def count(a, b, width):
        return {int(r[0]): int(r[1]) for r in spark.sql(count_sql("sliced", "k", a, b, width)).collect()}
    lo, hi, n = spark.sql("SELECT min(k), max(k), count(*) FROM sliced").first()
    ranges = balanced_ranges(count, lo, hi, 8)
    sizes = [spark.table("sliced").where(p).count() for p in range_predicates("k", ranges)]
    assert sum(sizes) == n and max(sizes) <= 2 * n / 8
    with pytest.raises(ValueError, match="partition_column"):
        read_jdbc(spark, None, "t", predicates=["1 = 1"], balance=True)
