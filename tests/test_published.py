"""Published datasets: versions, readers and failures."""

import datetime as dt
import os

import pytest

from lakeprep.session import scratch_path
from lakeprep.sinks import commits
from lakeprep.sinks.published import publish, publish_log, read_published, sweep, versions

ROWS = [(1, "a,\n\"b\"", 1.5, dt.date(2024, 1, 2)), (2, None, None, None), (3, "", -0.5, dt.date(1999, 12, 31)), (4, "NA", 0.0, None)]
KIND = "id long, `odd name` string, x double, d date"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_versions_come_back_as_they_were(spark, form):
    root, df = scratch_path(spark, "pub"), spark.createDataFrame([r for r in ROWS if form != "csv" or r[1] != ""], KIND)
    report = publish(df, root, form)
    assert report.rows == df.count() and report.location.startswith(root)
    back = read_published(spark, root)
    assert back.dtypes == df.dtypes and rows(back) == rows(df)


def test_replacing_keeps_and_deletes_versions(spark):
    root = scratch_path(spark, "pub-keep")
    with pytest.raises(ValueError, match="Not found"):
        read_published(spark, root)
    for n in (3, 5, 7):
        publish(spark.range(n), root, keep=1)
    assert read_published(spark, root).count() == 7 and len(versions(spark, root)) == 2
    assert read_published(spark, root, versions(spark, root)[0]).count() == 5
    publish(read_published(spark, root).where("id > 1"), root)        # reads what it replaces
    assert read_published(spark, root).count() == 5 and len(commits.sub_folders(spark, root)) == 2       # one version, the markers
    log = publish_log(spark, root).collect()
    assert [(r["format"], r["rows"]) for r in log] == [("parquet", 5)]
    with pytest.raises(ValueError, match="form"):
        publish(spark.range(1), root, "orc")


def test_unfinished_versions_are_invisible_and_swept(spark):
    root = scratch_path(spark, "pub-lost")
    publish(spark.range(4), root)
    spark.range(9).write.parquet(f"{root}/{commits.new_version()}")                 # being written, or lost
    old = commits.version_time(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)) + "-00000000"
    spark.range(9).write.parquet(f"{root}/{old}")
    assert read_published(spark, root).count() == 4
    assert sweep(spark, root) == [old] and len(commits.sub_folders(spark, root)) == 3
    with pytest.raises(Exception, match="no good"):
        publish(spark.range(3).selectExpr("if(id > 1, raise_error('no good'), id) AS id"), root)
    assert read_published(spark, root).count() == 4 and len(commits.sub_folders(spark, root)) == 3


def test_a_commit_is_whole_and_final(spark):
    root = scratch_path(spark, "pub-commit")
    commits.commit(spark, root, "one", {"é": [1, None]})
    assert commits.content(spark, root, "one") == {"é": [1, None]} and commits.committed(spark, root) == ["one"]
    with pytest.raises(FileExistsError):
        commits.commit(spark, root, "one", {})
    open(os.path.join(root.removeprefix("file:"), "_commits", ".draft"), "w").close()
    assert commits.committed(spark, root) == ["one"]
    commits.forget(spark, root, "one")
    assert commits.committed(spark, root) == []
