import datetime as dt
import json
import os

import pytest

from lakeprep.session import scratch_path
from lakeprep.sinks.files import land_csv, store_parquet, write_csv, write_json
from lakeprep.sinks.tables import check_identifier, save_snapshot, store_table
from lakeprep.sources.jdbc import JdbcTarget, lookup_table, read_jdbc
from lakeprep.sources.lake import list_saved, load_saved, normalize_nan
from lakeprep.sources.text import read_csv, read_json

from conftest import SF_SMALL


def _write(dirpath, name, text):
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_quoting_and_null_tokens(spark, tmpdir_path):
    p = _write(tmpdir_path, "q.csv",
               'a,b,a,c\n"he said ""hi""","multi\nline",x,\n#N/A,NULL,n/a,<NA>\nNaN,None,,"last"\n')
    df = read_csv(spark, p)
    assert df.columns == ["a", "b", "a_1", "c"]
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ('he said "hi"', "multi\nline", "x", None)
    assert got[1] == (None, None, None, None)
    assert got[2] == (None, None, None, "last")


def test_csv_type_inference(spark, tmpdir_path):
    p = _write(tmpdir_path, "t.csv",
               "i,f,b,mixed,zeros,suffix,year,day,ts,empty\n"
               "1,1,TRUE,1,007,1d,2024,2024-01-02,2024-01-02 03:04:05.123456,\n"
               "2,2.5,false,True,010,2d,2025,2024-01-03,2024-01-02T03:04:06,\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "mixed": "string",
                               "zeros": "bigint", "suffix": "string", "year": "bigint", "day": "date",
                               "ts": "timestamp_ntz", "empty": "string"}
    r = df.orderBy("i").collect()
    assert r[0].zeros == 7 and r[1].f == 2.5 and r[0].b is True and r[0].ts == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    typed = read_csv(spark, p, schema="i int, f double, b string, mixed string, zeros string, suffix string, "
                                      "year int, day date, ts timestamp_ntz, empty string")
    assert dict(typed.dtypes)["zeros"] == "string" and typed.first().zeros in ("007", "010")


def test_json_array_and_lines(spark, tmpdir_path):
    arr = _write(tmpdir_path, "a.json", json.dumps([{"a": 1, "n": {"x": [1, 2]}}, {"a": None, "n": None}]))
    lines = _write(tmpdir_path, "l.json", '{"a": 1.5, "s": "x"}\n{"a": NaN, "s": null}\n')
    a = read_json(spark, arr)
    assert a.count() == 2 and a.schema["n"].dataType.typeName() == "struct"
    l = read_json(spark, lines)
    assert [r.a for r in l.collect()] == [1.5, None]          # NaN read as missing


def test_round_trips(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    p = scratch_path(spark, "t-csv")
    rep = write_csv(o, p)
    assert rep.rows == o.count()
    back = read_csv(spark, p)
    assert back.schema == o.schema and back.exceptAll(o).count() == 0
    p = scratch_path(spark, "t-json")
    write_json(o, p)
    assert read_json(spark, p, schema=o.schema).exceptAll(o).count() == 0
    rep = store_parquet(o, scratch_path(spark, "t-lake"), "orders")
    assert rep.location.endswith("/orders.parquet") and rep.rows == 1500 and rep.columns == 6


def test_snapshot_list_and_table_store(spark):
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    save_snapshot(c, "cust_snap", location=scratch_path(spark, "snap"))
    assert load_saved(spark, "cust_snap").count() == 150
    assert "cust_snap" in [r.name for r in list_saved(spark).collect()]
    with pytest.raises(ValueError):
        load_saved(spark, "no_such_table")
    snap = scratch_path(spark, "snap-path")
    save_snapshot(c, "cust_snap_path", location=snap)
    assert load_saved(spark, snap).count() == 150
    with pytest.raises(ValueError, match="Not found"):
        load_saved(spark, snap + "-missing")
    rep = store_table(c, "cust_table", provider="parquet", location=scratch_path(spark, "tbl"))
    assert rep.rows == 150 and "tbl" in rep.location
    # replace keeps working on a second store
    store_table(c.limit(10), "cust_table", provider="parquet", location=scratch_path(spark, "tbl2"))
    assert spark.table("cust_table").count() == 10


class _FakeWriter:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def f(*a, **k):
            self.calls.append((name, a, k))
            return self
        return f


def test_iceberg_writer_calls(spark, monkeypatch):
    from lakeprep.sinks import tables
    monkeypatch.setattr(tables, "table_location", lambda spark, name: name)   # there is no such catalog here
    fake = _FakeWriter()
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    monkeypatch.setattr(type(c), "writeTo", lambda self, ident: (fake.calls.append(("writeTo", (ident,), {})), fake)[1])
    rep = store_table(c, "local.default.cars", provider="iceberg", count_rows=False)
    assert rep.location == "local.default.cars" and rep.format == "iceberg"
    names = [x[0] for x in fake.calls]
    assert names[:2] == ["writeTo", "using"] and ("tableProperty", ("write.format.default", "parquet"), {}) in fake.calls
    assert names[-1] == "createOrReplace"


def test_identifiers():
    assert check_identifier("local.default.cars") == "local.default.cars"
    for bad in ("asw.py.x.y", "a b", "t;drop table x", "", "x--y"):
        with pytest.raises(ValueError):
            check_identifier(bad)


def test_jdbc_paths_validate_before_any_connection(spark):
    t = JdbcTarget("jdbc:mysql://db.invalid/x", user="u", password="p")
    assert t.options()["user"] == "u"
    with pytest.raises(ValueError):
        read_jdbc(spark, t, "users; drop table users", single_task=True)
    with pytest.raises(ValueError, match="single_task"):
        read_jdbc(spark, t, "users")
    with pytest.raises(ValueError, match="single_task"):
        read_jdbc(spark, t, "users", "id", single_task=True)
    with pytest.raises(ValueError):
        lookup_table(spark, t, "a b")


def test_landing_gets_new_names(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(5)
    base = scratch_path(spark, "land")
    a, b = land_csv(o, base, "orders"), land_csv(o, base, "orders")
    assert a.location != b.location and "/input/orders/" in a.location
    assert read_csv(spark, f"{base}/input/orders/*").count() == 10


def test_normalize_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "x double, i int")
    assert normalize_nan(df).first().x is None


def test_load_by_extension(spark, tmpdir_path):
    from lakeprep.sources import load
    p = _write(tmpdir_path, "UPPER.CSV", "a,b\n1,x\n")
    assert load(spark, p).dtypes == [("a", "bigint"), ("b", "string")]
    j = _write(tmpdir_path, "r.json", '[{"a": 1}]')
    assert load(spark, j).count() == 1
    assert load(spark, f"{SF_SMALL}/region.parquet").count() == 5
    with pytest.raises(ValueError, match="no reader"):
        load(spark, _write(tmpdir_path, "x.txt", "a"))


def test_schema_text_file(spark):
    from lakeprep.operators import save_schema_text
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    path = save_schema_text(o, scratch_path(spark, "schema"))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "o_orderkey: bigint" and lines[4] == "o_orderdate: timestamp_ntz" and len(lines) == 6


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402

from lakeprep.sources.text import NULL_TOKENS  # noqa: E402

_text = st.text(alphabet=st.sampled_from(list('ab ,"\n\r\t\'xé;') + ["\\"]), min_size=0, max_size=12).filter(
    lambda s: s not in NULL_TOKENS and s.strip() != "")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(_text, st.one_of(st.none(), _text)), min_size=1, max_size=8))
def test_csv_text_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    path = scratch_path(spark, "csv-prop")
    write_csv(df, path)
    back = read_csv(spark, path, infer=False, multiline=True)      # texts hold line breaks
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


_typed_rows = st.lists(st.tuples(
    st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)),
    st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=True)),
    st.one_of(st.none(), st.booleans()),
    st.one_of(st.none(), st.datetimes(min_value=dt.datetime(1900, 1, 1), max_value=dt.datetime(2200, 1, 1))),
    st.one_of(st.none(), st.text(max_size=6).filter(lambda s: s not in NULL_TOKENS and "\x00" not in s))),
    min_size=1, max_size=6)
TYPED = "i bigint, x double, b boolean, t timestamp_ntz, s string"


def _same(got, want):
    def norm(r):
        return tuple(None if v is None else (float(v) if isinstance(v, float) else v) for v in r)
    return sorted(map(norm, got), key=repr) == sorted(map(norm, want), key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_typed_rows)
def test_csv_typed_round_trip(spark, rows):
    df = spark.createDataFrame(rows, TYPED)
    path = scratch_path(spark, "csv-typed")
    write_csv(df, path)
    back = read_csv(spark, path, multiline=True)
    for f in df.schema.fields:
        if any(r[df.columns.index(f.name)] is not None for r in rows) and f.name != "s":
            assert dict(back.dtypes)[f.name] == f.dataType.simpleString(), f.name
    typed = read_csv(spark, path, schema=TYPED, multiline=True)
    assert _same([tuple(r) for r in typed.collect()], rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_typed_rows)
def test_json_round_trip(spark, rows):
    df = spark.createDataFrame(rows, TYPED)
    path = scratch_path(spark, "json-prop")
    write_json(df, path)
    back = read_json(spark, path, schema=df.schema)
    assert _same([tuple(r) for r in back.collect()], rows)


def test_csv_other_encoding(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "latin1.csv")
    with open(p, "w", encoding="latin-1") as f:
        f.write("name,n\nJosé,1\nZoë,2\n")
    for multiline in (True, False):
        got = read_csv(spark, p, encoding="ISO-8859-1", multiline=multiline).orderBy("n").collect()
        assert [(r.name, r.n) for r in got] == [("José", 1), ("Zoë", 2)]


def test_tsv_round_trip(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    path = scratch_path(spark, "tsv")
    write_csv(o, path, sep="\t")
    back = read_csv(spark, path, sep="\t")
    assert back.schema == o.schema and back.exceptAll(o).count() == 0


def test_partitioned_store_prunes(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    rep = store_parquet(o, scratch_path(spark, "parts"), "orders", partition_by=["o_orderstatus"])
    back = spark.read.parquet(rep.location)
    f = back.where("o_orderstatus = 'F'")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan
    assert f.count() == o.where("o_orderstatus = 'F'").count()
    rep2 = store_table(o, "orders_parts", provider="parquet", location=scratch_path(spark, "parts-t"),
                       partition_by=["o_orderstatus"])
    assert rep2.rows == 1500 and spark.table("orders_parts").where("o_orderstatus = 'P'").count() == \
        o.where("o_orderstatus = 'P'").count()


def test_snapshot_replaces_itself(spark):
    from lakeprep.sources.lake import load_saved
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    name = "self_replace_" + os.urandom(4).hex()
    save_snapshot(o, name)
    save_snapshot(load_saved(spark, name).where("o_orderstatus = 'F'"), name)
    assert load_saved(spark, name).count() == o.where("o_orderstatus = 'F'").count()
    spark.sql(f"DROP TABLE {name}")


def test_bad_json_records_fail_unless_asked_for(spark, tmpdir_path):
    path = _write(tmpdir_path, "bad.json", '{"a": 1}\n{"a": oops}\n')
    with pytest.raises(Exception):
        read_json(spark, path).collect()
    assert read_json(spark, path, schema="a int", bad_records="null").count() == 2


def test_ragged_csv_rows_fail_unless_asked_for(spark, tmpdir_path):
    for name, text in (("long", "a,b\n1,2\n3,4,5\n"), ("short", "a,b\n1,2\n6\n")):
        path = _write(tmpdir_path, f"{name}.csv", text)
        for columns in (["a", "b"], ["a"]):
            with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
                read_csv(spark, path, infer=False).select(*columns).collect()
        assert read_csv(spark, path, bad_rows="null").count() == 2
    with pytest.raises(ValueError, match="bad_rows"):
        read_csv(spark, path, bad_rows="ignore")


def test_csv_folder_headers(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "one folder")
    os.makedirs(folder)
    _write(folder, "a.csv", "x,y\n1,one\n2,two\n")
    _write(folder, "b 1.csv", "y,x\nthree,3\n")
    with pytest.raises(Exception):
        read_csv(spark, folder, infer=False).collect()
    got = read_csv(spark, folder, by_name=True)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(1, "one"), (2, "two"), (3, "three")]
    _write(folder, "c.csv", "x,z\n1,2\n")
    with pytest.raises(ValueError, match="c.csv"):
        read_csv(spark, folder, by_name=True)
    repeated = os.path.join(tmpdir_path, "repeated")
    os.makedirs(repeated)
    _write(repeated, "a.csv", "k,k\n1,2\n")
    _write(repeated, "b.csv", "k,k\n3,4\n")
    assert sorted(map(tuple, read_csv(spark, repeated).collect())) == [(1, 2), (3, 4)]


def test_csv_folders_split_and_files_may_hold_line_breaks(spark, tmpdir_path):
    path = _write(tmpdir_path, "breaks.csv", 'a,b\n"x\ny",1\n')
    assert read_csv(spark, path).first()["a"] == "x\ny"
    assert "multiLine=true" not in str(read_csv(spark, tmpdir_path + "/*.csv", infer=False, bad_rows="null")._jdf.queryExecution().logical())


def test_strict_json_dates(spark, tmpdir_path):
    path = _write(tmpdir_path, "dates.json", '{"d": "2024-01-02"}\n{"d": "soon"}\n')
    with pytest.raises(Exception, match="soon"):
        read_json(spark, path, schema="d date").collect()
    assert [r["d"] for r in read_json(spark, path, schema="d date", bad_records="null").collect()] == [dt.date(2024, 1, 2), None]


def test_parquet_store_replaces_what_it_reads(spark):
    base = scratch_path(spark, "in-place")
    store_parquet(spark.range(10), base, "n")
    report = store_parquet(spark.read.parquet(f"{base}/n.parquet").where("id >= 4"), base, "n")
    assert report.rows == 6 and sorted(r["id"] for r in spark.read.parquet(report.location).collect()) == list(range(4, 10))
    assert os.listdir(base.removeprefix("file:")) == ["n.parquet"]


def _all_parts(root):
    roots = [root.removeprefix("file:") + end for end in ("", "__versions")]
    return [os.path.join(d, f) for r in roots for d, _, fs in os.walk(r) for f in fs if f.endswith(".parquet")]


def test_snapshot_reports_where_its_rows_are(spark):
    name, place = "located_" + os.urandom(4).hex(), scratch_path(spark, "located")
    save_snapshot(spark.range(10), name, location=place)
    report = save_snapshot(spark.range(4), name, location=place)
    assert spark.read.parquet(report.location).count() == report.rows == 4 == spark.table(name).count()
    assert load_saved(spark, place).count() == 4
    assert {os.path.dirname(f) for f in _all_parts(place)} == {report.location.removeprefix("file:")}    # old files are gone
    kept = save_snapshot(spark.range(5), name, location=place, keep=1)
    assert len({os.path.dirname(f) for f in _all_parts(place)}) == 2 and spark.read.parquet(kept.location).count() == 5
    moved = save_snapshot(spark.range(6), name, location=scratch_path(spark, "elsewhere"))
    assert spark.table(name).count() == 6 and spark.read.parquet(moved.location).count() == 6
    spark.sql(f"DROP TABLE {name}")


def test_files_of_foreign_tables_are_left_alone(spark):
    name, place = "foreign_" + os.urandom(4).hex(), scratch_path(spark, "foreign")
    spark.range(3).write.parquet(place)
    spark.sql(f"CREATE TABLE {name} (id bigint) USING parquet LOCATION '{place}'")
    save_snapshot(spark.range(5), name)
    assert spark.table(name).count() == 5 and spark.read.parquet(place).count() == 3


def test_managed_snapshot_replaced(spark):
    name = "managed_" + os.urandom(4).hex()
    first = save_snapshot(spark.range(10), name)
    second = save_snapshot(load_saved(spark, name).where("id > 6"), name)
    assert second.rows == 3 and spark.read.parquet(second.location).count() == 3 and not os.path.exists(first.location.removeprefix("file:"))
    spark.sql(f"DROP TABLE {name}")
    assert not _all_parts(second.location)                          # still managed: its files go with it


def test_table_is_there_at_every_moment(spark, monkeypatch):
    """Every statement a same-shape replacement runs leaves a readable table."""
    from pyspark.sql import SparkSession

    name = "always_" + os.urandom(4).hex()
    parts = spark.range(10).selectExpr("id", "cast(id % 2 AS string) AS p", "concat('0', id % 3) AS q")
    for by, seen in ((None, []), (["p", "q"], [])):
        store_table(parts, name + str(bool(by)), provider="parquet", partition_by=by)
        plain = SparkSession.sql

        def watched(self, query, *a, table=name + str(bool(by)), seen=seen, **k):
            out = plain(self, query, *a, **k)
            seen.append(spark.table(table).count())
            return out
        monkeypatch.setattr(SparkSession, "sql", watched)
        store_table(parts.where("id < 4"), name + str(bool(by)), provider="parquet", partition_by=by)
        monkeypatch.undo()
        assert set(seen) == {10, 4} and seen == sorted(seen, reverse=True)
        got = spark.table(name + str(bool(by)))
        assert dict(got.dtypes) == dict(parts.dtypes) and got.select(*parts.columns).exceptAll(parts.where("id < 4")).count() == 0


def test_stopped_replacement_is_completed(spark):
    name = "stopped_" + os.urandom(4).hex()
    save_snapshot(spark.range(3), name)
    save_snapshot(spark.range(5).selectExpr("id AS other"), f"{name}_new_ab")
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_ab")        # here the job is lost
    assert load_saved(spark, name).columns == ["other"]
    assert not spark.catalog.tableExists(f"{name}_old_ab")


def test_failed_replacement_leaves_nothing(spark):
    name, place = "failed_" + os.urandom(4).hex(), scratch_path(spark, "failed")
    save_snapshot(spark.range(3), name, location=place)
    with pytest.raises(Exception, match="no good"):
        save_snapshot(spark.range(3).selectExpr("if(id > 1, raise_error('no good'), id) AS id"), name, location=place)
    assert spark.table(name).count() == 3 and len({os.path.dirname(f) for f in _all_parts(place)}) == 1


def test_stopped_overwrite_is_completed(spark):
    from lakeprep.sources.lake import read_parquet
    base = scratch_path(spark, "swap")
    for k in range(2):
        path = f"{base}/t{k}.parquet"
        local = path.removeprefix("file:")
        spark.range(3).write.parquet(f"{path}.old-ab")
        spark.range(7).write.parquet(f"{path}.new-ab")
        if k:
            store_parquet(read_parquet(spark, path).where("id > 4"), base, f"t{k}")
        assert read_parquet(spark, path).count() == (2 if k else 7) and not os.path.exists(local + ".old-ab")
    with pytest.raises(Exception):
        read_parquet(spark, f"{base}/none.parquet")
