import pytest

from lakeprep.functions.identifiers import clean_identifier, folder_name, job_identifier, split_lake_path
from lakeprep.functions.rules import classify, rule, rules_sql

# input -> table name, job name, folder name, (full path, base, name)
PATHS = [
    ("name", "name", "name", "name", ("hdfs://localhost:9000/name", "hdfs://localhost:9000", "name")),
    ("dir/name", "name", "dir/name", "dir/name", ("hdfs://localhost:9000/dir/name", "hdfs://localhost:9000/dir", "name")),
    ("hdfs://h:9000/a/b", "b", "hdfs://h:9000/a/b", "b", ("hdfs://h:9000/a/b", "hdfs://h:9000/a", "b")),
    ("http://host/x/my-file.v2", "my_file_v2", "http://host/x/my_file_v2", "http://host/x/my-file.v2",
     ("hdfs://host/x/my-file.v2", "hdfs://host/x", "my_file_v2")),
    ("data/Cars Sales/", "cars_sales", "data/Cars_Sales/", "data/cars_sales/",
     ("hdfs://localhost:9000/data/Cars Sales", "hdfs://localhost:9000/data", "cars_sales")),
    ("  asw.py  ", "asw", "asw", "asw.py", ("hdfs://localhost:9000/asw.py", "hdfs://localhost:9000", "asw_py")),
    ("https://h/a b/C.D", "c_d", "https://h/a_b/C_D", "https://h/a_b/c.d", ("hdfs://h/a b/C.D", "hdfs://h/a b", "c_d")),
    ("/abs/path/", "path", "/abs/path/", "/abs/path/", ("hdfs://localhost:9000/abs/path", "hdfs://localhost:9000/abs", "path")),
]


def names_of(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return df.select("p", clean_identifier("p").alias("t"), job_identifier("p").alias("j"),
                     folder_name("p").alias("f"), split_lake_path("p").alias("s")).collect()


def test_identifiers_of_a_table(spark):
    got = {r.p: (r.t, r.j, r.f, (r.s.full, r.s.base, r.s.name)) for r in names_of(spark, [p[0] for p in PATHS])}
    for path, *want in PATHS:
        assert got[path] == tuple(want), path


REQUESTS = [
    ("please schedule the cars job", "RUN_AIRFLOW_SCHEDULE"),
    ("run on airflow", "RUN_AIRFLOW"),
    ("push sql to hdfs now", "MYSQL_TO_HDFS"),
    ("store in mysql", "PUSH_MYSQL"),
    ("save as ICEBERG table", "STORE_HDFS_ICEBERG"),
    ("upload it", "STORE_HDFS"),
    ("drop null rows then save", "STORE_HDFS"),      # two rules hit: the earlier one wins
    ("remove null values", "REMOVE_NULLS:drop"),
    ("fill null", "REMOVE_NULLS:fill"),
    ("any duplicate?", "REMOVE_DUPLICATES"),
    ("find null", "FIND_NULLS"),
    ("show schema", "DETECT_SCHEMA"),
    ("write pyspark", "GENERATE_PYSPARK"),
    ("a pipeline", "BUILD_PIPELINE"),
    ("generate sql", "GENERATE_SQL"),
    ("load mysql table", "LOAD_MYSQL"),
    ("hello there", "UNKNOWN"),
    (None, "UNKNOWN"),
]


def test_default_rules_first_match(spark):
    df = spark.createDataFrame(REQUESTS, "text string, want string")
    for r in df.select("want", classify("text").alias("got")).collect():
        assert r.got == r.want


def test_custom_rules_and_sql(spark):
    rules = [rule("a", ["x"], none_of=["y"]), rule("b", ["y"])]
    df = spark.createDataFrame([("x",), ("xy",), ("z",)], "t string")
    assert [r[0] for r in df.select(classify("t", rules, "none")).collect()] == ["a", "b", "none"]
    assert rules_sql("t", rules, "none").startswith("CASE WHEN")
    with pytest.raises(ValueError):
        classify("t", [rule("empty", [])])


def test_needed_keywords_keep_meaning():
    r = rule("x", ["iceberg", "icebe", "ICEBR", "icebrg", "ice berg"])
    assert r.needed_keywords() == ["icebe", "icebr", "ice berg"]
    for text in ["iceberg", "icebrg", "ice berg", "icb"]:
        full = any(k.lower() in text for k in r.any_of)
        assert full == any(k in text for k in r.needed_keywords())


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402

_paths = st.lists(st.sampled_from(["/", " ", "-", ".", "a", "B", "py", ".py", ":", "http://", "https://",
                                   "hdfs://", "\t", "x_y"]), max_size=10).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_paths, min_size=1, max_size=10))
def test_identifier_properties(spark, paths):
    got = names_of(spark, paths)
    again = {r.p: r.t for r in names_of(spark, [r.t for r in got])}
    for r in got:
        assert not set(r.t) & set(" -.") and r.t == r.t.lower() and "/" not in r.t.rstrip("/")
        assert ".py" in r.t or r.t != r.t.strip() or again[r.t] == r.t  # a clean name stays
        assert not set(r.f) & set(" ") and r.f == r.f.lower()
        assert r.s.full.startswith("hdfs://") and not set(r.s.name) & set(" -.")
        if r.s.name != "data":
            assert r.s.full.rstrip("/").startswith(r.s.base) and "/" not in r.s.name


_fragments = st.lists(st.sampled_from(["SQL", "my", "sql to ", "hdfs", "ice", "berg", "Sched", "ule", "fill ",
                                       "null", "push", " ", "cron", "duplicate", "x"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), _fragments), min_size=1, max_size=12))
def test_rules_match_first_rule_model(spark, texts):
    from lakeprep.functions.rules import DEFAULT_LABEL, DEFAULT_RULES

    def model(text):
        msg = (text or "").lower()
        for r in DEFAULT_RULES:
            if any(k.lower() in msg for k in r.any_of) and not any(k.lower() in msg for k in r.none_of):
                return r.label
        return DEFAULT_LABEL

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", classify("t").alias("label")).collect():
        assert r.label == model(r.t), r.t
