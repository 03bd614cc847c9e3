import pytest

from lakeprep.names import ColumnNotFound
from lakeprep.operators import add_column, convert_type, drop_column, rename_column, select_columns
from lakeprep.operators.columns import spark_type_name


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame([(1.0, 2.0, 3, 4, "5")], "`adj close` double, `adj.close` double, A int, b int, s string")


def test_select_rename_drop_odd_names(odd):
    assert select_columns(odd, ["adj close", "adj.close"]).columns == ["adj close", "adj.close"]
    assert rename_column(odd, "adj.close", "adj_close").columns == ["adj close", "adj_close", "A", "b", "s"]
    assert drop_column(odd, "adj close").columns == ["adj.close", "A", "b", "s"]


def test_exact_case_and_collisions(odd):
    with pytest.raises(ColumnNotFound):
        drop_column(odd, "a")
    with pytest.raises(ColumnNotFound):
        rename_column(odd, "B", "c")
    with pytest.raises(ValueError, match="already exists"):
        rename_column(odd, "A", "b")


def test_add_column(odd):
    out = add_column(odd, "c", "A * 2 + b")
    assert out.columns[-1] == "c" and out.first().c == 10
    out = add_column(odd, "b", "b + 1")            # replace in place
    assert out.columns == odd.columns and out.first().b == 5
    assert add_column(odd, "d", "try_divide(A, 0)").first().d is None


def test_convert(spark):
    df = spark.createDataFrame([(2.7, "1", None), (-2.7, "x", "true")], "f double, s string, t string")
    assert [r[0] for r in convert_type(df, "f", "int64").collect()] == [2, -2]
    assert dict(convert_type(df, "f", "int32").dtypes)["f"] == "int"
    assert [r[1] for r in convert_type(df, "s", "int", strict=False).collect()] == [1, None]
    assert [r[2] for r in convert_type(df, "t", "bool").collect()] == [None, True]
    with pytest.raises(Exception):
        convert_type(df, "s", "int").collect()
    assert spark_type_name("datetime64[ns]") == "timestamp" and spark_type_name("decimal(10,2)") == "decimal(10,2)"


def test_dedupe_names():
    from lakeprep.names import dedupe_names
    assert dedupe_names(["a", "b", "a", "A", "", "a_1"]) == ["a", "b", "a_1", "A_2", "_c4", "a_1_1"]


def test_case_clashes_refused(odd):
    with pytest.raises(ValueError, match="clash"):
        rename_column(odd, "b", "a")          # A exists
    with pytest.raises(ValueError, match="clash"):
        add_column(odd, "B", "1")             # b exists
    assert rename_column(odd, "b", "B").columns[3] == "B"   # changing only the case of itself is fine


def test_strict_convert_without_ansi(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="Cannot convert"):
            convert_type(df, "s", "int").collect()
        assert [r.s for r in convert_type(df, "s", "int", strict=False).collect()] == [1, None, None]
        assert [r.s for r in convert_type(df.where("s != 'x'"), "s", "int").collect()] == [1]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_text_table_is_exact(spark):
    from lakeprep.small import text_table
    rows = [(1, 0.1 + 0.2, "a 'b' \\ \"c\" é\n"), (2, float("inf"), None), (3, -0.0, ""), (-2 ** 62, 5e-324, "x")]
    got = [tuple(r) for r in text_table(spark, rows, "n long, x double, s string").collect()]
    assert got == rows and str(got[2][1]) == "-0.0"
    assert text_table(spark, [], "n long").count() == 0
    assert str(text_table(spark, [(float("nan"),)], "x double").first()[0]) == "nan"
