import pytest

import millrace as mr
from millrace.operators.columns import snake_case
from tests.conftest import values


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, "a", None, "k", "a", 1.0), (2, None, "n/a", "k", None, 2.0), (3, "b", "", None, "b", 3.0)]
    return spark.createDataFrame(rows, "id int, a string, empty string, same string, a2 string, idf double")


def test_remove(wide):
    assert mr.remove_columns(wide, ["a", "nope"]).columns == ["id", "empty", "same", "a2", "idf"]


def test_empty_sparse_constant(wide, spark):
    assert mr.remove_empty_columns(wide).columns == ["id", "a", "same", "a2", "idf"]
    assert mr.remove_sparse_columns(wide, 0.3).columns == ["id", "idf"]
    assert mr.remove_constant_columns(wide).columns == ["id", "a", "empty", "a2", "idf"]
    nothing = wide.limit(0)
    for op in (mr.remove_empty_columns, mr.remove_constant_columns, mr.remove_duplicate_columns, mr.remove_sparse_columns):
        assert op(nothing).columns == wide.columns


def test_duplicate_columns_compare_cell_by_cell(wide, spark):
    assert mr.remove_duplicate_columns(wide).columns == ["id", "a", "empty", "same"]
    shuffled = spark.createDataFrame([("x", "y", "1", 1), ("y", "x", "2", 2)], "a string, b string, t string, n int")
    assert mr.remove_duplicate_columns(shuffled).columns == ["a", "b", "t", "n"]


def test_suggestions(wide):
    got = dict(values(mr.suggest_unnecessary_columns(wide.withColumnRenamed("id", "Unnamed: 0"))))
    assert got == {"empty": "entirely empty", "same": "constant value", "Unnamed: 0": "looks like an index artifact"}


def test_rename(wide):
    assert mr.rename_column(wide, "a", "A_new").columns[1] == "A_new"
    assert mr.rename_column(wide, "a", "a").columns == mr.rename_column(wide, "a", "").columns == wide.columns
    with pytest.raises(ValueError):
        mr.rename_column(wide, "a", "id")


@pytest.mark.parametrize(
    ("name", "want"),
    [(" First Name ", "first_name"), ("orderTotal", "order_total"), ("A - B", "a_b"), ("price (USD)%", "price_usd"), ("été", "t"), ("HTTPCode2X", "httpcode2_x")],
)
def test_snake_case(name, want):
    assert snake_case(name) == want


def test_normalised_names_stay_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`My Col` int, myCol int, `my-col` int")
    assert mr.normalize_column_names(df).columns == ["my_col", "my_col_2", "my_col_3"]


def test_reorder(wide):
    assert mr.reorder_columns(wide, ["idf", "x", "id"]).columns == ["idf", "id"]


def test_split(spark):
    df = spark.createDataFrame([("a . b.c", 1), ("solo", 2), (None, 3), ("N/A", 4), ("x..y", 5)], "v string, n int")
    out = mr.split_column(df, "v", ".", ["p", "q"])
    assert out.columns == ["v", "p", "q", "n"]
    assert values(out, "p", "q") == [("a", "b"), ("solo", None), (None, None), (None, None), ("x", "")]
    with pytest.raises(ValueError):
        mr.split_column(df, "v", ".", ["n"])
    odd = spark.createDataFrame([(r"1\E2",)], "v string")
    assert values(mr.split_column(odd, "v", r"\E", ["a", "b"]), "a", "b") == [("1", "2")]


def test_combine(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("-", "", None), ("x", "y", 2.5)], "p string, q string, r double")
    out = mr.combine_columns(df, ["q", "p", "r"], "all", "+")
    assert out.columns == ["p", "all", "q", "r"]
    assert [r["all"] for r in out.collect()] == ["a+1", "", "y+x+2.5"]


def test_combine_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-0.0, "x"), (0.0, "y"), (None, "z"), (-2.0, "w")], "r double, p string")
    out = mr.combine_columns(df.withColumn("f", df.r.cast("float")), ["p", "r", "f"], "all", " / ")
    assert [r["all"] for r in out.collect()] == ["x / -0 / -0", "y / 0 / 0", "z", "w / -2 / -2"]
