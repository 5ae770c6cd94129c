import pytest

import millrace as mr
from tests.conftest import values


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_rows_with_missing(people):
    assert ids(mr.remove_rows_with_missing(people)) == [1]
    assert ids(mr.remove_rows_with_missing(people, ["age"])) == [1, 3, 3]


def test_filter_one_rule_and_or(people):
    assert ids(mr.filter_rows(people, [("city", "eq", "lyon")])) == [1, 2]
    assert ids(mr.filter_rows(people, [("id", "eq", "1"), ("id", "eq", "3")], "OR")) == [1, 3, 3]
    assert ids(mr.filter_rows(people, [("id", "eq", "3"), ("city", "notempty")], "AND")) == []
    assert ids(mr.filter_rows(people, [])) == [1, 2, 3, 3]


@pytest.mark.parametrize(
    ("op", "value", "want"),
    [
        ("eq", "ABC", [1]), ("neq", "abc", [2, 5, 6]), ("gt", "5", [2]), ("lt", "100", [2, 5]), ("gte", "10", [2]), ("lte", "", [5]),
        ("gt", "x", []), ("contains", "B", [1]), ("contains", "%", [6]), ("startswith", "1", [2]), ("endswith", "_", [6]),
        ("empty", "", [3, 4]), ("notempty", "", [1, 2, 5, 6]), ("no_such_op", "", [1, 2, 5, 6]),
    ],
)
def test_comparisons_on_text(spark, op, value, want):
    df = spark.createDataFrame([(1, "abc"), (2, "10"), (3, None), (4, "n/a"), (5, "-3"), (6, "x%_")], "id int, v string")
    assert ids(mr.filter_rows(df, [{"column": "v", "op": op, "value": value}])) == want


@pytest.mark.parametrize(
    ("op", "value", "want"), [("eq", "2", [2]), ("eq", "2.0", []), ("neq", "2", [1, 4]), ("gte", "1.5", [2, 4]), ("endswith", ".5", [1])]
)
def test_comparisons_on_numbers(spark, op, value, want):
    df = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, float("nan")), (4, 7.0), (5, None)], "id int, v double")
    assert ids(mr.filter_rows(df, [("v", op, value)])) == want
    if op not in ("endswith",) and value != "1.5":
        whole = spark.createDataFrame([(1, 1), (2, 2), (4, 7), (5, None)], "id int, v bigint")
        assert ids(mr.filter_rows(whole, [("v", op, value)])) == want


def test_infinite_numbers_do_not_compare(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, 3.0)], "id int, v double")
    assert ids(mr.filter_rows(df, [("v", "gt", "0")])) == [2]


def test_numeric_bound_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "v").write.parquet(str(tmp_path / "t"))
    plan = mr.filter_rows(spark.read.parquet(str(tmp_path / "t")), [("v", "gt", "4")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,4)" in text


def test_removed_and_kept_rows_add_up(people):
    rules = [("city", "eq", "Lyon"), ("age", "gt", "40")]
    for how in ("AND", "OR"):
        kept, gone = mr.filter_rows(people, rules, how), mr.remove_rows_matching(people, rules, how)
        assert kept.count() + gone.count() == people.count()


def test_removing_without_rules_is_refused(people):
    with pytest.raises(ValueError):
        mr.remove_rows_matching(people, [])


def test_empty_rows(spark):
    df = spark.createDataFrame([("a", None), ("", "N/A"), (None, "-")], "id string, b string")
    assert values(mr.remove_empty_rows(df)) == [("a", None)]


def test_rows_by_key(people, spark):
    assert ids(mr.remove_rows_by_key(people, [2, 3], "id")) == [1]
    bad = spark.createDataFrame([(1, 1), (1, 1), (3, 4)], "id int, at int")
    assert ids(mr.remove_rows_by_key(people, bad, ["id", "at"])) == [2, 3]


def test_search(people):
    assert ids(mr.search_rows(people, " LYO ")) == [1, 2]
    assert ids(mr.search_rows(people, "4", ["age"])) == [3, 3]
    assert ids(mr.search_rows(people, "  ")) == [1, 2, 3, 3]
    assert ids(mr.search_rows(people, "no such text")) == []


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a.b` int, `my col` string")
    assert values(mr.remove_rows_with_missing(df, ["my col"])) == [(1, "x")]
    assert mr.fill_missing(df, "my col", "custom", "y").count() == 2
    assert mr.rename_column(df, "a.b", "a").columns == ["a", "my col"]
