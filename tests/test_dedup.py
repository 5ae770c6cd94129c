import pytest

import millrace as mr
from tests.conftest import values

NAN = float("nan")


def test_counts(people):
    whole = people.drop("at")
    assert values(mr.count_duplicates(whole)) == [(1,)]
    assert values(mr.count_duplicates(whole, ["city"])) == [(2,)]
    assert values(mr.count_duplicates(whole.limit(0))) == [(0,)]


def test_keep_first_and_last(people):
    assert sorted(r["at"] for r in mr.drop_duplicates(people, order_by="at").collect()) == [1, 2, 3]
    assert sorted(r["at"] for r in mr.drop_duplicates(people, keep="last", order_by="at").collect()) == [1, 2, 4]
    assert sorted(r["at"] for r in mr.drop_duplicates(people, ["city"], "last", "at").collect()) == [2, 4]
    assert mr.drop_duplicates(people, ["id"], "any").count() == 3


def test_columns_and_types_survive(people):
    out = mr.drop_duplicates(people, ["city"], order_by="at")
    assert out.schema == people.schema or [f.dataType for f in out.schema] == [f.dataType for f in people.schema]
    assert out.columns == people.columns


def test_case_tokens_and_null_are_different_but_nan_is_null(spark):
    rows = [("a", 1.0, 1), ("A", 1.0, 2), ("N/A", 1.0, 3), (None, 1.0, 4), (None, NAN, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "k string, v double, at int")
    assert values(mr.count_duplicates(df, ["k", "v"])) == [(1,)]
    kept = mr.drop_duplicates(df, ["k", "v"], "first", "at")
    assert sorted(r["at"] for r in kept.collect()) == [1, 2, 3, 4, 5]
    first = [r["v"] for r in kept.collect() if r["at"] == 5]
    assert first[0] != first[0]  # the kept row keeps its own NaN


def test_dropping_twice_changes_nothing(people):
    once = mr.drop_duplicates(people, ["id"], order_by="at")
    assert sorted(values(mr.drop_duplicates(once, ["id"], order_by="at"))) == sorted(values(once))


def test_order_is_required(people):
    with pytest.raises(ValueError):
        mr.drop_duplicates(people)


def test_order_over_several_columns(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 2, "c")], "k string, a int, b string")
    assert values(mr.drop_duplicates(df, ["k"], "first", ["a", "b"])) == [("k", 1, "a")]
    assert values(mr.drop_duplicates(df, ["k"], "last", ["a", "b"])) == [("k", 2, "c")]
