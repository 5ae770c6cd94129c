import random

import pytest
from pyspark.sql import functions as F

import millrace as mr
from millrace.plans.buckets import SortKey, range_bucket
from tests.conftest import values


def filled(df, column, strategy, **kw):
    return [r[0] for r in mr.fill_missing(df, column, strategy, **kw).orderBy("at").select(column).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, None, "n/a", 1), (2, 4.0, "x", None), (3, None, None, 2), (4, 1.0, "y", 4), (5, 10.0, "y", None), (6, float("nan"), "x", 9)]
    return spark.createDataFrame(rows, "at int, v double, t string, i bigint")


def test_counts(gaps):
    assert values(mr.count_missing(gaps, ["v", "t", "i"])) == [(3, 2, 2)]


def test_statistics(gaps):
    assert filled(gaps, "v", "mean") == [5.0, 4.0, 5.0, 1.0, 10.0, 5.0]
    assert filled(gaps, "v", "median") == [4.0, 4.0, 4.0, 1.0, 10.0, 4.0]
    assert filled(gaps, "i", "median") == [1.0, 3.0, 2.0, 4.0, 3.0, 9.0]
    assert filled(gaps, "t", "mode", order_by="at") == ["x", "x", "x", "y", "y", "x"]  # two each: x came first


def test_number_text_columns(spark):
    df = spark.createDataFrame([(1, "1"), (2, "n/a"), (3, "2"), (4, "abc")], "at int, v string")
    assert filled(df, "v", "mean") == ["1", "1.5", "2", "abc"]


def test_nothing_to_derive_from(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "at int, v double")
    for strategy in ("mean", "median", "mode"):
        assert filled(df, "v", strategy, order_by="at") == [None, None]


def test_constants(gaps):
    assert filled(gaps, "v", "zero") == [0.0, 4.0, 0.0, 1.0, 10.0, 0.0]
    assert filled(gaps, "t", "custom", value="Z") == ["Z", "x", "Z", "y", "y", "x"]
    assert filled(gaps, "i", "custom", value="7") == [1, 7, 2, 4, 7, 9]
    with pytest.raises(ValueError):
        mr.fill_missing(gaps, "i", "custom", "seven")
    with pytest.warns(UserWarning, match="missing"):
        assert filled(gaps, "t", "custom", value="Unknown")[0] == "Unknown"


def test_carry(gaps):
    assert filled(gaps, "t", "previous", order_by="at") == ["n/a", "x", "x", "y", "y", "x"]
    assert filled(gaps, "t", "next", order_by="at") == ["x", "x", "y", "y", "y", "x"]
    assert filled(gaps, "i", "next", order_by="at") == [1, 2, 2, 4, 9, 9]


@pytest.mark.parametrize("direction", ["previous", "next"])
@pytest.mark.parametrize("grouped", [False, True])
def test_carry_over_many_ranges_equals_a_plain_loop(spark, direction, grouped):
    """One group holds most rows, order values tie on the leading key, and long gaps cross many ranges."""
    rnd = random.Random(5)
    rows = [
        (i, i // 40, None if rnd.random() < 0.7 or 300 < i < 700 else rnd.randint(1, 9), rnd.choice([None, "a", "hot", "hot", "hot", "hot"]))
        for i in range(1000)
    ]
    df = spark.createDataFrame(rows, "id int, day int, v int, g string").repartition(7)
    out = mr.fill_missing(df, "v", direction, order_by=["day", "id"], partition_by=["g"] if grouped else None, buckets=32)
    got = {r["id"]: r["v"] for r in out.collect()}
    last, want = {}, {}
    for i, _, v, g in rows if direction == "previous" else reversed(rows):
        key = g if grouped else 0
        last[key] = v if v is not None else last.get(key)
        want[i] = last[key]
    assert got == want


def test_fill_needs_an_order(gaps):
    with pytest.raises(ValueError):
        mr.fill_missing(gaps, "v", "previous")


def test_one_range_asked_for_is_cut_where_it_would_hold_too_many_rows(spark, monkeypatch):
    rows = [(i if i else None, i if i % 5 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "place int, v int").repartition(7)
    key = [SortKey(F.col("place"))]
    assert df.select(range_bucket(df, key, 1).alias("b")).distinct().count() == 1
    monkeypatch.setattr("millrace.plans.buckets.ROWS_PER_BUCKET", 100)
    sizes = df.groupBy(range_bucket(df, key, 1)).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 300
    out = mr.fill_missing(df, "v", "previous", order_by="place", buckets=1).collect()
    assert {r["place"] or 0: r["v"] for r in out} == {i: i // 5 * 5 for i in range(1000)}
