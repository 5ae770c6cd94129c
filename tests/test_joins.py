import random

import pytest
from pyspark.sql import functions as F

import millrace as mr
from tests.conftest import values


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, name string")
    right = spark.createDataFrame([(1, 90), (2, 80), (4, 70)], "id int, score int")
    return left, right


def joined(sides, how, **kw):
    return sorted(values(mr.join_tables(*sides, ["id"], how, **kw)), key=str)


def test_four_joins(sides):
    assert joined(sides, "inner") == [(1, "A", 90), (2, "B", 80)]
    assert joined(sides, "left") == [(1, "A", 90), (2, "B", 80), (3, "C", None)]
    assert joined(sides, "right") == [(1, "A", 90), (2, "B", 80), (4, None, 70)]
    assert joined(sides, "full") == [(1, "A", 90), (2, "B", 80), (3, "C", None), (4, None, 70)]


def test_keys_are_normalised(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, v string")
    right = spark.createDataFrame([(" 1", "p"), ("1.0", "q"), ("2 ", "r")], "ref string, w string")
    out = mr.join_tables(left, right, [("k", "ref")], "full")
    assert out.columns == ["k", "v", "w"]
    assert sorted(values(out), key=str) == [("1", "x", "p"), ("1.0", None, "q"), ("2", "y", "r")]
    words = spark.createDataFrame([("  aB",), ("c",)], "k string")
    assert mr.join_tables(words, spark.createDataFrame([("Ab ", 1)], "k string, n int"), "k").count() == 1


def test_missing_keys(spark):
    left = spark.createDataFrame([(None, 1), ("n/a", 2), ("x", 3)], "k string, l int")
    right = spark.createDataFrame([("--", 10), (None, 20)], "k string, r int")
    assert mr.join_tables(left, right, "k", "inner").count() == 4
    assert mr.join_tables(left, right, "k", "inner", missing_match=False).count() == 0
    assert mr.join_tables(left, right, "k", "full", missing_match=False).count() == 5
    assert mr.join_tables(left, right, "k", "full").count() == 5


def test_names(spark, sides):
    left, right = sides
    other = right.withColumnRenamed("score", "name")
    assert mr.join_tables(left, other, "id").columns == ["id", "name", "name_right"]
    with pytest.raises(ValueError):
        mr.join_tables(left.withColumnRenamed("name", "score").selectExpr("*", "score AS score_right"), right, "id")
    assert mr.join_tables(left, left, "id").columns == ["id", "name", "name_right"]
    with pytest.raises(ValueError):
        mr.join_tables(left, right, [])
    with pytest.raises(ValueError):
        mr.join_tables(left, right, "id", "outer")


def test_cross_product_needs_a_small_right_side(sides, spark):
    left, right = sides
    assert mr.join_tables(left, right, how="cross").count() == 9
    with pytest.raises(ValueError):
        mr.join_tables(left, spark.range(10_001).withColumnRenamed("id", "n"), how="cross")


@pytest.fixture(scope="module")
def skewed(spark):
    """On both sides a third of the rows share one key; others repeat, are missing, or have no partner."""
    rnd = random.Random(1)
    key = lambda: "HOT " if rnd.random() < 0.34 else rnd.choice([None, "-", *[f"k{i}" for i in range(60)]])
    left = spark.createDataFrame([(key(), i) for i in range(240)], "k string, l int")
    right = spark.createDataFrame([(key(), i) for i in range(240)] + [("only", -1)], "k string, r int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("missing_match", [True, False])
def test_split_joins_give_the_same_rows(skewed, how, missing_match):
    plain = values(mr.join_tables(*skewed, "k", how, missing_match, skew="plain"))
    split = values(mr.join_tables(*skewed, "k", how, missing_match, skew="split"))
    auto = values(mr.join_tables(*skewed, "k", how, missing_match))
    assert sorted(plain, key=str) == sorted(split, key=str) == sorted(auto, key=str)
    estimate = mr.join_preview(*skewed, "k", how, missing_match).head()["estimated_rows"]
    assert int(estimate) == len(plain)


def test_hot_keys_are_noticed(skewed, sides):
    from millrace.operators.joins import _hot, _key_columns

    assert _hot(skewed[0], _key_columns(skewed[0], ["k"], True))
    big = sides[0].sparkSession.range(500).selectExpr("id", "id AS v")
    assert not _hot(big, _key_columns(big, ["id"], True))


def test_preview(sides, spark):
    left, right = sides
    row = mr.join_preview(left, right, "id").head()
    assert (row["left_rows"], row["right_rows"], row["matching_rows"], row["only_in_left"], row["only_in_right"]) == (3, 3, 2, 1, 1)
    doubled = left.union(spark.createDataFrame([(1, "A2")], left.schema))
    row = mr.join_preview(doubled, right, "id").head()
    assert (row["duplicate_keys_left"], row["duplicate_keys_right"], int(row["estimated_rows"])) == (1, 0, 3)
    assert int(mr.join_preview(left.limit(0), right, "id", "full").head()["estimated_rows"]) == 3


def test_warnings(sides, spark):
    left, right = sides
    codes = lambda *a: {r["code"] for r in mr.join_warnings(*a).collect()}
    assert codes(left, right, "id", "inner") == {"unmatched_dropped"}
    assert codes(left, right, "id", "full") == set()
    assert codes(left.union(left), right, "id", "left") == {"repeated_keys"}
    assert codes(left.union(left), right.union(right), "id", "left") == {"many_to_many"}
    text = right.selectExpr("CAST(id AS STRING) AS id", "score")
    assert codes(left, text, "id", "left") == {"type_mismatch"}
    ones = spark.createDataFrame([(1,)] * 20, "id int")
    assert "large_result" in codes(ones, ones, "id", "inner")


def test_append(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert values(mr.append([a, b])) == [(1, None), (None, 2)]
    mixed = mr.append([spark.createDataFrame([(1.0, 1)], "v double, n int"), spark.createDataFrame([("z", 2)], "v string, n bigint")])
    assert values(mixed) == [("1", 1), ("z", 2)]
    row = mr.append_preview([mixed, a, b]).head()
    assert (row["common_columns"], row["only_in_first"], row["only_in_rest"], row["total_rows"]) == ([], ["v", "n"], ["x", "y"], 4)
    with pytest.raises(ValueError):
        mr.append([])


def test_products_of_missing_keys_are_refused(spark, monkeypatch):
    import millrace.operators.joins as joins

    df = spark.createDataFrame([(None, 1), ("N/A", 2), ("a", 3)], "k string, v int")
    assert mr.join_tables(df, df, "k").count() == 5
    monkeypatch.setattr(joins, "MISSING_PAIRS", 3)
    with pytest.raises(ValueError, match="missing_match"):
        mr.join_tables(df, df, "k")
    assert mr.join_tables(df, df, "k", missing_match=False).count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("skew", ["auto", "split"])
def test_keys_of_many_pairs_are_joined_in_blocks(spark, monkeypatch, how, skew):
    import millrace.operators.joins as joins

    left = spark.createDataFrame([(None if i % 3 == 0 else str(i % 40), i % 7) for i in range(300)], "k string, v int").repartition(5)
    right = spark.createDataFrame([("n/a" if i % 2 else i % 50 + 20, {"a": i % 5}) for i in range(200)], "k string, w map<string,int>")
    right = right.withColumn("gone", F.lit(None))
    plain = sorted(values(mr.join_tables(left, right, "k", how, skew="plain")), key=str)
    monkeypatch.setattr(joins, "BLOCK_PAIRS", 50)
    blocks = mr.join_tables(left, right, "k", how, skew=skew)
    sizes = blocks.filter("k IS NULL OR k = 'n/a'").groupBy(F.spark_partition_id()).count().collect()
    assert sorted(values(blocks), key=str) == plain
    assert max(r["count"] for r in sizes) < 100 * 100 / 10  # one task made them all


def test_all_pairs_of_missing_keys_can_be_asked_for(spark, monkeypatch):
    import millrace.operators.joins as joins

    df = spark.createDataFrame([(None, 1), ("N/A", 2), ("a", 3)], "k string, v int")
    monkeypatch.setattr(joins, "MISSING_PAIRS", 3)
    assert mr.join_tables(df, df, "k", missing_match=True).count() == 5
