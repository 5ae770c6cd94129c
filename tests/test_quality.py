import pytest
from pyspark.sql import functions as F

import millrace as mr
from tests.conftest import values


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "a", None, 2.5), (2, "n/a", None, 10.0), (3, "b", "", 9.0), (3, "b", "", 9.0)]
    return spark.createDataFrame(rows, "id int, t string, e string, x double")


@pytest.mark.parametrize("approx", [False, True])
def test_column_profiles(table, approx):
    rows = {r["column"]: r for r in mr.profile_columns(table, order_by="id", approx=approx).collect()}
    assert [rows[c]["position"] for c in table.columns] == [0, 1, 2, 3]
    assert (rows["x"]["min"], rows["x"]["max"], rows["x"]["unique_count"]) == ("2.5", "10", 3)
    assert (rows["t"]["missing_count"], rows["t"]["missing_pct"], rows["t"]["examples"]) == (1, 0.25, ["a", "b", "b"])
    assert (rows["e"]["unique_count"], rows["e"]["examples"], rows["e"]["min"]) == (0, [], None)
    assert rows["e"]["quality"] == pytest.approx(0.2)


def test_profile_of_labels(spark):
    df = spark.createDataFrame([("10", "2023-01-05"), ("9", "1/5/2024"), ("x", None)], "n string, d string")
    for name, label in (("n", "integer"), ("d", "date")):
        df = mr.convert_type(df, name, "string").withMetadata(name, {"logical_type": label})
    rows = {r["column"]: r for r in mr.profile_columns(df).collect()}
    assert (rows["n"]["min"], rows["n"]["max"]) == ("9", "10")  # compared as numbers
    assert (rows["d"]["min"], rows["d"]["max"]) == ("1/5/2024", "2023-01-05")  # compared as text


def test_empty_table(table):
    rows = mr.profile_columns(table.limit(0)).collect()
    assert len(rows) == 4 and {(r["missing_count"], r["missing_pct"], r["unique_count"], r["quality"]) for r in rows} == {(0, 0.0, 0, 1.0)}
    assert values(mr.profile_dataset(table.limit(0))) == [(0, 4, 0.0, 0)]
    assert mr.quality_score(table.limit(0)).head()["score"] == 100


def test_constant_column_quality(spark):
    df = spark.createDataFrame([("k",), ("k",), ("n/a",), ("k",)], "c string")
    assert mr.profile_columns(df).head()["quality"] == pytest.approx(1 - 0.25 * 0.8 - 0.15)


def test_table_profile_and_score(table):
    assert values(mr.profile_dataset(table)) == [(4, 4, 5 / 16, 1)]
    row = mr.quality_score(table, {"t": ("integer", True), "x": ("boolean", False)}).head()
    assert row["missing_pct"] == 5 / 16 and row["duplicate_pct"] == 0.25
    assert row["type_issue_pct"] == 3 / 16 and row["invalid_pct"] == 4 / 16
    assert row["score"] == round(100 * (1 - 0.4 * 5 / 16 - 0.25 / 4 - 0.2 * 4 / 16 - 0.15 * 3 / 16))


def test_score_cap(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(100)], "v string")
    assert mr.quality_score(df, {"v": ("integer", True)}, cap=20).head()["type_issue_pct"] == 0.2
    assert mr.quality_score(df, {"v": ("integer", True)}).head()["type_issue_pct"] == 1.0


def test_outliers(spark):
    data = [float(v) for v in range(1, 101)] + [1000.0, None]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    found = mr.detect_outliers(df, "v")
    q1, q3 = 26.0, 76.0  # ranks floor(101/4) and floor(303/4) of the sorted values
    assert (found.low, found.high) == (q1 - 75, q3 + 75)
    assert values(found.rows) == [(1000.0,)]
    assert mr.remove_outliers(df, "v").count() == 101
    assert values(mr.detect_outliers(df, "v", "zscore").rows) == [(1000.0,)]
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert mr.detect_outliers(same, "v", "zscore").rows.count() == 0
    nothing = mr.detect_outliers(df.limit(0), "v")
    assert (nothing.low, nothing.high, nothing.rows.count()) == (0.0, 0.0, 0)


def test_outliers_in_text_columns_keep_other_cells(spark):
    df = spark.createDataFrame([(str(v),) for v in [*range(50), 9999]] + [("abc",), (None,)], "v string")
    assert mr.remove_outliers(df, "v").count() == 52
    assert mr.detect_outliers(df, "v", nulls_as_zero=True).rows.count() == 1


def test_rules(spark):
    rows = [("a@b.co", "5", "2020-01-01"), ("bad", "-1", "2999-01-01"), ("x y@z.de", "abc", "soon"), (None, "n/a", ""), ("a@b.co", "7", "1/1/1990")]
    df = spark.createDataFrame(rows, "mail string, n string, d string")
    rules = [
        {"column": "mail", "type": "email"},
        {"column": "mail", "type": "unique"},
        {"column": "mail", "type": "not_null"},
        {"column": "n", "type": "range", "min": 0, "max": 6},
        {"column": "n", "type": "non_negative", "label": "n is not negative"},
        {"column": "d", "type": "not_future_date", "as_of": "2024-01-01"},
        {"column": "d", "type": "regex", "pattern": "^[0-9]"},
        {"column": "d", "type": "regex", "pattern": "(", "label": "broken pattern"},
    ]
    report = mr.validate(df, rules)
    got = {r["rule"]: (r["valid_count"], r["invalid_count"]) for r in report.rules.collect()}
    assert got == {
        "mail email": (3, 2), "mail unique": (3, 2), "mail not_null": (4, 1), "n range": (2, 3), "n is not negative": (3, 2),
        "d not_future_date": (4, 1), "d regex": (4, 1), "broken pattern": (5, 0),
    }
    assert values(report.totals) == [(5, 5, 0)]
    assert report.valid_rows.count() + report.invalid_rows.count() == 5
    marks = {r["n"]: r["_violations"] for r in report.flagged.collect()}
    assert marks["5"] == ["mail unique"] and marks["n/a"] == ["mail not_null"]


def test_validation_without_rules(people):
    report = mr.validate(people, [])
    assert values(report.totals) == [(4, 0, 4)] and report.rules.count() == 0 and report.valid_rows.columns == people.columns


def test_rule_specs_are_checked(people):
    with pytest.raises(ValueError):
        mr.ValidationRule("age", "no_such_rule")
    twice = mr.validate(people, [{"column": "age", "type": "range", "min": 40}, {"column": "age", "type": "range", "max": 40}])
    assert values(twice.rules, "rule", "invalid_count") == [("age range", 1), ("age range 2", 2)]
    assert mr.ValidationRule("d", "not_future_date").as_of is not None


def test_unique_counts_a_value_held_by_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).cast("string").alias("v"))
    row = mr.validate(df, [{"column": "v", "type": "unique"}]).rules.head()
    assert (row["valid_count"], row["invalid_count"]) == (1000, 2000)


def test_unique_may_pass_the_first_of_equal_values(spark):
    rows = [(3, "a"), (1, "a"), (None, "b"), (2, "b"), (5, "a"), (4, "c"), (6, None), (7, "n/a")]
    df = spark.createDataFrame(rows, "at int, v string")
    report = mr.validate(df, [{"column": "v", "type": "unique"}, {"column": "v", "type": "unique", "first_by": "at"}])
    assert [(r["rule"], r["valid_count"], r["invalid_count"]) for r in report.rules.collect()] == [("v unique", 3, 5), ("v unique 2", 5, 3)]
    assert sorted(r["at"] for r in report.invalid_rows.filter("array_contains(_violations, 'v unique 2')").collect()) == [2, 3, 5]
    with pytest.raises(ValueError):
        mr.validate(df, [{"column": "v", "type": "not_null", "first_by": "at"}])


def test_the_unique_query_counts_as_its_sql_where_times_repeat(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    path = str(tmp_path / "events.parquet")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (i // 3) AS ts FROM range(20) t(i)) TO '{path}'""")
    want = duckdb.sql(entry.oracle_sql()["validate_unique_ts"].replace("FROM events", f"FROM '{path}'")).fetchall()
    assert [tuple(r) for r in entry.queries()["validate_unique_ts"](spark, str(tmp_path)).collect()] == want
