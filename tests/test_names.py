"""Operators must leave a table's own columns alone, whatever they are called."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import millrace as mr

HELPERS = """n N_ _n _text _value _number _bucket _rbucket _edge _inherited _g0 _r_g0 _size _offset _rank _sort0 _lookup _rule0 _bound0
_bound1 _from _to _k0 _key0 _carried0 _row _nan0 _in_left _l0 _r0 _rkey0 _pos column value num is_text vote rows missing""".split()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "5", None, 1.0), (2, "x", "a", None), (3, "$7", "a", 2.5), (None, "N/A", None, 2.5), (3, "5", "b", None)]
    df = spark.createDataFrame(rows, "at int, t string, g string, v double")
    return df.select("*", *[(F.coalesce("at", F.lit(9)) * 100 + i).alias(c) for i, c in enumerate(HELPERS)]).withColumnRenamed("at", "at")


STEPS = {
    "clean_numbers": lambda d: mr.clean_numbers(d, "t", currency=True),
    "convert_type": lambda d: mr.convert_type(d, "t", "decimal"),
    "fill_previous": lambda d: mr.fill_missing(d, "g", "previous", order_by="at", buckets=4),
    "fill_previous_grouped": lambda d: mr.fill_missing(d, "v", "next", order_by="at", partition_by=["g"], buckets=4),
    "fill_mean": lambda d: mr.fill_missing(d, "v", "mean"),
    "fill_mode": lambda d: mr.fill_missing(d, "g", "mode", order_by="at"),
    "number_rows": lambda d: mr.number_rows(d, [("t", "asc")], "at", name="place", buckets=4),
    "sort_rows": lambda d: mr.sort_rows(d, ["t"], "at"),
    "page": lambda d: mr.page(d, ["t"], "at"),
    "validate": lambda d: mr.validate(d, [{"column": "t", "type": "unique"}, {"column": "v", "type": "not_null"}]).flagged,
    "standardize": lambda d: mr.standardize_categories(d, "g", {f"k{i}": "z" for i in range(80)} | {"a": "A"}),
    "clean_text": lambda d: mr.clean_text(d, "g", "titlecase"),
    "find_replace": lambda d: mr.find_replace(d, "g", "a", "b"),
    "standardize_dates": lambda d: mr.standardize_dates(d, "t"),
    "remove_by_key": lambda d: mr.remove_rows_by_key(d, [77], "at"),
    "search": lambda d: mr.search_rows(d, "", None),
    "outliers": lambda d: mr.remove_outliers(d, "v"),
    "join": lambda d: mr.join_tables(d, d.select("at", F.lit(1).alias("other")).distinct(), "at", "left"),
    "append": lambda d: mr.append([d]),
}


@pytest.mark.parametrize("name", STEPS)
def test_helper_names_are_left_alone(table, name):
    out = STEPS[name](table)
    assert set(table.columns) <= set(out.columns)
    rows = [tuple(r) for r in out.select("at", *HELPERS).distinct().orderBy("at").collect()]
    want = [tuple(r) for r in table.select("at", *HELPERS).distinct().orderBy("at").collect()]
    assert set(rows) <= set(want) and (len(rows) == len(want) or name == "outliers")


def test_counts_with_a_column_n(table):
    assert mr.count_duplicates(table).head()["duplicates"] == 0
    assert mr.profile_dataset(table).head()["row_count"] == 5 and mr.quality_score(table).head()["score"] > 0
    assert mr.profile_columns(table, "at").count() == len(table.columns)
    assert mr.drop_duplicates(table, ["g"], order_by="at").count() == 3


def test_null_order_comes_first(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, at int, v string")
    assert [tuple(r) for r in mr.drop_duplicates(df, ["k"], order_by="at").orderBy("k").collect()] == [("a", None, "x"), ("b", 2, "z")]
    assert [tuple(r) for r in mr.drop_duplicates(df, ["k"], keep="last", order_by="at").orderBy("k").collect()] == [("a", 1, "y"), ("b", 2, "z")]
    gaps = spark.createDataFrame([(None, 5), (1, None), (2, None), (2, None), (3, None)], "at int, v int")
    for buckets in (1, 4, 32):
        assert [r["v"] for r in mr.fill_missing(gaps, "v", "previous", order_by="at", buckets=buckets).collect()] == [5] * 5


@pytest.mark.parametrize(
    "value, text",
    [(1.2345678901234568e-10, "0.00000000012345678901234568"), (1e-7, "0.0000001"), (-2.5e-4, "-0.00025"), (1e21, "1" + "0" * 21), (1.5e16, "15000000000000000"),
     (123456789.125, "123456789.125"), (15.0, "15"), (-0.0, "0"), (0.1, "0.1"), (4.9e-324, "0." + "0" * 323 + "49"), (1.7976931348623157e308, "17976931348623157" + "0" * 292)],
)
def test_doubles_keep_all_digits(spark, value, text):
    got = mr.Cell(d := spark.createDataFrame([(value,)], "v double"), "v")
    assert (row := d.select(got.text).head()[0]) == text and float(row) == value


def test_times_keep_their_fractions(spark):
    times = [dt.datetime(2024, 1, 2, 10, 0, 0, 100000), dt.datetime(2024, 1, 2, 10, 0, 0, 900000), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 10)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert [r[0] for r in df.select(mr.Cell(df, "t").text).collect()] == ["2024-01-02 10:00:00.1", "2024-01-02 10:00:00.9", "2024-01-02", "2024-01-02 10:00:00"]
    assert mr.remove_constant_columns(df.limit(2)).columns == ["t"]


def test_names_that_differ_in_case_only(spark):
    left, right = spark.createDataFrame([(1, "a")], "id int, Name string"), spark.createDataFrame([(1, "b")], "ID int, name string")
    assert mr.join_tables(left, right, [("id", "ID")]).columns == ["id", "Name", "name_right"]
    with pytest.raises(ValueError):
        mr.rename_column(left, "id", "NAME")
    with pytest.raises(ValueError):
        mr.append([left, right])


def test_wide_tables_are_labelled_in_one_step(spark):
    import time

    df = spark.range(5).select(*[(F.col("id") + 10).alias(f"c{i}") for i in range(1000)])
    began = time.time()
    labelled = mr.with_inferred_types(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns[:300]]))
    assert mr.logical_type(labelled, "c299") == "integer" and time.time() - began < 60


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("v,k\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        mr.load_delimited(spark, str(tmp_path), ",").collect()
    (tmp_path / "c.txt").write_text("a;b;c\n1;2;3\n4;5\n")
    assert mr.load_delimited(spark, str(tmp_path / "c.txt")).columns == ["a", "b", "c"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.csv").write_text('k,v\n1,"two\nlines"\n')
    (tmp_path / "m" / "2.csv").write_text("k,v\n2,x\n")
    assert sorted(tuple(r) for r in mr.load_delimited(spark, str(tmp_path / "m"), ",").collect()) == [("1", "two\nlines"), ("2", "x")]


def test_json_layouts_and_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\n{"x": 4, "y": "t"}\n')
    assert sorted(r["x"] for r in mr.load_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    (tmp_path / "c.jsonl").write_text('{"x": 5}\n{"x": 6\n')
    with pytest.raises(Exception):
        mr.load_json(spark, str(tmp_path / "c.jsonl")).collect()
    kept = mr.load_json(spark, str(tmp_path / "c.jsonl"), malformed="rescue").orderBy("x").collect()
    assert [(r["x"], r["_rescued"]) for r in kept] == [(None, {"_record": '{"x": 6'}), (5, {})]
