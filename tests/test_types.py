import datetime as dt

import pytest

import millrace as mr
from tests.conftest import values


def typed(spark, data, **kw):
    df = spark.createDataFrame([(v,) for v in data], "v string")
    return mr.infer_types(df, **kw)["v"]


def test_votes(spark):
    assert typed(spark, ["Yes", "n", "TRUE", "0", "n/a", None]) == "boolean"
    assert typed(spark, ["12", "-22", "333"] * 3 + ["x"]) == "integer"
    assert typed(spark, ["12", "-.5", "2.5"]) == "decimal"
    assert typed(spark, ["2023-01-05", "1/5/23", "12-31-1999"]) == "date"
    assert typed(spark, ["2023-02-30", "a", "b"]) == "string"
    assert typed(spark, [None, "", "N/A"]) == "string"
    assert typed(spark, [f"id{i}" for i in range(30)]) == "string"
    assert typed(spark, ["a", " A", "b"]) == "category"
    assert typed(spark, ["a", "b"]) == "string"  # every value differs
    assert typed(spark, [f"w{i % 20}" for i in range(300)]) == "string"
    assert typed(spark, [f"w{i % 20}" for i in range(400)]) == "category"


def test_majority_is_nine_in_ten(spark):
    assert typed(spark, [str(i + 10) for i in range(9)] + ["oops"]) == "integer"
    assert typed(spark, [str(i + 10) for i in range(8)] + ["oops", "no way"]) == "string"


def test_typed_cells(spark):
    assert typed(spark, ["0", "1", "1"]) == "boolean"
    assert typed(spark, ["0", "1", "1"], cells="typed") == "integer"
    assert typed(spark, ["1e3", "2.0"], cells="typed") == "integer"
    assert typed(spark, ["true", "false"], cells="typed") == "boolean"
    df = spark.createDataFrame([(1, 1.5, True, 2.0, dt.date(2024, 1, 1))], "a int, b double, c boolean, d double, e date")
    assert mr.infer_types(df) == {"a": "integer", "b": "decimal", "c": "boolean", "d": "integer", "e": "date"}


def test_sample_of_the_first_cells(spark):
    df = spark.createDataFrame([(i, "7" if i < 20 else "word%d" % i) for i in range(200)], "at int, v string")
    assert mr.infer_types(df, ["v"], sample=20, order_by="at") == {"v": "integer"}
    assert mr.infer_types(df, ["v"]) == {"v": "string"}


def test_labels_live_in_the_metadata(spark):
    df = mr.with_inferred_types(spark.createDataFrame([("1", "x")], "n string, t string"))
    assert mr.logical_type(df, "n") == "boolean"
    assert df.schema["n"].metadata["inferred"] is True
    out = mr.convert_type(df, "n", "integer")
    assert (mr.logical_type(out, "n"), out.schema["n"].metadata["inferred"]) == ("integer", False)


def converted(spark, data, type, ddl="string", **kw):
    df = spark.createDataFrame([(v,) for v in data], f"v {ddl}")
    return [r["v"] for r in mr.convert_type(df, "v", type, **kw).collect()]


def test_conversions(spark):
    assert converted(spark, ["5", "not a number", "10", "1,234.9", "-7.9", "n/a"], "integer") == [5, None, 10, 1234, -7, None]
    assert converted(spark, ["9007199254740993"], "integer") == [9007199254740993]
    assert converted(spark, ["2.5", "1e2", "x"], "decimal") == [2.5, 100.0, None]
    assert converted(spark, ["Yes", "0", "maybe"], "boolean") == [True, False, None]
    assert converted(spark, [1, 0, 7], "boolean", "int") == [True, False, None]
    assert converted(spark, [True], "integer", "boolean") == [None]
    assert converted(spark, [2.9, float("nan")], "integer", "double") == [2, None]
    assert converted(spark, ["1/5/2023", "x"], "date") == [dt.date(2023, 1, 5), None]
    assert converted(spark, [" a ", "N/A"], "string") == ["a", None]
    assert converted(spark, [15.0], "category", "double") == ["15"]


def test_failed_cells_are_kept(spark):
    df = spark.createDataFrame([("5",), ("not a number",), ("10",)], "n string")
    out = mr.convert_type(df, "n", "integer")
    assert [(r["n"], r["_rescued"]) for r in out.collect()] == [(5, {}), (None, {"n": "not a number"}), (10, {})]
    kept = mr.convert_type(df, "n", "integer", on_invalid="keep")
    assert values(kept) == [("5",), ("not a number",), ("10",)]
    with pytest.raises(ValueError):
        mr.convert_type(df, "n", "integer", on_invalid="drop")


def test_invalid_values(spark):
    df = spark.createDataFrame([(i, f"x{i}" if i % 2 else str(i)) for i in range(100)], "at int, v string")
    got = [r[0] for r in mr.invalid_values(df, "v", "decimal", "at").collect()]
    assert got == [f"x{i}" for i in range(1, 40, 2)]
