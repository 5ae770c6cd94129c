import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import millrace as mr
from millrace.functions.cells import MISSING_TOKENS, WHITESPACE_CHARS
from millrace.functions.patterns import replacement_for_spark
from tests.conftest import values


def text(spark, data, op, **kw):
    df = spark.createDataFrame([(v,) for v in data], "v string")
    return [r[0] for r in mr.clean_text(df, "v", op, **kw).collect()]


def test_text_operations(spark):
    assert text(spark, ["  a \t  b  ", " N/A ", None], "trim") == ["a b", " N/A ", None]
    assert text(spark, ["aB", "NONE"], "lowercase") == ["ab", "NONE"]
    assert text(spark, ["aß"], "uppercase") == ["ASS"]
    assert text(spark, ["(abc mary-JANE o'NEIL 3RD", "éclair à la"], "titlecase") == ["(Abc Mary-jane O'neil 3rd", "éClair à La"]
    assert text(spark, ["éclair à la"], "titlecase", unicode=True) == ["Éclair À La"]
    assert text(spark, [r"a!b-c_d\e~"], "remove_punctuation") == [r"abcd\e"]
    assert text(spark, ["éclair_1! x"], "remove_special") == ["clair_1 x"]
    assert text(spark, ["éclair_1! x"], "remove_special", unicode=True) == ["éclair_1 x"]


def test_title_case_of_any_text(spark):
    r, pieces = random.Random(5), [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "a", "B", "cd", "EF", "_", "9", "-", "'", "(", "\"", "\x01", "\x1f", "é", "Ü", "ß", "ÿ", "µ", "İ", "Σ", "ǆ", "漢", "😀", "\x85"]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 14))) for _ in range(4000)]
    spaces = re.escape(WHITESPACE_CHARS)
    want = [re.sub(rf"[A-Za-z0-9_][^{spaces}]*", lambda m: m[0][0].upper() + m[0][1:].lower(), t) for t in texts]
    missing = [t.strip(WHITESPACE_CHARS).lower() in MISSING_TOKENS for t in texts]
    assert text(spark, texts, "titlecase") == [t if m else w for t, w, m in zip(texts, want, missing)]


@pytest.mark.parametrize("op", ["trim", "lowercase", "uppercase", "titlecase", "remove_punctuation", "remove_special"])
def test_text_operations_on_long_cells(spark, op):
    long = ["a b" * 350_000, "word, " * 180_000, "x" * 1_000_000, " " * 1_000_000 + "x", "a\n" * 500_000, "é " * 400_000, "(" * 1_000_000, "\u3000a" * 300_000]
    assert len(text(spark, long, op)) == len(text(spark, long, op, unicode=True)) == len(long)


def test_wide_spaces(spark):
    assert text(spark, ["a\u2003 \u00a0b\ufeff", "a\nb", "a \t c"], "trim") == ["a b", "a b", "a c"]
    assert text(spark, ["aB\u00a0cD eF"], "titlecase") == ["Ab\u00a0Cd Ef"]
    assert text(spark, ["a\u3000-b\u200b"], "remove_special") == ["a\u3000b"]


def test_text_operations_on_numbers(spark):
    df = spark.createDataFrame([(15.0,), (None,)], "v double")
    assert values(mr.clean_text(df, "v", "trim")) == [("15",), (None,)]


def test_find_replace(spark):
    df = spark.createDataFrame([("a.b.c",), ("n/a",), ("x-12 y-3",)], "v string")
    run = lambda *a, **k: [r[0] for r in mr.find_replace(df, "v", *a, **k).collect()]
    assert run(".", "$1") == ["a$1b$1c", "n/a", "x-12 y-3"]
    assert run(r"([a-z])-(\d+)", "$2$$$1[$&]$3\\", regex=True) == ["a.b.c", "n/a", "12$x[x-12]$3\\ 3$y[y-3]$3\\"]
    assert run("(", "!", regex=True) == ["a.b.c", "n/a", "x-12 y-3"]
    with pytest.raises(ValueError):
        run("", "x")


def test_replacement_syntax():
    assert replacement_for_spark("$<name>-$1", r"(?<name>a)") == "${name}-$1"
    assert replacement_for_spark("$1", r"[(]x\(") == r"\$1"
    with pytest.raises(ValueError):
        replacement_for_spark("$`", "a")


@pytest.mark.parametrize("extra", [0, 100])
def test_categories(spark, extra):
    df = spark.createDataFrame([(" m",), ("MALE",), ("F",), ("N/A",), (None,)], "v string")
    mapping = {"M ": "Male", "male": "Male", "f": " ", **{f"k{i}": "z" for i in range(extra)}}
    assert sorted(values(mr.standardize_categories(df, "v", mapping)), key=str) == sorted(
        [("Male",), ("Male",), ("F",), ("N/A",), (None,)], key=str
    )


def test_distinct_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (" ",), ("b",), (None,), ("n/a",)], "v string")
    assert values(mr.distinct_values(df, "v")) == [("a", 1), ("b", 2), ("n/a", 1)]
    assert values(mr.distinct_values(df, "v", 1)) == [("a", 1)]


def test_numbers(spark):
    df = spark.createDataFrame([("$1,234.50",), ("12%",), ("abc",), ("n/a",), ("(5)",), ("-2.5",)], "v string")
    out = mr.clean_numbers(df, "v", commas=True, currency=True)
    assert [r["v"] for r in out.collect()] == [1234.5, 12.0, 0.0, None, 5.0, -2.5]
    strict = mr.clean_numbers(df, "v", commas=True, currency=True, empty_as="invalid")
    assert [(r["v"], r["_rescued"]) for r in strict.collect()][2] == (None, {"v": "abc"})
    percent = mr.clean_numbers(df, "v", percent=True, on_invalid="keep")
    assert [r["v"] for r in percent.collect()] == ["$1,234.50", "12", "abc", None, "(5)", "-2.5"]
    assert [r["v"] for r in mr.clean_numbers(df, "v", round=0, on_invalid="null").collect()][5] == -3.0


def test_rescued_text_is_replaced_not_piled_up(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    out = mr.convert_type(mr.convert_type(df, "a", "integer"), "b", "date")
    assert out.head()["_rescued"] == {"a": "x", "b": "y"}
    again = mr.convert_type(out.withColumn("a", F.lit("z")), "a", "integer")
    assert again.head()["_rescued"] == {"a": "z", "b": "y"}
    fixed = mr.convert_type(out.withColumn("a", F.lit("7")), "a", "integer")
    assert fixed.head()["_rescued"] == {"b": "y"}


def test_dates(spark):
    df = spark.createDataFrame([("2023-01-05", 1), ("12/31/1999", 2), ("soon", 3), ("n/a", 4), (None, 5)], "d string, n int")
    assert [r["d"] for r in mr.standardize_dates(df, "d", "DD-MM-YYYY").collect()] == ["05-01-2023", "31-12-1999", "soon", "n/a", None]
    assert [r["d"] for r in mr.standardize_dates(df, "d", "MM/DD/YYYY").collect()][0] == "01/05/2023"
    parts = df
    for p in ("weekday", "day", "month", "year"):
        parts = mr.extract_date_part(parts, "d", p)
    assert parts.columns == ["d", "d_year", "d_month", "d_day", "d_weekday", "n"]
    assert values(parts)[:3] == [("2023-01-05", 2023, 1, 5, "Thursday", 1), ("12/31/1999", 1999, 12, 31, "Friday", 2), ("soon", None, None, None, None, 3)]


def test_dates_of_typed_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 5),)], "d timestamp_ntz")
    assert values(mr.standardize_dates(df, "d", "MM/DD/YYYY")) == [("02/29/2024",)]
