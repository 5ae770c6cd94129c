import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import files_and_recipes
from checks.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, size", [("json_mixed_layouts", "JSON_BLOCK"), ("load_many_files", "FILE_KEYS")])
def test_files_hold_blocks_of_keys(spark, con, monkeypatch, name, size):
    """No file and no task has to hold a whole part of the table, and the result is the same."""
    paths, scratch_path = [], files_and_recipes.scratch_path
    monkeypatch.setattr(files_and_recipes, "scratch_path", lambda *a: paths.append(scratch_path(*a)) or paths[-1])
    monkeypatch.setattr(files_and_recipes, size, 40)
    ok, note = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
    if name == "load_many_files":
        files = spark.read.parquet(f"{paths[0]}.parquet").groupBy("part", F.input_file_name().alias("f")).agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
        held = sorted(files.collect(), key=lambda r: r["f"])
        assert len(held) > 20 and all(a["high"] < b["low"] for a, b in zip(held, held[1:]))
    else:
        held = spark.read.text(paths[0], wholetext=True).where("value not like '{\"c_custkey\"%'").collect()
        assert len(held) > 5 and max(r["value"].count("c_custkey") for r in held) <= 40
