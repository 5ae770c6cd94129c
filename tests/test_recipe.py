import pytest

import millrace as mr
from millrace.plans.recipe import OPERATIONS
from tests.conftest import values


@pytest.fixture
def recipe():
    return (
        mr.Recipe()
        .add("remove_rows_with_missing", columns=["city"])
        .add("fill_missing", column="age", strategy="custom", value="0")
        .add("convert_type", column="age", type="integer")
    )


def test_replay_equals_step_by_step(recipe, people):
    by_hand = mr.remove_rows_with_missing(people, ["city"])
    by_hand = mr.convert_type(mr.fill_missing(by_hand, "age", "custom", "0"), "age", "integer")
    assert values(recipe.apply(people)) == values(by_hand)
    assert values(mr.Recipe.from_json(recipe.to_json()).apply(people)) == values(by_hand)
    assert values(recipe.upto(1).apply(people)) == values(mr.remove_rows_with_missing(people, ["city"]))


def test_undo_redo(recipe):
    assert len(recipe.active) == 3
    back = recipe.undo().undo()
    assert [s.op for s in back.active] == ["remove_rows_with_missing"]
    assert back.redo().active == recipe.active[:2]
    other = back.add("remove_empty_rows")
    assert len(other.steps) == 2 and other.redo() == other  # the undone steps are gone
    assert mr.Recipe().undo() == mr.Recipe() and recipe.redo() == recipe and recipe.reset() == mr.Recipe()
    assert len(back.labels) == 1 and "city" in back.labels[0]


def test_steps_that_change_nothing_are_not_recorded(recipe):
    assert recipe.add("rename_column", old="a", new="a") is recipe
    assert recipe.add("sort_rows", keys=[]) is recipe
    with pytest.raises(ValueError):
        recipe.add("no_such_step")


def test_metrics(recipe, people):
    assert recipe.is_row_local
    got = values(recipe.metrics(people).orderBy("step"))
    assert got == [(1, "remove_rows_with_missing", 4, 2, 2), (2, "fill_missing", 2, 2, 1), (3, "convert_type", 2, 2, 0)]
    wide = recipe.add("drop_duplicates", keys=["city"], keep="first", order_by="at")
    assert not wide.is_row_local
    assert values(wide.metrics(people).orderBy("step")) == [*got, (4, "drop_duplicates", 2, 1, 1)]
    assert mr.Recipe().metrics(people).count() == 0


def test_metrics_of_carried_fills(people):
    step = mr.Recipe().add("fill_missing", column="city", strategy="previous", order_by="at")
    assert values(step.metrics(people)) == [(1, "fill_missing", 4, 4, 2)]


def counted_step_by_step(recipe, df, tables):
    """Rows before and after, and affected cells, from the table before and after each step."""
    out = []
    for i, step in enumerate(recipe.active, 1):
        after, op = step.run(df, tables), step.operation
        after = df.sparkSession.createDataFrame(after.collect(), after.schema).coalesce(1)
        n, m = df.count(), after.count()
        affected = n - m if op.removes_rows else df.where(op.affected(df, **step.params)).count() if op.affected else None
        if step.params.get("strategy") in ("previous", "next"):
            affected -= after.where(op.affected(after, **step.params)).count()
        out.append((i, step.op, n, m, affected))
        df = after
    return out


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(i, f" c{i % 7}", None if i % 5 == 0 else float(i % 11) + (900 if i == 33 else 0), "x" if i % 3 else None, "k") for i in range(120)]
    return spark.createDataFrame(rows, "at int, `City Name` string, v double, w string, same string").coalesce(2)


@pytest.fixture(scope="module")
def others(spark):
    return {
        "more": spark.createDataFrame([(500, " c1", None, None), (501, None, 3.0, "y")], "at int, city_name string, v double, w string").coalesce(1),
        "cities": spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "C")], "city string, area string").coalesce(1),
    }


def test_metrics_of_removed_rows(gappy, others):
    """Removed rows count nowhere later, nor do they fill, match or bound."""
    recipe = (
        mr.Recipe()
        .add("normalize_column_names")
        .add("filter_rows", rules=[("at", "neq", 7)])
        .add("remove_rows_by_key", keys=[[1], [2], [7], [119]], key="at")
        .add("fill_missing", column="w", strategy="next", order_by="at")
        .add("remove_outliers", column="v", method="zscore", nulls_as_zero=True)
        .add("search_rows", text="c")
        .add("sort_rows", keys=["v"])
        .add("fill_missing", column="v", strategy="mean")
        .add("remove_rows_matching", rules=[("at", "gt", 100)])
    )
    want = counted_step_by_step(recipe, gappy, others)
    assert all(w[4] for w in want if w[1] not in ("normalize_column_names", "sort_rows", "search_rows"))
    assert values(recipe.metrics(gappy, others).orderBy("step")) == want


def test_metrics_of_rows_that_fall_together(gappy, others):
    """Duplicates, appended tables, dropped columns and joins in one recipe; also on tables without rows."""
    recipe = (
        mr.Recipe()
        .add("normalize_column_names")
        .add("standardize_categories", column="w", mapping={"x": "X"})
        .add("remove_rows_matching", rules=[("at", "gt", 100)])
        .add("drop_duplicates", keys=["city_name", "v"], keep="last", order_by="at")
        .add("append", tables=["more"])
        .add("fill_missing", column="v", strategy="zero")
        .add("remove_constant_columns")
        .add("drop_duplicates", keys=["city_name"], keep="first", order_by="at")
        .add("remove_rows_with_missing", columns=["w"])
        .add("reorder_columns", order=["city_name", "v", "at"])
    )
    want = counted_step_by_step(recipe, gappy, others)
    assert all(w[4] for w in want if w[1] in ("standardize_categories", "drop_duplicates", "fill_missing", "remove_rows_with_missing"))
    assert values(recipe.metrics(gappy, others).orderBy("step")) == want
    joined = mr.Recipe(recipe.steps[:5], 5).add("join_tables", table="cities", keys=[["city_name", "city"]], how="left")
    joined = joined.add("drop_duplicates", keys=["area"], keep="any").add("remove_empty_rows")
    assert values(joined.metrics(gappy, others).orderBy("step")) == counted_step_by_step(joined, gappy, others)
    none = recipe.metrics(gappy.where("false"), others | {"more": others["more"].where("false")})
    assert [r[:4] for r in values(none.orderBy("step"))] == [(i, s.op, 0, 0) for i, s in enumerate(recipe.active, 1)]


def test_metrics_write_nothing_but_before_joins(people, spark, monkeypatch):
    from millrace.plans import recipe as module

    written = []
    monkeypatch.setattr(module, "settled", lambda df, name: written.append(name) or df)
    steps = mr.Recipe().add("drop_duplicates", keys=["city"], keep="first", order_by="at").add("fill_missing", column="age", strategy="previous", order_by="at")
    assert steps.metrics(people).count() == 2 and written == []
    steps.add("join_tables", table="cities", keys=["city"], how="left").metrics(people, {"cities": people.select("city").distinct()}).count()
    assert written == ["metrics"]


def test_steps_with_other_tables(people, spark):
    cities = spark.createDataFrame([("lyon", "FR")], "city string, country string")
    recipe = mr.Recipe().add("join_tables", table="cities", keys=["city"], how="left").add("append", tables=["more"])
    out = recipe.apply(people, {"cities": cities, "more": spark.createDataFrame([("DE",)], "country string")})
    assert out.count() == 5 and sorted(r["country"] or "" for r in out.collect()) == ["", "", "DE", "FR", "FR"]


def test_every_operation_is_exported():
    for name in OPERATIONS:
        assert hasattr(mr, name) or name == "remove_sparse_columns"


def test_stream(recipe, people, spark, tmp_path):
    people.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    mr.replay_stream(recipe, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(values(spark.read.parquet(str(tmp_path / "out"))), key=str) == sorted(values(recipe.apply(people)), key=str)
    with pytest.raises(ValueError):
        mr.replay_stream(mr.Recipe().add("sort_rows", keys=["id"]), stream, str(tmp_path / "o2"), str(tmp_path / "c2"))
