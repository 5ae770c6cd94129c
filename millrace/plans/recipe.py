"""Recorded steps that replay on any DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import TALLY, Cell, col, fresh
from millrace.operators import append as _append
from millrace.operators import columns, dates, dedup, fill, joins, numbers, ordering, outliers, rows, text, types
from millrace.sources.scratch import settled


@dataclass(frozen=True)
class Operation:
    """How a step runs. ``local`` steps look at one row (or only the schema) and so also run on streams."""

    run: Callable[..., DataFrame]
    local: bool = True
    removes_rows: bool = False
    affected: Callable[..., Column] | None = None  # cells the step fills, maps or fails on, as a boolean over its input
    keeps: Callable[..., Column] | None = None  # the rows that stay, as a boolean over its input
    only_columns: bool = False  # the step looks at the whole table, but only to choose columns


def _missing(df: DataFrame, column: str, **_) -> Column:
    return Cell(df, column).missing


def _remapped(df: DataFrame, column: str, mapping: Mapping[str, str]) -> Column:
    return text.remapped(df, column, mapping)


def _join(df: DataFrame, table: DataFrame, **params) -> DataFrame:
    return joins.join_tables(df, table, **params)


def _append_tables(df: DataFrame, tables: list[DataFrame]) -> DataFrame:
    return _append.append([df, *tables])


OPERATIONS: dict[str, Operation] = {
    "filter_rows": Operation(rows.filter_rows, removes_rows=True, keeps=rows.predicate),
    "remove_rows_matching": Operation(rows.remove_rows_matching, removes_rows=True, keeps=rows.not_matching),
    "remove_empty_rows": Operation(rows.remove_empty_rows, removes_rows=True, keeps=rows.not_empty),
    "remove_rows_with_missing": Operation(rows.remove_rows_with_missing, removes_rows=True, keeps=rows.without_missing),
    "remove_rows_by_key": Operation(rows.remove_rows_by_key, local=False, removes_rows=True),
    "search_rows": Operation(rows.search_rows, removes_rows=True, keeps=rows.containing),
    "drop_duplicates": Operation(dedup.drop_duplicates, local=False, removes_rows=True),
    "remove_columns": Operation(columns.remove_columns),
    "remove_empty_columns": Operation(columns.remove_empty_columns, local=False, only_columns=True),
    "remove_sparse_columns": Operation(columns.remove_sparse_columns, local=False, only_columns=True),
    "remove_constant_columns": Operation(columns.remove_constant_columns, local=False, only_columns=True),
    "remove_duplicate_columns": Operation(columns.remove_duplicate_columns, local=False, only_columns=True),
    "rename_column": Operation(columns.rename_column),
    "normalize_column_names": Operation(columns.normalize_column_names),
    "reorder_columns": Operation(columns.reorder_columns),
    "split_column": Operation(columns.split_column),
    "combine_columns": Operation(columns.combine_columns),
    "fill_missing": Operation(fill.fill_missing, local=False, affected=_missing),
    "clean_text": Operation(text.clean_text),
    "find_replace": Operation(text.find_replace),
    "standardize_categories": Operation(text.standardize_categories, affected=_remapped),
    "clean_numbers": Operation(numbers.clean_numbers, affected=numbers.not_a_number),
    "standardize_dates": Operation(dates.standardize_dates, affected=dates.not_a_date),
    "extract_date_part": Operation(dates.extract_date_part),
    "convert_type": Operation(types.convert_type, affected=types.not_convertible),
    "sort_rows": Operation(ordering.sort_rows, local=False),
    "remove_outliers": Operation(outliers.remove_outliers, local=False, removes_rows=True, keeps=outliers.within_bounds),
    "join_tables": Operation(_join, local=False),
    "append": Operation(_append_tables, local=False),
}
CONSTANT_FILLS = ("zero", "custom")


@dataclass(frozen=True)
class Step:
    op: str
    params: dict = field(default_factory=dict)

    @property
    def operation(self) -> Operation:
        return OPERATIONS[self.op]

    @property
    def local(self) -> bool:
        return self.operation.local or (self.op == "fill_missing" and self.params.get("strategy") in CONSTANT_FILLS)

    @property
    def label(self) -> str:
        shown = ", ".join(f"{k}={v!r}" for k, v in self.params.items())
        return self.op.replace("_", " ") + (f" ({shown})" if shown else "")

    @property
    def changes_nothing(self) -> bool:
        p = self.params
        if self.op == "rename_column":
            return not p.get("new") or p["old"] == p["new"]
        return self.op == "sort_rows" and not p.get("keys")

    def run(self, df: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Apply the step; parameters ``table`` and ``tables`` name entries of the given tables."""
        params = dict(self.params)
        if "table" in params:
            params["table"] = (tables or {})[params["table"]]
        if self.op == "append":
            params["tables"] = [(tables or {})[t] for t in params["tables"]]
        return self.operation.run(df, **params)


@dataclass(frozen=True)
class Recipe:
    """Steps with a cursor: ``undo`` and ``redo`` move it, a new step drops what was undone.

    Nothing is materialised between steps. A snapshot is the replay of a prefix, and Spark fuses adjacent row-wise
    steps into one stage.
    """

    steps: tuple[Step, ...] = ()
    cursor: int = 0

    @property
    def active(self) -> tuple[Step, ...]:
        return self.steps[: self.cursor]

    @property
    def labels(self) -> list[str]:
        return [s.label for s in self.active]

    @property
    def is_row_local(self) -> bool:
        return all(s.local for s in self.active)

    def add(self, op: str, /, **params) -> Recipe:
        step = Step(op, params)
        if op not in OPERATIONS:
            raise ValueError(f"unknown operation {op!r}")
        if step.changes_nothing:
            return self
        return Recipe((*self.active, step), self.cursor + 1)

    def undo(self) -> Recipe:
        return replace(self, cursor=max(0, self.cursor - 1))

    def redo(self) -> Recipe:
        return replace(self, cursor=min(len(self.steps), self.cursor + 1))

    def reset(self) -> Recipe:
        return Recipe()

    def upto(self, n: int) -> Recipe:
        """The first ``n`` active steps."""
        return Recipe(self.active[:n], min(n, self.cursor))

    def apply(self, df: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
        return reduce(lambda d, step: step.run(d, tables), self.active, df)

    def to_json(self) -> str:
        return json.dumps({"cursor": self.cursor, "steps": [{"op": s.op, "params": s.params} for s in self.steps]})

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        data = json.loads(text)
        return cls(tuple(Step(s["op"], s["params"]) for s in data["steps"]), data["cursor"])

    def metrics(self, df: DataFrame, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """One row per active step: rows before and after, and the cells or rows it affected.

        All steps are counted in one pass: a row carries a tally of the tables it was in and of its affected cells, a step that
        removes rows leaves them in as dead ones, and rows that fall together hand their tallies to the one that is kept. The
        tallies are summed at the end, so a task that runs again counts once. Only a join, and duplicates of which any row may
        stay, write their input to the session's shared folder, once each. Steps that need facts of their whole input (ranges of
        an order, bounds of outliers, columns to drop) look at it in jobs of their own, as ``apply`` does.
        """
        if not self.active:
            return df.sparkSession.createDataFrame([], _METRICS)
        facts = reduce(lambda a, b: a.unionByName(b), self._tallies(df, tables))
        by_frame = F.map_from_entries(F.collect_list(F.struct("frame", F.struct("n", "affected"))))
        lines = []
        for i, step in enumerate(self.active):
            before, after = F.element_at("facts", i), F.element_at("facts", i + 1)
            n, m = before.getField("n"), after.getField("n")
            affected = n - m if step.operation.removes_rows else before.getField("affected") if step.operation.affected else F.lit(None)
            fields = {"step": F.lit(i + 1), "op": F.lit(step.op), "rows_before": n, "rows_after": m, "affected": affected.cast("bigint")}
            lines.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
        return facts.agg(by_frame.alias("facts")).select(F.inline(F.array(*lines)))

    def _tallies(self, df: DataFrame, tables) -> list[DataFrame]:
        """Tables ``frame, n, affected``: the rows before each step (and after the last), and the cells the step affects.

        Columns of a row: ``n`` of frame k is the number of rows it stands for in the table before step k, ``hit`` those of them
        with a cell that the step affects. A row is dead if its last ``n`` is 0.
        """
        parts, marked = [], df.withColumn(_n(0), F.lit(1).cast("bigint"))
        for i, step in enumerate(self.active):
            op, params, alive = step.operation, step.params, F.col(_n(i)) > 0
            hit = F.coalesce(alive & op.affected(marked, **params), F.lit(False)) if op.affected else F.lit(False)
            marked = marked.withColumn(_hit(i), hit.cast("bigint"))
            living = _without_tallies(marked.filter(alive))
            if step.op == "join_tables" or (step.op == "drop_duplicates" and params.get("keep") == "any"):
                marked = settled(marked, "metrics")
                parts.append(_summed(marked))
                marked = step.run(_without_tallies(marked.filter(alive)), tables).withColumn(_n(i + 1), F.lit(1).cast("bigint"))
                continue
            stays = alive
            if op.keeps:
                stays = alive & F.coalesce(op.keeps(marked if step.local else living, **params), F.lit(False))
            elif step.op == "remove_rows_by_key":
                (listed,) = fresh(marked, "_listed")
                marked = rows.mark_rows_by_key(marked, listed, **params)
                marked = marked.withColumn(_n(i + 1), (alive & ~F.col(listed)).cast("bigint")).drop(listed)
                continue
            elif step.op == "drop_duplicates":
                marked = _distinct(marked, alive, **params)
            elif step.op == "fill_missing":
                c = params["column"]
                # Dead rows have no cell there, so they take no part in what is filled in.
                dead = F.when(alive, col(c)).alias(c, metadata=marked.schema[c].metadata)
                marked = step.run(marked.select(*[dead if x == c else col(x) for x in marked.columns]), tables)
                if params["strategy"] in ("previous", "next"):
                    marked = marked.withColumn(_hit(i), F.when(Cell(marked, c).missing, 0).otherwise(F.col(_hit(i))).cast("bigint"))
            elif step.op == "append":
                marked = step.run(marked, tables)
                stays = F.coalesce(alive, F.lit(True))
            elif op.only_columns:
                marked = marked.select(*[col(c) for c in step.run(living, tables).columns], *_tallies_of(marked))
            elif step.op == "reorder_columns":
                marked = op.run(marked, [*params["order"], *_tallies_of(marked)])
            elif step.op != "sort_rows":
                marked = step.run(marked, tables)
            marked = marked.withColumn(_n(i + 1), stays.cast("bigint"))
        return [*parts, _summed(marked)]


def _n(frame: int) -> str:
    return f"{TALLY}n{frame}"


def _hit(frame: int) -> str:
    return f"{TALLY}hit{frame}"


def _tallies_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(TALLY)]


def _without_tallies(df: DataFrame) -> DataFrame:
    return df.drop(*_tallies_of(df))


def _summed(marked: DataFrame) -> DataFrame:
    """The sums of the tallies, a row for each table that they know. Rows that came later have none of the earlier ones."""
    names = _tallies_of(marked)
    sums = marked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    frames = [int(c.removeprefix(_n(0)[:-1])) for c in names if c.startswith(_n(0)[:-1])]
    none = F.lit(None).cast("bigint")
    facts = [(F.lit(k), F.col(_n(k)), F.col(_hit(k)) if _hit(k) in names else none) for k in frames]
    return sums.select(F.inline(F.array(*[F.struct(*[v.alias(c) for c, v in zip(("frame", "n", "affected"), f)]) for f in facts])))


def _distinct(marked: DataFrame, alive: Column, keys=None, keep="first", order_by=None) -> DataFrame:
    """``drop_duplicates`` of the living rows, with the sums of their tallies; the dead ones become one row."""
    dedup.drop_duplicates(marked, keys, keep, order_by)  # refuses what it refuses
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = keys or [c for c in columns.data_columns(marked) if c not in order]
    of_dead = [F.when(alive, col(c)).alias(c, metadata=marked.schema[c].metadata) if c in keys else col(c) for c in marked.columns]
    return dedup.first_of_each(marked.select(*of_dead), keys, keep, order, alive, tuple(_tallies_of(marked)))


_METRICS = "step int, op string, rows_before bigint, rows_after bigint, affected bigint"
