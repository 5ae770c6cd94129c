"""Validation rules: counts per rule, totals and the offending rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import VIOLATIONS, Cell, col, fresh
from millrace.functions.patterns import is_valid_pattern
from millrace.plans.buckets import as_keys, position

# The rule types and the shape of an e-mail address.
RULE_TYPES = ("range", "non_negative", "unique", "email", "not_future_date", "not_null", "regex")
EMAIL = r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"


@dataclass(frozen=True)
class ValidationRule:
    """One check on one column. ``as_of`` (default: now, when the rule is made) is what ``not_future_date`` compares to.

    ``unique`` is broken by every row whose value occurs more than once. With ``first_by``, a column that tells such rows
    apart, the first of them along it passes and only the later ones break the rule.
    """

    column: str
    type: str
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    as_of: dt.datetime | str | None = None
    label: str = ""
    first_by: str | None = None

    def __post_init__(self):
        if self.type not in RULE_TYPES:
            raise ValueError(f"rule type is one of {RULE_TYPES}")
        if not self.label:
            object.__setattr__(self, "label", f"{self.column} {self.type}")
        if self.first_by is not None and self.type != "unique":
            raise ValueError("first_by belongs to unique rules")
        if self.type == "not_future_date" and self.as_of is None:
            object.__setattr__(self, "as_of", dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))

    @classmethod
    def of(cls, spec: ValidationRule | Mapping) -> ValidationRule:
        return spec if isinstance(spec, ValidationRule) else cls(**spec)


@dataclass(frozen=True)
class ValidationReport:
    """``rules``: counts per rule. ``totals``: one row for the table. ``flagged``: the table plus ``_violations``."""

    rules: DataFrame
    totals: DataFrame
    flagged: DataFrame

    @property
    def invalid_rows(self) -> DataFrame:
        return self.flagged.filter(F.size(VIOLATIONS) > 0)

    @property
    def valid_rows(self) -> DataFrame:
        return self.flagged.filter(F.size(VIOLATIONS) == 0).drop(VIOLATIONS)


def _violated(df: DataFrame, rule: ValidationRule) -> Column:
    """Whether the row breaks the rule; missing cells break ``not_null`` only."""
    cell = Cell(df, rule.column)
    if rule.type == "not_null":
        return cell.missing
    if rule.type == "range":
        bad = cell.num.isNull()
        if rule.min is not None:
            bad = bad | F.coalesce(cell.num < float(rule.min), F.lit(False))
        if rule.max is not None:
            bad = bad | F.coalesce(cell.num > float(rule.max), F.lit(False))
    elif rule.type == "non_negative":
        bad = F.coalesce(cell.num < 0, F.lit(True))
    elif rule.type == "email":
        bad = ~cell.text.rlike(EMAIL)
    elif rule.type == "not_future_date":
        bad = F.coalesce(cell.timestamp > F.lit(str(rule.as_of)).cast("timestamp_ntz"), F.lit(False))
    else:
        usable = bool(rule.pattern) and is_valid_pattern(df.sparkSession, rule.pattern)
        bad = ~cell.text.rlike(rule.pattern) if usable else F.lit(False)
    return cell.present & bad


def _with_repeats(df: DataFrame, rule: ValidationRule, flag: str) -> DataFrame:
    """Mark every row whose present value occurs more than once, or with ``first_by`` all but the first of these.

    Values are counted with partial aggregation and only the repeated ones come back, once each, through a left join:
    a value shared by a large part of the table is split on the table's side by adaptive execution.
    """
    cell = Cell(df, rule.column)
    lookup, value, n, first = fresh(df.withColumn(flag, F.lit(None)), "_lookup", "_value", "_n", "_first")
    place = position(df, as_keys(df, rule.first_by)) if rule.first_by else F.lit(0)
    repeated = df.filter(cell.present).groupBy(cell.text.alias(value)).agg(F.count(F.lit(1)).alias(n), F.min(place).alias(first))
    repeated = repeated.filter(F.col(n) > 1).select(value, first)
    keyed = df.withColumn(lookup, F.when(cell.present, cell.text))
    joined = keyed.join(repeated, keyed[lookup] == repeated[value], "left")
    broken = F.col(value).isNotNull() & (place > F.col(first)) if rule.first_by else F.col(value).isNotNull()
    return joined.withColumn(flag, broken).drop(lookup, value, first)


def _flag(df: DataFrame, rules: list[ValidationRule]) -> tuple[DataFrame, list[str]]:
    flags = fresh(df, *[f"_rule{i}" for i in range(len(rules))])
    row_rules = [(r, f) for r, f in zip(rules, flags) if r.type != "unique"]
    checked = df.withColumns({f: _violated(df, r) for r, f in row_rules}) if row_rules else df
    for r, f in zip(rules, flags):
        if r.type == "unique":
            checked = _with_repeats(checked, r, f)
    return checked, flags


def _labelled(rules: list[ValidationRule]) -> list[ValidationRule]:
    """Rules with one label each: a label that was used before gets a number behind it."""
    taken, out = {r.label for r in rules}, []
    for r in rules:
        n, label = 1, r.label
        while any(o.label == label for o in out) or n > 1 and label in taken:
            n += 1
            label = f"{r.label} {n}"
        out.append(replace(r, label=label) if n > 1 else r)
    return out


def validate(df: DataFrame, rules: list) -> ValidationReport:
    """Check every rule on every row. Rules with equal labels are told apart by a number."""
    rules = _labelled([ValidationRule.of(r) for r in rules])
    checked, flags = _flag(df, rules)
    any_bad = reduce(lambda a, b: a | b, [F.col(f) for f in flags], F.lit(False))
    counts = checked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(any_bad).alias("bad"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    per_rule = [
        F.struct(
            F.lit(r.label).alias("rule"),
            F.lit(r.column).alias("column"),
            F.lit(r.type).alias("type"),
            (F.col("n") - F.col(f)).alias("valid_count"),
            F.col(f).alias("invalid_count"),
        )
        for r, f in zip(rules, flags)
    ]
    totals = counts.select(
        F.col("n").alias("total_rows"),
        F.col("bad").alias("rows_with_issues"),
        (F.col("n") - F.col("bad")).alias("valid_rows"),
    )
    labels = F.array(*[F.when(F.col(f), F.lit(r.label)) for r, f in zip(rules, flags)]).cast("array<string>")
    flagged = checked.select(*[col(c) for c in df.columns], F.array_compact(labels).alias(VIOLATIONS))
    report = counts.select(F.inline(F.array(*per_rule))) if rules else counts.limit(0).select(F.lit("").alias("rule"))
    return ValidationReport(report, totals, flagged)
