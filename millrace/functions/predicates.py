"""Comparison rules and their AND/OR combination as one boolean column expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import NUMBER_PATTERN, Cell, is_floating, is_integral

# The comparison operators a rule may use.
COMPARISONS = ("eq", "neq", "gt", "lt", "gte", "lte", "contains", "startswith", "endswith", "empty", "notempty")

_NUMBER = re.compile(NUMBER_PATTERN.replace(r"\z", r"\Z"))


@dataclass(frozen=True)
class Rule:
    column: str
    op: str
    value: str = ""

    @classmethod
    def of(cls, spec: Rule | Mapping | tuple) -> Rule:
        if isinstance(spec, Rule):
            return spec
        return cls(**spec) if isinstance(spec, Mapping) else cls(*spec)

    def to_dict(self) -> dict:
        return asdict(self)


def _target_number(value: str) -> float | None:
    """The number a typed-in comparison value stands for; blank counts as zero."""
    if value.strip() == "":
        return 0.0
    return float(value) if _NUMBER.match(value) else None


def _ordering(cell: Cell, op: str, value: str) -> Column:
    target = _target_number(value)
    if target is None:
        return F.lit(False)
    bound = F.lit(int(target) if is_integral(cell.dtype) and target.is_integer() and abs(target) < 2**62 else target)
    # Typed numeric columns compare directly so that the bound reaches the file scan.
    typed = is_integral(cell.dtype) or is_floating(cell.dtype)
    left = cell.raw if typed else cell.num
    test = {"gt": left > bound, "lt": left < bound, "gte": left >= bound, "lte": left <= bound}[op]
    if is_floating(cell.dtype):
        test = test & (cell.raw < F.lit(float("inf"))) & (cell.raw > F.lit(float("-inf")))
    return cell.raw.isNotNull() & test if typed else F.coalesce(test, F.lit(False))


def _equality(cell: Cell, value: str) -> Column:
    if is_integral(cell.dtype):
        canonical = re.fullmatch(r"0|-?[1-9]\d{0,18}", value)
        return cell.raw == F.lit(int(value)) if canonical else F.lit(False)
    return F.lower(cell.text) == value.lower()


def rule_column(df: DataFrame, spec: Rule | Mapping | tuple) -> Column:
    """True where the row satisfies the rule. Never null; false on missing cells except for ``empty``."""
    rule = Rule.of(spec)
    cell, value = Cell(df, rule.column), "" if rule.value is None else str(rule.value)
    if rule.op == "empty":
        return cell.missing
    if rule.op == "notempty":
        return cell.present
    if rule.op in ("gt", "lt", "gte", "lte"):
        test = _ordering(cell, rule.op, value)
        return test if is_integral(cell.dtype) or is_floating(cell.dtype) else cell.present & test
    if rule.op == "eq":
        return cell.present & _equality(cell, value)
    if rule.op == "neq":
        return cell.present & ~_equality(cell, value)
    haystack, needle = F.lower(cell.text), F.lit(value.lower())
    if rule.op == "contains":
        return cell.present & haystack.contains(needle)
    if rule.op == "startswith":
        return cell.present & haystack.startswith(needle)
    if rule.op == "endswith":
        return cell.present & haystack.endswith(needle)
    return cell.present  # an unknown comparison accepts every present cell


def predicate(df: DataFrame, rules: Iterable, combinator: str = "AND") -> Column:
    """All (``AND``) or any (``OR``) of the rules; no rules accept every row."""
    tests = [rule_column(df, r) for r in rules]
    if not tests:
        return F.lit(True)
    both = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b}[combinator.upper()]
    return reduce(both, tests)
