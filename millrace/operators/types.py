"""Logical types: inference, conversion, and the cells a conversion would reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import (
    DIGITS,
    FALSE_WORDS,
    NUMBER_PATTERN,
    TRUE_WORDS,
    WHITESPACE_CLASS,
    Cell,
    bind,
    col,
    data_columns,
    is_floating,
    is_integral,
    is_string,
    starts_like,
    text_to_num,
    text_to_timestamp,
    ws_trim,
)
from millrace.operators.conversion import apply_conversion
from millrace.plans.buckets import as_keys
from millrace.plans.long import IS_TEXT, NUM, VALUE, cells_long

# The logical types, the cell grammars of the vote and the shares that decide it.
LOGICAL_TYPES = ("string", "integer", "decimal", "boolean", "date", "category")
_WS = f"[{WHITESPACE_CLASS}]*"
BOOLEAN_CELL = rf"(?i)\A{_WS}(?:{'|'.join((*TRUE_WORDS, *FALSE_WORDS))}){_WS}\z"
_BOOLEAN_STARTS = "".join(sorted({w[0] for w in (*TRUE_WORDS, *FALSE_WORDS)} | {w[0].upper() for w in (*TRUE_WORDS, *FALSE_WORDS)}))
INTEGER_CELL = rf"\A{_WS}-?\d+{_WS}\z"
DECIMAL_CELL = rf"\A{_WS}-?\d*\.\d+{_WS}\z"
MAJORITY = 0.9
CATEGORY_SHARE = 0.05
CATEGORY_MINIMUM = 10

VOTES = ("boolean", "integer", "decimal", "date", "string")


def logical_type(df: DataFrame, name: str) -> str:
    """The column's label: its metadata if set, else the type Spark holds it in."""
    field = df.schema[name]
    if "logical_type" in field.metadata:
        return field.metadata["logical_type"]
    if is_integral(field.dataType):
        return "integer"
    if is_floating(field.dataType) or isinstance(field.dataType, T.DecimalType):
        return "decimal"
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string"


def is_inferred(df: DataFrame, name: str) -> bool:
    return df.schema[name].metadata.get("inferred", True)


def set_logical_types(df: DataFrame, types: dict[str, str], inferred: bool) -> DataFrame:
    """Label columns, all in one projection."""
    fields = {f.name: f.metadata for f in df.schema.fields}
    labelled = {c: {**fields[c], "logical_type": t, "inferred": inferred} for c, t in types.items()}
    return df.select(*[col(c).alias(c, metadata=labelled[c]) if c in labelled else col(c) for c in df.columns])


def text_vote(value: Column, cells: str = "text") -> Column:
    """Which type a present text cell speaks for.

    ``cells='typed'`` reads text the way a delimited file's cells are typed on load: a number is a number, so ``0`` and
    ``1`` are integers rather than booleans.
    """
    vote = (
        F.when(starts_like(value, _BOOLEAN_STARTS) & value.rlike(BOOLEAN_CELL), F.lit("boolean"))
        .when(~starts_like(value, "-." + DIGITS), F.lit("string"))
        .when(value.rlike(INTEGER_CELL), F.lit("integer"))
        .when(value.rlike(DECIMAL_CELL), F.lit("decimal"))
        .when(text_to_timestamp(value).isNotNull(), F.lit("date"))
        .otherwise(F.lit("string"))
    )
    if cells == "typed":
        number = text_to_num(value)
        whole = F.when(number == F.floor(number), F.lit("integer")).otherwise(F.lit("decimal"))
        vote = F.when(value.rlike(NUMBER_PATTERN), whole).otherwise(vote)
    return vote


def _votes(df: DataFrame, columns: list[str], cells: str) -> DataFrame:
    """One row per cell: ``column``, ``vote`` and the folded text ``value``, both null when the cell is missing."""
    long = cells_long(df, columns)
    held = {f.name: f.dataType for f in df.schema.fields}  # decimals vote cell by cell
    typed = {c: "integer" for c in columns if is_integral(held[c])} | {c: "boolean" for c in columns if isinstance(held[c], T.BooleanType)}
    by_type = F.lit(None).cast("string")
    for kind in ("boolean", "integer"):
        names = [c for c, v in typed.items() if v == kind]
        if names:
            by_type = F.coalesce(by_type, F.when(F.col("column").isin(names), F.lit(kind)))
    number = F.when(F.col(NUM) == F.floor(F.col(NUM)), F.lit("integer")).otherwise(F.lit("decimal"))
    by_number = F.when(~F.col(IS_TEXT) & F.col(NUM).isNotNull(), number)
    vote = F.coalesce(by_type, by_number, text_vote(F.col(VALUE), cells))
    return long.select(
        "column",
        F.when(F.col(VALUE).isNotNull(), vote).alias("vote"),
        F.lower(ws_trim(F.col(VALUE))).alias(VALUE),
    )


def _majority(votes: Row) -> str | None:
    """The type nine cells in ten agree on, if any."""
    need = sum(votes[v] for v in VOTES) * MAJORITY
    if votes["boolean"] >= need:
        return "boolean"
    if votes["integer"] >= need:
        return "integer"
    if votes["integer"] + votes["decimal"] >= need:
        return "decimal"
    return "date" if votes["date"] >= need else None


def infer_types(
    df: DataFrame,
    columns: list[str] | None = None,
    cells: str = "text",
    sample: int | None = None,
    order_by: str | list[str] | None = None,
) -> dict[str, str]:
    """Infer a logical type per column by majority vote over its present cells.

    The votes of all columns and a distinct-count sketch are one aggregation with a row per column and task to shuffle. Only columns whose
    vote is open and whose sketch does not already rule a category out are then counted exactly, so the shuffle carries
    few distinct texts. ``sample`` looks at the first that many present cells per column in ``order_by`` order.
    """
    columns = columns or data_columns(df)
    if sample is not None:
        return {c: _infer_sampled(df, c, cells, sample, order_by) for c in columns}
    if not columns:
        return {}
    tallies = _votes(df, columns, cells).groupBy("column").agg(
        *[F.count_if(F.col("vote") == v).alias(v) for v in VOTES], F.approx_count_distinct(VALUE).alias("sketch")
    )
    tally = {r["column"]: r for r in tallies.collect()}
    out: dict[str, str] = {}
    open_columns: list[tuple[str, int]] = []
    for c in columns:
        votes = tally.get(c)
        total = sum(votes[v] for v in VOTES) if votes else 0
        label = _majority(votes) if total else "string"
        if label is None and votes["sketch"] > 2 * max(CATEGORY_MINIMUM, CATEGORY_SHARE * total):
            label = "string"  # twice the limit is many standard errors of the sketch away
        if label is None:
            open_columns.append((c, total))
        out[c] = label or "string"
    if open_columns:
        pairs = _votes(df, [c for c, _ in open_columns], cells).select("column", VALUE).distinct()
        found = {r["column"]: r["n"] for r in pairs.groupBy("column").agg(F.count(VALUE).alias("n")).collect()}
        for c, total in open_columns:
            few = found[c] <= max(CATEGORY_MINIMUM, CATEGORY_SHARE * total) and found[c] < total
            out[c] = "category" if few else "string"
    return out


def _infer_sampled(df: DataFrame, column: str, cells: str, sample: int, order_by) -> str:
    if not order_by:
        raise ValueError("a sample of the first cells needs order_by")
    cell = Cell(df, column)
    first = df.filter(cell.present).orderBy(*[k.ordered() for k in as_keys(df, order_by)]).limit(sample)
    return infer_types(first.select(col(column)), [column], cells)[column]


def with_inferred_types(df: DataFrame, cells: str = "text") -> DataFrame:
    """Write the inferred labels to the columns' metadata."""
    return set_logical_types(df, infer_types(df, cells=cells), inferred=True)


def converted(cell: Cell, type: str, text: Column | None = None) -> tuple[Column, T.DataType]:
    """The cell read as a logical type (null where that fails) and the Spark type of the result.

    ``text`` is the trimmed text of the cell, for numbers without commas, if the caller has bound it to a column.
    """
    if type in ("integer", "decimal"):
        if isinstance(cell.dtype, T.BooleanType):
            number = F.lit(None).cast("double")
        elif is_string(cell.dtype):
            text = _prepared(cell, type) if text is None else text
            number = text_to_num(text)
        else:
            number = cell.num
        if type == "decimal":
            return number, T.DoubleType()
        if is_integral(cell.dtype):
            return cell.raw.cast("bigint"), T.LongType()
        if is_string(cell.dtype):
            whole = F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("bigint"))  # exact beyond 2**53
            return F.coalesce(whole, number.try_cast("bigint")), T.LongType()
        return number.try_cast("bigint"), T.LongType()
    text = _prepared(cell, type) if text is None else text
    if type == "boolean":
        if isinstance(cell.dtype, T.BooleanType):
            return cell.raw, T.BooleanType()
        word = F.lower(text)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False), T.BooleanType()
    if type == "date":
        return (text_to_timestamp(text).cast("date") if cell.is_text else cell.date), T.DateType()
    if type in ("string", "category"):
        return text, T.StringType()
    raise ValueError(f"type is one of {LOGICAL_TYPES}")


def _prepared(cell: Cell, type: str) -> Column:
    text = ws_trim(cell.text)
    return F.replace(text, F.lit(","), F.lit("")) if type in ("integer", "decimal") else text


def convert_type(df: DataFrame, column: str, type: str, on_invalid: str = "rescue") -> DataFrame:
    """Convert a column; missing cells become null and cells that do not convert follow ``on_invalid``."""
    cell = Cell(df, column)
    bound, (text,) = bind(df, _prepared(cell, type))
    value, dtype = converted(cell, type, F.col(text))
    bound, (result,) = bind(bound, F.when(cell.present, value))
    failed = cell.present & F.col(result).isNull()
    out = apply_conversion(bound, cell, F.col(result), dtype, failed, on_invalid).drop(text, result)
    return set_logical_types(out, {column: type}, inferred=False)


def not_convertible(df: DataFrame, column: str, type: str, **_) -> Column:
    """Present cells that do not convert to the type."""
    cell = Cell(df, column)
    value, _dtype = converted(cell, type)
    return cell.present & value.isNull()


def invalid_values(
    df: DataFrame, column: str, type: str, order_by: str | list[str], n: int = 20
) -> DataFrame:
    """The first ``n`` present cells, in ``order_by`` order, that a conversion to ``type`` would reject."""
    rejected = df.filter(not_convertible(df, column, type)).orderBy(*[k.ordered() for k in as_keys(df, order_by)])
    return rejected.limit(n).select(Cell(df, column).text.alias("value"))
