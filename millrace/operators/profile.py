"""Column profiles, table profile, quality score and column suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import Cell, col, data_columns, fingerprint, text_to_num, to_str
from millrace.operators.columns import column_facts
from millrace.operators.dedup import count_duplicates
from millrace.operators.types import converted, is_inferred, logical_type
from millrace.plans.buckets import as_keys
from millrace.plans.long import cells_long

# Weights of the quality figures, the preview cap inside the score, and the suggestion texts.
MISSING_PENALTY = 0.8
CONSTANT_PENALTY = 0.15
SCORE_WEIGHTS = {"missing": 0.4, "duplicate": 0.25, "invalid": 0.2, "type_issue": 0.15}
INVALID_CAP = 20
SPARSE_SHARE = 0.9
EMPTY_REASON = "entirely empty"
CONSTANT_REASON = "constant value"
SPARSE_REASON = "% missing"
INDEX_REASON = "looks like an index artifact"
EXAMPLES = 3
EXAMPLE_ROWS = 300  # looked at first for examples


def _long(df: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row per cell; ``num`` also holds the numbers of text columns that are labelled as numeric."""
    names = data_columns(df)
    labelled = [c for c in names if logical_type(df, c) in ("integer", "decimal") and Cell(df, c).is_text]
    long = cells_long(df, names, extra)
    if not labelled:
        return long
    return long.withColumn("num", F.when(F.col("column").isin(labelled), text_to_num(F.col("value"))).otherwise(F.col("num")))


def _column_stats(df: DataFrame, approx: bool) -> DataFrame:
    """``column, total, missing, distinct, min_num, max_num, min_text, max_text`` for every column with rows.

    Exact: cells are grouped by column and the text's fingerprint, which is both the distinct count and a strong
    pre-aggregation; the second grouping has one group per column and combines before its shuffle. Approximate: one pass
    with sketches.
    """
    value, num = F.col("value"), F.col("num")
    # Extremes of text make Spark sort instead of hash, so they are left out unless a column needs them.
    dates = [c for c in data_columns(df) if logical_type(df, c) == "date"]
    date_text = F.when(F.col("column").isin(dates), value) if dates else None

    def text_extremes() -> list[Column]:
        if date_text is None:
            return []
        return [F.min(date_text).alias("min_text"), F.max(date_text).alias("max_text")]

    if approx:
        stats = _long(df).groupBy("column").agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(value.isNull()).alias("missing"),
            F.approx_count_distinct(value).alias("distinct"),
            F.min(num).alias("min_num"),
            F.max(num).alias("max_num"),
            *text_extremes(),
        )
    else:
        one, two = fingerprint([value])
        texts = _long(df).groupBy("column", value.isNull().alias("none"), one.alias("one"), two.alias("two")).agg(
            F.count(F.lit(1)).alias("n"), F.min(num).alias("lo"), F.max(num).alias("hi"), *text_extremes()
        )
        stats = texts.groupBy("column").agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("none"), F.col("n"))), F.lit(0)).alias("missing"),
            F.count_if(~F.col("none")).alias("distinct"),
            F.min("lo").alias("min_num"),
            F.max("hi").alias("max_num"),
            *([F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text")] if dates else []),
        )
    if dates:
        return stats
    return stats.withColumns({c: F.lit(None).cast("string") for c in ("min_text", "max_text")})


def _ranked_examples(df: DataFrame, keys: list) -> DataFrame:
    cells = _long(df, [k.expr.alias(f"_o{i}") for i, k in enumerate(keys)]).filter(F.col("value").isNotNull())
    first = Window.partitionBy("column").orderBy(*[F.col(f"_o{i}") for i in range(len(keys))])
    ranked = cells.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= EXAMPLES)
    kept = F.array_sort(F.collect_list(F.struct("_rank", "value")))
    return ranked.groupBy("column").agg(F.transform(kept, lambda e: e["value"]).alias("examples"))


def _examples(df: DataFrame, order_by) -> DataFrame:
    """The first present values of every column.

    The first ``EXAMPLE_ROWS`` rows, a top-k, hold them for nearly every column. Only columns that are still short are
    then searched as a whole; each task sends on at most ``EXAMPLES`` rows per column.
    """
    keys = as_keys(df, order_by)
    head = df.orderBy(*[k.ordered() for k in keys]).limit(EXAMPLE_ROWS)
    found = {r["column"]: r["examples"] for r in _ranked_examples(head, keys).collect()}
    full = [c for c in data_columns(df) if len(found.get(c, [])) == EXAMPLES]
    easy = df.sparkSession.createDataFrame([(c, found[c]) for c in full], "column string, examples array<string>")
    if len(full) == len(data_columns(df)):
        return easy
    named = [i for i in ([order_by] if isinstance(order_by, str) else order_by) if isinstance(i, str)]
    short = [c for c in df.columns if c not in full]
    rest = _ranked_examples(df.select(*[col(c) for c in dict.fromkeys([*short, *named])]), keys)
    return easy.unionByName(rest.filter(F.col("column").isin(short)))


def profile_columns(df: DataFrame, order_by: str | list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: missing and distinct counts, range, quality and (with ``order_by``) example values.

    ``min`` and ``max`` are numeric for integer and decimal columns, textual for date columns and null otherwise.
    """
    names = [(i, c, logical_type(df, c)) for i, c in enumerate(data_columns(df))]
    listed = df.sparkSession.createDataFrame(names, "position int, column string, type string")
    joined = listed.join(_column_stats(df, approx), "column", "left")
    numeric = F.col("type").isin("integer", "decimal")
    total, missing = F.coalesce("total", F.lit(0)), F.coalesce("missing", F.lit(0))
    share = F.when(total > 0, missing / total).otherwise(F.lit(0.0))
    distinct = F.coalesce("distinct", F.lit(0))
    penalty = F.when(distinct == 1, F.lit(CONSTANT_PENALTY)).otherwise(F.lit(0.0))

    def extreme(which: str) -> Column:
        number, text = F.col(f"{which}_num"), F.col(f"{which}_text")
        return F.when(numeric, to_str(number, T.DoubleType())).when(F.col("type") == "date", text).alias(which)

    out = joined.select(
        "position",
        "column",
        "type",
        missing.alias("missing_count"),
        share.alias("missing_pct"),
        distinct.alias("unique_count"),
        extreme("min"),
        extreme("max"),
        F.greatest(F.lit(0.0), 1 - share * MISSING_PENALTY - penalty).alias("quality"),
    )
    if order_by is None:
        return out
    none = F.array().cast("array<string>")
    examples = _examples(df, order_by)
    return out.join(examples, "column", "left").withColumn("examples", F.coalesce(F.col("examples"), none))


def suggest_unnecessary_columns(df: DataFrame) -> DataFrame:
    """Columns one may want to drop, each with the first reason that applies."""
    share = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(F.lit(0.0))
    percent = F.floor(share * 100 + 0.5).cast("string")
    reason = (
        F.when(share == 1, F.lit(EMPTY_REASON))
        .when(F.col("constant"), F.lit(CONSTANT_REASON))
        .when(share >= SPARSE_SHARE, F.concat(percent, F.lit(SPARSE_REASON)))
        .when(F.lower("column").startswith("unnamed"), F.lit(INDEX_REASON))
    )
    return column_facts(df).select("column", reason.alias("reason")).filter("reason IS NOT NULL")


def _table_totals(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Row, duplicate and missing-cell counts, and per column the cells its type rejects.

    Cells are counted in one aggregation that shuffles a row per task, duplicates by fingerprints of rows.
    """
    columns = data_columns(df)
    missing = sum((Cell(df, c).missing.cast("int") for c in columns), F.lit(0))
    sums = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing")]
    for i, c in enumerate(columns if types else []):
        cell = Cell(df, c)
        value, _ = converted(cell, types[c])
        sums.append(F.count_if(cell.present & value.isNull()).alias(f"invalid{i}"))
    return df.agg(*sums).crossJoin(count_duplicates(df))  # one row each


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: row and column counts, share of missing cells, number of duplicate rows."""
    width = len(data_columns(df))
    cells = F.col("rows") * width
    return _table_totals(df).select(
        F.col("rows").alias("row_count"),
        F.lit(width).cast("bigint").alias("column_count"),
        F.when(cells > 0, F.col("missing") / cells).otherwise(F.lit(0.0)).alias("missing_cell_pct"),
        F.col("duplicates").alias("duplicate_row_count"),
    )


def quality_score(df: DataFrame, types: dict[str, tuple[str, bool]] | None = None, cap: int | None = None) -> DataFrame:
    """One row with a 0-100 score and the four shares behind it.

    ``types`` overrides a column's (type, inferred) pair. Cells a column's type rejects count as type issues when the
    type was inferred and as invalid when it was set; all of them, or at most ``cap`` per column (``INVALID_CAP``: as a preview shows).
    """
    columns = data_columns(df)
    labels = {c: (logical_type(df, c), is_inferred(df, c)) for c in columns} | (types or {})
    totals = _table_totals(df, {c: labels[c][0] for c in columns})
    cells = F.greatest(F.lit(1), F.col("rows") * len(columns))

    def issues(inferred: bool) -> Column:
        counts = [F.col(f"invalid{i}") for i, c in enumerate(columns) if labels[c][1] is inferred]
        counts = counts if cap is None else [F.least(F.lit(cap), c) for c in counts]
        return F.least(F.lit(1.0), sum(counts, F.lit(0)) / cells)

    shares = totals.select(
        F.when(F.col("rows") > 0, F.col("missing") / cells).otherwise(F.lit(0.0)).alias("missing_pct"),
        F.when(F.col("rows") > 0, F.col("duplicates") / F.col("rows")).otherwise(F.lit(0.0)).alias("duplicate_pct"),
        issues(False).alias("invalid_pct"),
        issues(True).alias("type_issue_pct"),
    )
    kept = F.lit(1.0)
    for name, weight in SCORE_WEIGHTS.items():
        kept = kept - F.col(f"{name}_pct") * weight
    return shares.select(F.floor(F.greatest(F.lit(0.0), kept) * 100 + 0.5).cast("bigint").alias("score"), "*")
