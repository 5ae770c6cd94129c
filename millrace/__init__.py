"""Tabular data preparation as Spark jobs: clean, profile, reshape, join, validate, replay."""

from millrace.functions.cells import Cell, is_missing, to_date, to_num, to_str, ws_trim
from millrace.functions.predicates import Rule, predicate
from millrace.operators.append import append, append_preview
from millrace.operators.columns import (
    combine_columns,
    normalize_column_names,
    remove_columns,
    remove_constant_columns,
    remove_duplicate_columns,
    remove_empty_columns,
    remove_sparse_columns,
    rename_column,
    reorder_columns,
    split_column,
)
from millrace.operators.dates import extract_date_part, standardize_dates
from millrace.operators.dedup import count_duplicates, drop_duplicates
from millrace.operators.fill import count_missing, fill_missing
from millrace.operators.joins import join_preview, join_tables, join_warnings
from millrace.operators.numbers import clean_numbers
from millrace.operators.ordering import number_rows, page, sort_rows
from millrace.operators.outliers import detect_outliers, remove_outliers
from millrace.operators.profile import profile_columns, profile_dataset, quality_score, suggest_unnecessary_columns
from millrace.operators.rows import (
    filter_rows,
    remove_empty_rows,
    remove_rows_by_key,
    remove_rows_matching,
    remove_rows_with_missing,
    search_rows,
)
from millrace.operators.text import clean_text, distinct_values, find_replace, standardize_categories
from millrace.operators.types import convert_type, infer_types, invalid_values, logical_type, with_inferred_types
from millrace.operators.validate import ValidationReport, ValidationRule, validate
from millrace.plans.recipe import Recipe, Step
from millrace.sources.delimited import load_delimited, save_delimited
from millrace.sources.loader import load
from millrace.sources.markdown import cleaning_report, markdown_rows, report_counts, save_markdown
from millrace.sources.records import load_json, save_json
from millrace.sources.workbooks import load_workbooks
from millrace.streaming.replay import replay_stream
