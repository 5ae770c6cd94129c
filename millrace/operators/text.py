"""Text and category clean-up. Missing cells are left untouched; results are text columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import WHITESPACE_CLASS, Cell, col, fresh, replace_column, ws_trim
from millrace.functions.patterns import is_valid_pattern, replacement_for_spark

# Fixed value: the ASCII punctuation marks that are removed (every one except the backslash).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"

_MAP_LITERAL_LIMIT = 64  # looking a key up in a map is a linear scan, so longer mappings are joined
_WIDE_SPACES = WHITESPACE_CLASS.removeprefix(r"\s")
# Texts whose words cannot be told by their spaces alone: wide characters, the mark, and letters beyond ASCII before a word.
_APART = r"[^\x00-\xff]|[\x01\xa0]|(?<!\S)[\x00-\x7F&&[^\w\s]]*+[^\x00-\x7F]"


def _by_spaces(text: Column, build: Callable[[str], Column]) -> Column:
    """The expression for the full white-space class where a text needs it, for the ASCII class elsewhere.

    Patterns with the full class run several times slower, and one quick scan tells which texts hold wide spaces.
    """
    has_wide = text.rlike(rf"(?![\x00-\x9f])[{_WIDE_SPACES}]")
    return F.when(has_wide, build(WHITESPACE_CLASS)).otherwise(build(r"\s"))


def _squeeze(text: Column) -> Column:
    """Each white-space run that is not already a single space becomes one."""
    return _by_spaces(text, lambda ws: F.regexp_replace(text, f"[{ws}&&[^ ]][{ws}]*| [{ws}]+", " "))


def _title(text: Column, unicode: bool) -> Column:
    """Upper-case the first word character of every run of non-spaces and lower-case what follows it.

    A regex replacement cannot change case, so the text is taken apart into words and what lies between them.
    """
    flag = "(?U)" if unicode else ""

    def capitalise(piece: Column) -> Column:
        code = F.ascii(piece)
        word = code.between(97, 122) | code.between(65, 90) | code.between(48, 57) | (code == 95)
        if unicode:
            word = piece.rlike(r"(?U)\A\w")
        raised = F.concat(F.upper(F.substring(piece, 1, 1)), F.lower(F.substring(piece, F.lit(2), F.length(piece))))
        return F.when(word, raised).otherwise(piece)

    def rebuilt(ws: str) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"{flag}\w[^{ws}]*|\W+"), F.lit(0))
        return F.array_join(F.transform(pieces, capitalise), "")

    if unicode:
        return _by_spaces(text, rebuilt)
    # Elsewhere a mark with a space behind it, where a word starts without one before it, makes every word one of initcap's.
    marked = F.regexp_replace(text, r"(?<!\S)[^\w\s]++(?=\w)|[\s&&[^ ]](?=\w)", "$0\x01 ")
    return F.when(text.rlike(_APART), _by_spaces(text, rebuilt)).otherwise(F.replace(F.initcap(marked), F.lit("\x01 "), F.lit("")))


def _operation(op: str, unicode: bool):
    flag = "(?U)" if unicode else ""
    return {
        "trim": lambda t: _squeeze(ws_trim(t)),
        "lowercase": F.lower,
        "uppercase": F.upper,
        "titlecase": lambda t: _title(t, unicode),
        "remove_punctuation": lambda t: F.regexp_replace(t, "[" + re.escape(PUNCTUATION) + "]", ""),
        "remove_special": lambda t: _by_spaces(t, lambda ws: F.regexp_replace(t, rf"{flag}[^\w{ws}]", "")),
    }[op]


def clean_text(df: DataFrame, column: str, op: str, unicode: bool = False) -> DataFrame:
    """Apply ``trim``, ``lowercase``, ``uppercase``, ``titlecase``, ``remove_punctuation`` or ``remove_special``.

    Word characters are ASCII unless ``unicode`` is set.
    """
    cell = Cell(df, column)
    changed = _operation(op, unicode)(cell.text)
    return replace_column(df, column, F.when(cell.present, changed).otherwise(cell.text))


def find_replace(df: DataFrame, column: str, find: str, replace: str, regex: bool = False) -> DataFrame:
    """Replace every occurrence of a literal text or of a regular expression (an invalid one changes nothing)."""
    if find == "":
        raise ValueError("the text to find must not be empty")
    cell = Cell(df, column)
    if not regex:
        changed = F.replace(cell.text, F.lit(find), F.lit(replace))
    elif is_valid_pattern(df.sparkSession, find):
        changed = F.regexp_replace(cell.text, find, replacement_for_spark(replace, find))
    else:
        changed = cell.text
    return replace_column(df, column, F.when(cell.present, changed).otherwise(cell.text))


def _lookup(mapping: Mapping[str, str]) -> dict[str, str]:
    return {k.strip().lower(): v for k, v in mapping.items() if v.strip()}


def remapped(df: DataFrame, column: str, mapping: Mapping[str, str]) -> Column:
    """Present cells whose value ``standardize_categories`` changes."""
    cell, lookup = Cell(df, column), _lookup(mapping)
    if not lookup:
        return F.lit(False)
    pairs = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    target = F.try_element_at(pairs, F.lower(ws_trim(cell.text)))
    return cell.present & F.coalesce(target != cell.text, F.lit(False))


def standardize_categories(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Map values by their trimmed lower-case form. Blank targets are ignored, the last of equal keys wins."""
    lookup = _lookup(mapping)
    if not lookup:
        return df
    cell = Cell(df, column)
    key = F.lower(ws_trim(cell.text))
    if len(lookup) <= _MAP_LITERAL_LIMIT:
        pairs = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
        mapped = F.try_element_at(pairs, key)
        return replace_column(df, column, F.when(cell.present, F.coalesce(mapped, cell.text)).otherwise(cell.text))
    source, target = fresh(df, "_from", "_to")
    table = df.sparkSession.createDataFrame(list(lookup.items()), "_from string, _to string").toDF(source, target)
    joined = df.withColumn(source, F.when(cell.present, key)).join(table, source, "left")
    out = [
        F.coalesce(F.col(target), cell.text).alias(c, metadata=df.schema[c].metadata) if c == column else col(c)
        for c in df.columns
    ]
    return joined.select(*out)


def distinct_values(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The ``n`` first distinct non-blank values in text order with their counts, to base a mapping on."""
    cell = Cell(df, column)
    counts = df.select(cell.text.alias("value")).filter(ws_trim(F.col("value")) != "")
    return counts.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(n)
