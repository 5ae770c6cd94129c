"""Checks and translations for user-supplied regular expressions."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def is_valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark's regex engine accepts the pattern. Folded on the driver, starts no job."""
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
        return True
    except PySparkException:
        return False


def _group_count(pattern: str) -> int:
    """Number of capturing groups: unescaped ``(`` outside character classes, named groups included."""
    bare = re.sub(r"\\.", "", pattern)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def replacement_for_spark(replacement: str, pattern: str) -> str:
    """Turn ``$&``, ``$$`` and ``$1``-style replacement text into the JVM's replacement syntax."""
    groups = _group_count(pattern)

    def token(m: re.Match) -> str:
        t = m.group(0)
        if t == "$$":
            return r"\$"
        if t == "$&":
            return "$0"
        if t.startswith("$<"):
            return "${" + t[2:-1] + "}"
        if t[0] == "$" and t[1:].isdigit() and 1 <= int(t[1:]) <= groups:
            return t
        if t in ("$`", "$'"):
            raise ValueError(f"replacement {t} (text around the match) is not supported")
        return t.replace("\\", "\\\\").replace("$", r"\$")

    return re.sub(r"\$\$|\$&|\$<[A-Za-z]\w*>|\$\d|\$`|\$'|\$|\\", token, replacement)
