"""URL rules found by hash: host suffixes and path prefixes, short digests first, full digests to confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables up to this many rows are broadcast; larger ones are joined by shuffling the distinct expressions.
BROADCAST_RULES = 10_000
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + F.lit(1)), "."))


def judge_urls(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Give every URL the verdict of the longest rule that fits it, else ``default``.

    ``rules`` has ``host``, ``path`` (strings) and ``verdict``; a rule fits its host and all subdomains if the path of the URL
    starts with the rule's. Of rules equally long (host and path together) the one whose text sorts first wins, of equal rules
    with different verdicts ``block``. Rules with a null part are ignored.

    Returns one row per row of ``pages``: the id, ``host``, ``path``, ``rule`` (host and path; null if none fits) and
    ``verdict``. URLs that are null or hold no ``://`` have an empty host and path. Ids may be null or repeat, other columns are
    not read, and an empty table gives an empty one.

    Each distinct (host, path) is expanded once, so a hot host costs no more than its different paths. Expressions meet rules
    on the first 32 bits of their digest; the full digest confirms.
    """
    rows = pages.select(F.col(id).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    listed = (
        rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
    )
    # A URL's path is tried up to the lengths that rules have: a set no larger than the longest URL.
    lengths = [r[0] for r in listed.select(F.length("rule_path")).distinct().collect()]
    if not lengths:
        return rows.select(F.col("id").alias(id), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)])
    tries = F.filter(sizes, lambda n: n <= F.length("path"))
    few = listed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    expressions = (
        rows.select("host", "path")
        .where("host != ''")
        .distinct()
        .withColumn("suffix", F.explode(_host_suffixes(F.col("host"))))
        .withColumn("size", F.explode(tries))
        .withColumn("full", _digest(F.col("suffix"), F.expr("substring(path, 1, size)")))
        .select("host", "path", F.substring("full", 1, PREFIX_HEX).alias("short"), F.col("full").alias("url_full"))
    )
    hits = expressions.join(F.broadcast(listed) if few else listed, "short").where("url_full = full")
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), F.col("verdict"))).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
