"""The queries of this subpackage and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shipping import ship_code
from millrace.llm.bpe import encode
from millrace.llm.divergence import divergence
from millrace.llm.graph_search import nearest_vectors
from millrace.llm.licenses import scan_licenses
from millrace.llm.manifest import digest, field, folded, manifest
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.packing import pack
from millrace.llm.quality_rules import quality_verdicts
from millrace.llm.repeats import remove_repeats
from millrace.llm.surrogates import replace_personal_data
from millrace.llm.toxicity import toxicity_scores
from millrace.llm.url_filter import judge_urls
from millrace.llm.word_bpe import encode_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MANY_LANGUAGES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PII_KEY = "key of the checked query"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str, tables: str, sql: str | None = None):
    """Register a query that turns whole tables into its result."""

    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return build(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables.split()])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_license_scan", "documents")
def license_scan(documents: DataFrame) -> DataFrame:
    """Per document the licences found, the best coefficient and whether one is the whole text."""
    found = scan_licenses(documents).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("license")).alias("licenses"), F.max("dice").alias("best_dice"), F.max("whole_text").alias("whole_text")
    )
    found = found.withColumnRenamed("doc_id", "found_id")
    joined = documents.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    listed = F.coalesce(F.array_join("licenses", "; "), F.lit("")).alias("licenses")
    return joined.select("doc_id", listed, F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"))


@query("op2_pii_surrogates", "documents")
def pii_surrogates(documents: DataFrame) -> DataFrame:
    return replace_personal_data(documents, PII_KEY).select("doc_id", "text")


@query("op3_best_fit_packing", "documents")
def best_fit_packing(documents: DataFrame) -> DataFrame:
    packed = pack(documents, BYTE_BPE)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query(
    "op4_quality_rules",
    "documents",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
m AS (
  SELECT doc_id, text, words, lines, len(words) AS n, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS symbols, len(lines) - len(list_distinct(lines)) AS dups,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS bangs,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS uppers
  FROM w),
grams AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS g FROM (SELECT doc_id, words, unnest(range(1, n - 3)) AS i FROM m WHERE n >= 5)),
twice AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM grams GROUP BY doc_id, g HAVING count(*) > 1)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS repeated FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
f AS (
  SELECT m.*, coalesce(repeated, 0) AS repeated, n < 10 OR 100 * coalesce(repeated, 0) > 20 * n AS failed
  FROM m LEFT JOIN covered USING (doc_id))
SELECT doc_id, n AS n_words, CAST(chars AS BIGINT) AS word_chars, symbols AS n_symbols, dups AS n_dup_lines,
  repeated AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (chars < 2 * n) AND NOT (chars > 15 * n AND 2 * letters > chars) AND NOT (10 * symbols > 3 * n)
    AND NOT (len(lines) > 3 AND 10 * dups > 3 * len(lines)) AND NOT (letters > 40 AND 10 * uppers > 6 * letters)
    AND NOT (n > 10 AND 2 * bangs > n) AS kept
FROM f
""",
)
def quality_rules(documents: DataFrame) -> DataFrame:
    return quality_verdicts(documents)


@query("op5_bpe_round_trip", "documents")
def bpe_round_trip(documents: DataFrame) -> DataFrame:
    tokens = encode(documents, BYTE_BPE, decoded=True)
    return tokens.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_near_dedup", "documents")
def near_dedup(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents, percent=85)


@query(
    "op7_url_filter",
    "pages",
    r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host) + length(rule_path) DESC) = 1
""",
)
def url_filter(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules)


@query("op8_graph_search", "embeddings")
def graph_search(embeddings: DataFrame) -> DataFrame:
    return nearest_vectors(embeddings, F.col("vec_id") % 20 == 0)


@query("op9_suffix_dedup", "documents")
def suffix_dedup(documents: DataFrame) -> DataFrame:
    cut = remove_repeats(documents.select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_toxicity", "documents labels")
def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scores = toxicity_scores(documents, labels.where(~held_out))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted)


@query(
    "op11_source_divergence",
    "documents",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(string_split_regex(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w WHERE term <> '' GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM k GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o
QUALIFY part = 'pair' OR rank <= 200
""",
)
def source_divergence(documents: DataFrame) -> DataFrame:
    return divergence(documents)


def _leaf(text: Column) -> Column:
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])


@query(
    "op12_merkle_manifest",
    "documents",
    r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, lang, text, concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(CAST(source AS VARCHAR)) || ':' || source, '-'), coalesce(strlen(CAST(lang AS VARCHAR)) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, coalesce(strlen(CAST(text AS VARCHAR)) || ':' || text, '-') AS own,
    coalesce(strlen(CAST(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS VARCHAR)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lower,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || own) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || lower) ELSE sha256(head || own) END AS given
  FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM l),
node(lang, lvl, idx, n, h) AS (
  SELECT lang, 0, place, n, leaf FROM r
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lang, lvl, idx // 8, n),
subroot AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1),
top(lvl, idx, n, h) AS (
  SELECT 0, place, n, h FROM subroot
  UNION ALL
  SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 8, n),
beside AS (
  SELECT a.lang, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM node a JOIN node b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8
  WHERE a.n > 1 GROUP BY a.lang, a.lvl, a.idx),
above AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8
  WHERE a.n > 1 GROUP BY a.lvl, a.idx),
up(lang, place, lvl, idx, n, now, proof) AS (
  SELECT lang, place, 0, place, n, given, '' FROM r
  UNION ALL
  SELECT u.lang, u.place, u.lvl + 1, u.idx // 8, (u.n + 7) // 8, sha256(before || now || after), proof || before || after
  FROM up u JOIN beside b ON u.lang IS NOT DISTINCT FROM b.lang AND u.lvl = b.lvl AND u.idx = b.idx WHERE u.n > 1),
on_top(lang, place, lvl, idx, n, now, proof) AS (
  SELECT u.lang, u.place, 0, s.place, s.n, now, proof FROM up u JOIN subroot s ON u.lang IS NOT DISTINCT FROM s.lang WHERE u.n = 1
  UNION ALL
  SELECT u.lang, u.place, u.lvl + 1, u.idx // 8, (u.n + 7) // 8, sha256(before || now || after), proof || before || after
  FROM on_top u JOIN above b ON u.lvl = b.lvl AND u.idx = b.idx WHERE u.n > 1)
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.now AS folded_root, o.now = t.h AS verified
FROM r
JOIN on_top o ON r.lang IS NOT DISTINCT FROM o.lang AND r.place = o.place AND o.n = 1
JOIN subroot s ON r.lang IS NOT DISTINCT FROM s.lang
JOIN top t ON t.n = 1
""",
)
def merkle_manifest(documents: DataFrame) -> DataFrame:
    """Every leaf's proof, folded once more from the leaf of a row that may have been tampered with since."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", UPPER, UPPER.lower())
    leaves = documents.select("doc_id", "lang", _leaf(F.col("text")).alias("own"), F.when(altered, _leaf(lower)).alias("tampered"))
    proven = manifest(leaves, F.col("own"))
    proof = F.sha2(F.array_join(F.transform("segments", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    again = folded(F.coalesce("tampered", "own"), F.col("segments"))
    proven = proven.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_word_bpe", "documents")
def word_bpe(documents: DataFrame) -> DataFrame:
    tokens = encode_words(documents, MANY_LANGUAGES, public_tokenizers.PATTERN, decoded=True)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
