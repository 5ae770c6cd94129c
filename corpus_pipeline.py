"""A training corpus from ``documents``: quality, near-duplicates, repeats, personal data, packing.

Every stage works on all rows that the one before kept and returns the columns of ``documents``, the last one packed pieces.
Each is written as Parquet below ``spark.checkpoint.dir`` and read back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shipping import ship_code
from millrace.llm.near_dedup import drop_near_duplicates
from millrace.llm.packing import pack
from millrace.llm.quality_rules import keep_quality
from millrace.llm.repeats import remove_repeats
from millrace.llm.surrogates import replace_personal_data
from millrace.llm.tables import settle

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PII_KEY = "key of the corpus pipeline"
#: A passage of over 50 words has at least about so many bytes; the median of 51 words of ``documents`` is 305 to 340.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    ship_code(spark)
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one with the smallest id stays."""
    ship_code(spark)
    return drop_near_duplicates(docs, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of ``PASSAGE_BYTES`` that occur elsewhere go; so do characters that this has cut in two, and ``n_chars`` follows."""
    ship_code(spark)
    cut = remove_repeats(docs, length=PASSAGE_BYTES)
    kept, changed = F.col(cut.columns[-2]), F.size(cut.columns[-1]) > 0
    # What is left of a cut character is no UTF-8: it turns into U+FFFD, and that goes.
    text = F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "\ufffd+", "")
    n_chars = F.length(text).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.when(changed, text).otherwise(F.col("text")), "n_chars": F.when(changed, n_chars).otherwise(F.col("n_chars"))}
    return cut.withColumns(new).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to surrogates; ``n_chars`` follows, as those of IP addresses may be longer or shorter."""
    n_chars = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return replace_personal_data(docs, PII_KEY).withColumn("n_chars", n_chars)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``."""
    ship_code(spark)
    return pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("PII", personal_data),
    ("best-fit packing", packing),
]
#: Near-duplicates, repeats and packing have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
