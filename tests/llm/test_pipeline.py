"""The pipeline's stages against plain versions of what they are for."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import quality_rules, surrogates
from tests.llm.test_operators import base_counts, plain_components, plain_removal

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.settle(stage(spark, docs, SF_DIR), "test-stage")
    return out


def test_stages_keep_the_columns_of_documents(stages):
    columns = stages["documents"].columns
    assert all(stages[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_quality_stage(stages):
    docs = stages["documents"]
    kept = {r["doc_id"] for r in stages["quality rules"].collect()}
    base = {r["doc_id"] for r in docs.collect() if (c := base_counts(r["text"]))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert kept <= base and kept == {r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect()}


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["quality rules"].collect()]
    want = sorted(i for i, _, _, kept in plain_components(rows, 80) if kept)
    assert sorted(r["doc_id"] for r in stages["MinHash near-dedup"].collect()) == want


def test_repeats_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages["MinHash near-dedup"].collect()}
    after = {r["doc_id"]: r for r in stages["suffix-array dedup"].collect()}
    assert set(before) == set(after)
    cut = {i for i, _, spans in plain_removal([(i, (t or "").encode()) for i, t in before.items()], corpus_pipeline.PASSAGE_BYTES) if spans}
    for i, r in after.items():
        assert (r["text"] == before[i]) == (i not in cut) and r["n_chars"] == len(r["text"])


def test_personal_data_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages["suffix-array dedup"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["PII"].collect()}
    plain = re.compile(r"[\w.%+-]+@[\w.-]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|(?<=password=)\w+|AKIA\w{16}")
    found = {m for t in before.values() for m in plain.findall(t)}
    assert set(before) == set(after) and found
    assert not found & {m for t in after.values() for m in plain.findall(t)}
    wider = re.compile(plain.pattern + r"|\b\d{16}\b|(?<=token = \")\w+")
    assert all(wider.split(after[i]) == wider.split(t) for i, t in before.items())
    assert surrogates.surrogate_table(stages["PII"], "x").count() > 0


def test_packing_stage(stages):
    tokenizer, fill, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(int), defaultdict(dict)
    for r in stages["best-fit packing"].collect():
        fill[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]][r["start"]] = r["ids"]
    assert max(fill.values()) <= 1024
    for r in stages["PII"].collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(pieces[r["doc_id"]][k] for k in sorted(pieces[r["doc_id"]])) == ids


def test_registered(spark):
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
