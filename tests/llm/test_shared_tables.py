"""Divergence, manifest and word BPE against plain versions; hostile texts and repeated ids for surrogates and search."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from checks.compare import duck, rows_of
from checks.shipping import ship_code
from millrace.llm import divergence, graph_search, manifest, queries, surrogates, word_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Columns that every operator has to live with: names it may use itself.
ODD = {"g": "1", "term": "'t'", "n": "3", "tree": "'t'", "rank": "4", "digest": "'d'", "left": "5", "leaf": "'l'", "root": "0", "block": "6", "ids": "7", "id": "8", "part": "'p'"}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_code(spark)


def corpus():
    r = random.Random(8)
    some = [" ".join(r.choice(["Ab", "cd", "éa", "x1", "the", "of", "漢字", "I'm", "12", "-", "\n"]) for _ in range(r.randrange(60))) for _ in range(90)]
    odd = [None, "", "   ", "\n \t\n", "a" * 3000, " " * 3000, "<|endoftext|> it's", "😀" * 50, "ab " * 20_000, "x y　 z\x00\x1c", "Ünïcode ÉA"]
    langs, sources = ["en", "de", None, "", "fr"], ["s1", "s2", None, "s3"]
    rows = [(k, t, langs[k % 7 % 5], sources[k % 11 % 4], len(t or "")) for k, t in enumerate(some + odd)]
    return rows + [rows[3], (3, "other", "de", "s1", None), (None, "no id", "en", "s2", 5), (None, "no id", "en", "s2", 5), (500, "alone", "is", "s9", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in ODD.items()])


def test_queries_equal_their_sql(spark, docs, tmp_path):
    docs.repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op11_source_divergence", "op12_merkle_manifest"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(queries.ORACLES[name])
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall()), name


# op 11


def plain_divergence(rows):
    count, has, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        count[lang, source].update(terms)
        has[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in has[lang].items() if k >= 3]
        own = [s for x, s in groups if x == lang]
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        total = {s: sum(count[lang, s][t] for t in kept) for s in own}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in own}
        q = {t: share(sum(count[lang, s][t] for s in own), sum(total.values())) for t in kept}
        priced = lambda a, b: (a - b) ** 2 // b
        pairs = [(-sum(priced(p[source][t], p[s][t]) for t in kept), s.encode(), s) for s in own if s != source]
        terms = [(-priced(p[source][t], q[t]), t.encode(), t) for t in kept if count[lang, source][t] and p[source][t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            out |= {(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found), 1) if part == "pair" or k <= 200}
    return out


def test_divergence(docs):
    got = divergence.divergence(docs).collect()
    want = plain_divergence(corpus())
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert divergence.divergence(docs.where("false")).count() == 0


def test_divergence_over_several_blocks(docs):
    """One group in a block of columns, few columns in a product, few terms in a block."""
    small = divergence.divergence(docs, group_block=1, column_block=2, term_block=3)
    assert {tuple(r) for r in small.collect()} == plain_divergence(corpus())


def test_products_hold_all_joint_tables():
    r = np.random.default_rng(2)
    counts = r.integers(0, 5, (300, 70)) * (r.random((300, 70)) < 0.4)
    entries = [[{"g": int(g), "n": int(n)} for g, n in enumerate(row) if n] for row in counts]
    import pyarrow as pa

    kind, found = pa.list_(pa.struct([("g", pa.int32()), ("n", pa.int64())])), Counter()
    for left, right in ((0, 0), (0, 1), (1, 1)):
        m = len(entries)
        table = pa.table({"lang": ["x"] * m, "left": [left] * m, "right": [right] * m, "groups": [70] * m, "entries": pa.array(entries, kind)})
        for c in divergence._multiplied(64, 100)(table).to_pylist():
            found[c["g"], c["h"], c["a"], c["b"]] += c["times"]
    want = Counter((g, h, int(row[g]), int(row[h])) for row in counts for g in range(70) for h in range(g + 1, 70) if row[g] or row[h])
    assert found == want


# op 12


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root and, for every leaf, its siblings from below as (before, after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run, j = runs[i // 8], i % 8
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
        level, at = [H(*run) for run in runs], [i // 8 for i in at]
    return level[0], paths


def test_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, (r[0], r[3], r[2], r[4], r[1])))
    lower = lambda t: t and "".join(c.lower() if c.isascii() else c for c in t)
    trees = defaultdict(list)
    for r in corpus():
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = plain_tree([x[2] for x in trees[name]])
    root, above = plain_tree([built[name][0] for name in names])
    want = []
    for name, up in zip(names, above):
        for (_, _, own, r), path in zip(trees[name], built[name][1]):
            path, tampered = path + up, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((r[0], lower(r[1]), *r[2:])) if tampered else own
            for before, after in path:
                now = H(before, now, after)
            want.append((r[0], own, built[name][0], root, H(*[x for s in path for x in s]), now, now == root))
    got = [tuple(r) for r in queries.merkle_manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[-1] for r in got} == {True, False}
    assert queries.merkle_manifest(docs.where("false")).count() == 0
    one = queries.merkle_manifest(docs.where("doc_id = 500")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == H()


@pytest.mark.parametrize("n", [8, 9, 64, 65, 600])
def test_manifest_of_one_tall_tree(spark, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS lang", "sha2(CAST(id % 5 AS STRING), 256) AS own")
    got = manifest.manifest(rows, F.col("own")).orderBy("doc_id").collect()
    root, paths = plain_tree([H(str(k % 5)) for k in range(n)])
    assert {r["root"] for r in got} == {root} and [[tuple(s) for s in r["segments"]] for r in got] == paths


# op 13


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_of_every_kind(library):
    ranks, cut = {t: k for k, t in enumerate(word_bpe.token_bytes(RANKS))}, regex.compile(public_tokenizers.PATTERN)
    points = [c for c in range(0, 0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x3000, 0x110000, 97))
    for c in points:
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}b 1{chr(c)}2  {chr(c)} {chr(c)}{chr(c)} x"
        assert [i for w in cut.findall(text) for i in word_bpe.merged(w.encode(), ranks)] == library.encode_ordinary(text), hex(c)
    r = random.Random(3)
    for _ in range(300):
        word = bytes(r.choice(b"abetho n\xc3\xa9\xff") for _ in range(r.randrange(1, 60)))
        assert word_bpe.merged(word, ranks) == library._core_bpe.encode_single_piece(word)
    start = time.time()
    tokens = word_bpe.token_bytes(RANKS)
    assert b"".join(tokens[i] for i in word_bpe.merged(b"abc" * 200_000, ranks)) == b"abc" * 200_000
    assert time.time() - start < 60


def encoded(docs, library, **sizes):
    got = word_bpe.encode_words(docs, RANKS, public_tokenizers.PATTERN, decoded=True, **sizes)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in corpus()]
    assert sorted(((r[0], list(r[1]), bytes(r[2])) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_word_bpe(docs, library):
    encoded(docs, library)
    assert word_bpe.encode_words(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0
    tokens = word_bpe.encode_words(docs, RANKS, public_tokenizers.PATTERN).unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "CAST(NULL AS ARRAY<INT>) AS ids"))
    back = sorted(((r[0], bytes(r[1])) for r in word_bpe.decode_words(tokens, RANKS).collect()), key=repr)
    assert back == sorted([(r[0], (r[1] or "").encode()) for r in corpus()] + [(-1, b"")], key=repr)


def test_word_bpe_over_several_blocks(docs, library):
    encoded(docs, library, block_bytes=500)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(word_bpe, "PART_CHARS", 40)
    text, words, cut = "ab  cd 12, x\n\ny " * 90, regex.compile(public_tokenizers.PATTERN).findall, regex.compile(r"(?<=\S) (?=\S)")
    parts = list(word_bpe._parts(text, cut))
    assert len(parts) > 20 and [w for p in parts for w in words(p)] == words(text)


# op 2


def test_mentions_equal_those_of_a_plain_search(spark):
    """The same patterns, run text by text outside Spark."""
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(["bob@a.example.com.2. x@aa.bb.1. y@b.c1 z@.com w@com", "password    = abc1", "token:\t'a\\'b'", "access.token=1;secret=2", "x@y..example.com"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    find, table = regex.compile(surrogates._ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"), regex.ASCII), {}
    for r in surrogates.surrogate_table(docs, "k").collect():
        table[r["mention"]] = r["replacement"]
    want = {i: find.sub(lambda m: table.get(m[0], m[0]), t) for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_personal_data(docs, "k").collect()}
    assert got == want and len(table) > 15
    assert set(table) <= {m[0] for _, t in rows for m in find.finditer(t)}
    assert "abc1" not in got[10_001] and "bob@a.example.com" not in got[10_000] and "x@aa.bb" not in got[10_000]


HOSTILE = {
    "labels": "x@" + "a." * 500_000 + "com", "dots": "x@" + "." * 1_000_000 + "com", "escapes": 'password="' + '\\"' * 500_000 + '" end', "open quote": "token='" + "\\'" * 500_000,
    "digits": "1" * 1_000_000, "grouped": "123 456 " * 125_000, "capitals": "Mr. " + "A" * 1_000_000, "names": "Mr. Ab " * 140_000, "words": "token" * 200_000, "labelled": "secret_" * 140_000 + "= x",
    "spaces": "password" + " " * 1_000_000 + "= hidden", "signs": "@" * 1_000_000, "local": "a" * 1_000_000 + "@b", "value": "token=" + "Ab3" * 330_000, "octets": "1." * 500_000,
}


def test_surrogates_of_hostile_texts(spark):
    texts = {k: t[:40_000] + t[-12:] for k, t in HOSTILE.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(4)
    start = time.time()
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_personal_data(docs, "k").collect()}
    assert set(got) == set(HOSTILE) and time.time() - start < 200
    assert "hidden" not in got["spaces"] and "Ab3Ab3Ab3" not in got["value"] and not got["labels"].startswith("x@a.a.a.a")


# op 8


def test_repeated_ids_are_rows_of_their_own(spark):
    r = np.random.default_rng(6)
    rows = [(k % 50, r.normal(size=8).astype("float32").tolist()) for k in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_search.nearest_vectors(table, F.col("vec_id") % 20 == 0, k=5).collect()
    want = Counter()
    for k, (q, v) in enumerate(rows):
        if q % 20 == 0:
            score = lambda w: math.fsum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, w))  # noqa: B023, E731
            near = sorted((-score(w), i) for j, (i, w) in enumerate(rows) if j != k)[:5]
            want.update((q, n, i) for n, (_, i) in enumerate(near, 1))
    assert Counter((x["query_id"], x["rank"], x["vec_id"]) for x in got) == want


def test_recall_on_a_shard_much_larger_than_the_beam():
    x = np.random.default_rng(9).standard_normal((graph_search.SHARD_ROWS, 64)).astype(np.float32)
    graph = graph_search.Graph(x, float(np.sqrt((x.astype(float) ** 2).sum(1).max()))).build()
    q = x[::20]
    found, _ = graph.search(np.column_stack([q, np.zeros(len(q), np.float32)]), graph_search.SEARCH_BEAM, 8)
    exact = np.argsort(-(q @ x.T), 1)[:, :21]
    assert np.mean([len({*a[:21]} & {*b}) / 21 for a, b in zip(found.tolist(), exact.tolist())]) > 0.95


def test_intermediate_tables_are_written_small(spark):
    from millrace.sources.scratch import settled

    files = settled(spark.range(100).selectExpr("id", "repeat('text ', 50) AS text"), "small").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
