import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import op1_secrets, op2_simhash, op8_toxicity
from tessera.llm.queries import QUERIES


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage's rows from its own input, worked out row by row; the mix is held to its totals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = op8_toxicity.train(docs, labels).scorer()
    before = docs.collect()
    (_, toxicity), (_, copies), (_, secrets), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    clean = toxicity(spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in before if score((r["text"] or "").encode()) < op8_toxicity.THRESHOLD}
    single = copies(spark, clean, sf_dir).cache()
    prints = sorted((r["doc_id"], op2_simhash.fingerprint((r["text"] or "").encode())) for r in clean.collect())
    parent = {d: d for d, _ in prints}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (d, a) in enumerate(prints):
        for e, b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in single.collect()} == {d for d, _ in prints if find(d) == d}
    hidden = secrets(spark, single, sf_dir).cache()
    spans = {r["doc_id"]: r for r in op1_secrets.scan(single, op1_secrets.default_model(spark, single)).collect()}
    for r in hidden.collect():
        text, at, out = spans[r["doc_id"]]["text"], 0, []
        for s, _, e in sorted([*spans[r["doc_id"]]["base_spans"], *spans[r["doc_id"]]["added_spans"]]):
            if s >= at:
                out.append(text[at:s] + "[SECRET]")
            at = max(at, e)
        assert r["text"] == "".join(out) + text[at:]
    mixed = mix(spark, hidden, sf_dir).cache()
    assert clean.columns == single.columns == hidden.columns == mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in hidden.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, tokenizer.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest()) for r in mixed.collect())
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in tokens(spark, mixed, sf_dir).collect())
    assert got == want
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in QUERIES["pipeline"](spark, sf_dir).collect()) == want


def test_one_row_of_each_group_of_copies_stays(spark):
    """Repeated rows, copies without ids, and an id that two texts share."""
    a, b, c, d = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red orange yellow green blue indigo", "north east south west up down left")
    rows = [(5, a, "x")] * 3000 + [(None, a, "x")] * 40 + [(9, a, "y")] + [(None, b, s) for s in "yxy"] * 30 + [(9, c, "x"), (7, d, "x"), (7, d, "a"), (9, d, "x"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(got.collect()) == key([(5, a, "x"), (None, b, "x"), (9, c, "x"), (7, d, "a"), (None, None, "x")])


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with the names that stages use."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "a", 0), (7, "long words " * 20000, None, None, 9), (7, "x" * 40000, "en", "a", 1), (8, "secret: ABCDEFGHIJKLMNOP1234 in a text", "en", None, 5)]
    docs = real.unionByName(spark.createDataFrame(odd + [(9, "one row that is here three times", "en", "b", 3)] * 3, real.schema))
    for name in ("tie", "own", "copies", "kept", "spans", "clean", "_gone", "size", "share", "ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        docs = got.cache()
        if name == "simhash near-dedup":
            rows = docs.collect()
            assert {(r["doc_id"], r["text"]) for r in rows} <= before and sum(r["doc_id"] == 9 and r["text"].startswith("one row") for r in rows) == 1
            assert any(r["text"] == "x" * 40000 for r in rows) and all(r["tie"] == r["ids"] == "clash" for r in rows)
        if name == "secret scans":
            assert all("ABCDEFGHIJKLMNOP1234" not in (r["text"] or "") for r in docs.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    want = sorted((str(r["doc_id"]), tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in tokens) == want and all(r["n_tokens"] == len(r["ids"]) for r in tokens)
