import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from lodestack.plans.storage import Scratch
import public_tokenizers

from lodestack.llm import bpe, mixing, quality, secrets, simhash


def test_stages_follow_from_each_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    a = corpus_pipeline.STAGES[0][1](spark, docs, small).cache()
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in a.collect()} == kept and a.columns == columns
    b = corpus_pipeline.STAGES[1][1](spark, a, small).cache()
    groups = {r.component_id for r in simhash.near_duplicates(a).collect()}
    assert {r.doc_id for r in b.collect()} == groups and b.columns == columns
    c = corpus_pipeline.STAGES[2][1](spark, b, small).cache()
    assert c.count() == b.count() and c.columns == columns
    assert secrets.scan(c).filter("secret").count() == 0
    d = corpus_pipeline.STAGES[3][1](spark, c, small).cache()
    assert d.columns == columns and d.count() == mixing.mix(c).count()
    e = corpus_pipeline.STAGES[4][1](spark, d, small).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len(e) == d.count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in e)


def test_run_and_stage_list(spark, small):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
    assert bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).value.tokens


def test_odd_rows_pass_through_every_stage(spark):
    """Nulls, repeated rows, a very long text and columns named like the operators' own."""
    prose = lambda i, n=80: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(1, prose(1), "a"), (1, prose(1), "a"), (2, prose(1) + " more", "a"), (3, None, "a"), (4, "", None), (None, prose(5), None), (6, prose(6, 60_000), None), (7, prose(7) + f' token = "{"a94f8fe5ccb19ba61c4c0873d391e987982fbbd3"}"', "b"), (8, prose(8), "b"), (9, "short", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ["lang", "n_chars", "_row", "_id", "_tx", "_host", "_gone", "h", "key", "node", "part", "candidate", "score", "cdf", "rate", "_name", "_u", "_n", "kept", "n_words", "component_id"]
    docs = docs.select("*", *[F.lit("x" if c != "n_chars" else 1).alias(c) for c in clash])
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "odd").table(stage(spark, docs, "unused"), "stage")
        seen[name] = docs.collect()
        if name != "byte-level bpe":
            assert docs.columns == ["doc_id", "text", "source", *clash]
    ids = lambda name: sorted((r.doc_id is None, r.doc_id or 0) for r in seen[name])
    assert ids("quality rules") == [(False, 1), (False, 1), (False, 2), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert ids("simhash near-dedup") == ids("secret scans") == [(False, 1), (False, 6), (False, 7), (False, 8), (True, 0)]
    clean = {r.doc_id: r for r in seen["secret scans"]}
    assert "[SECRET]" in clean[7].text and clean[7].n_chars == len(clean[7].text) and len(clean[6].text) == len(prose(6, 60_000))
    assert {r.doc_id for r in seen["mixing to target weights"]} <= set(clean)
    assert len(seen["byte-level bpe"]) == len(seen["mixing to target weights"])
