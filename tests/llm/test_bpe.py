import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = ["", "  a\n\n b", "\x1c\x1d x 12½²Ⅷ 一二 漢字 <|endoftext|>   y", "\U0001d400 \U00010d40 \U00010d4a Ᲊ ꟑ \U0001e4d0 it's we'll", " \t\x85\xa0z", "ab" * 5000, "é́ ñ 😀👩‍👩‍👧", "\0\x7f", "don't DON'T 's", "x" * 3000]


@pytest.fixture(scope="module")
def tables():
    with open(PATH, "rb") as f:
        return bpe.ByteBPE.from_rank_lines(f, PATTERN)


@pytest.fixture(scope="module")
def library(tables):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: int(i) for t, i in zip(tables.tokens, tables.ids)}, special_tokens={})


def test_the_hash_is_perfect_and_minimal(tables):
    slots = tables.hash.slots(bpe.PerfectHash.hashes(tables.tokens))
    assert sorted(slots.tolist()) == list(range(len(tables.tokens)))
    assert (tables.hash.key_at[slots] == np.arange(len(tables.tokens))).all()


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_heap_merges_like_the_library(tables, library, word):
    assert tables.merge(word) == library._core_bpe.encode_single_piece(word)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_lists_encode_like_the_library(tables, library, texts):
    words = pa.array([tables.cut(t) for t in texts], pa.list_(pa.string()))
    got = list(tables.encode_lists(words, pa.array(texts, pa.string())))
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [tables.decode(x).decode() for x in got] == texts


def test_query_against_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r for r in bpe.query(spark, small).collect()}
    for d in docs:
        ids = np.array(library.encode_ordinary(d.text), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_odd_texts_through_spark(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "same"), (91, "same"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("ids", F.lit(2))
    sent = bpe.load(spark, PATH, PATTERN)
    ids = bpe.encode(docs, sent, PATTERN)
    got = sorted(((r.doc_id, r.ids) for r in ids.collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    back = sorted(((r.doc_id, bytes(r.content).decode()) for r in bpe.decode(ids, sent).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)
    assert bpe.round_trip(docs.limit(0), sent, PATTERN).count() == 0


def test_small_chunks_change_nothing(tables, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    words = pa.array([tables.cut(t) for t in ODD], pa.list_(pa.string()))
    assert [x.tolist() for x in tables.encode_lists(words, pa.array(ODD))] == [library.encode_ordinary(t) for t in ODD]
