import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import simhash
from lodestack.llm.components import connected_components
from lodestack.plans.storage import Scratch

SCHEMA = "doc_id long, text string"


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB éÄ\n\t\x0b\x1c.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_print(text)


def test_fingerprint_of_null_and_of_long_text():
    assert simhash.fingerprint(None) == 0
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_print(text)


def test_query_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = brute_components(ids, links)
    got = {r.doc_id: r for r in simhash.query(spark, small).collect()}
    assert {i: (got[i].fingerprint, got[i].component_id) for i in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("large", [1 << 16, 8])
def test_links_lose_no_pair(spark, monkeypatch, large):
    """Random fingerprints and a ball of close ones, found through every variant."""
    monkeypatch.setattr(simhash, "_LARGE_RUN", large)
    random.seed(5)
    centre = random.getrandbits(64)
    values = {random.getrandbits(64) for _ in range(50)} | {centre}
    for _ in range(250):
        x = centre
        for b in random.sample(range(64), random.randint(1, 7)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = simhash.signatures(spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, rep long")).orderBy("key").collect()
    table = [np.array([r[c] for r in rows]) for c in ("key", "fp", "rep")]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 1000]) for x in table], ["key", "fp", "rep"]) for k in range(0, len(rows), 1000)]
    found = {(a, b) for batch in simhash._links(iter(batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns))}
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in found)
    all_links = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    assert brute_components(range(len(values)), found) == brute_components(range(len(values)), all_links)


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, "  \n"), (1, "some words that stand here alone"), (1, "some words that stand here alone"), (2, "SOME words that stand here alone"), (None, "some words that stand here alone"), (7, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("key", F.lit(3))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (1, 1), (1, 1), (2, 1), (None, None), (7, 7)], key=str)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 7, None], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (None, 4)]
    edges += [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {x for e in real for x in e}
    assert got == brute_components(nodes, real)
