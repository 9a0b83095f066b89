import math

from pyspark.sql import functions as F

from lodestack.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_matches_sql(spark, small, same):
    assert same(mixing.query(spark, small), mixing.SQL) > 100


def test_rates_and_distribution(spark):
    rows = [(i, "x" * 10, "a") for i in range(4000)] + [(10_000 + i, "x" * 10, "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, weights={"a": 1, "b": 1}, budget=80_000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 4000) < 250 and abs(n["b"] - 4000) < 250
    copies = got.filter("source = 'b'").groupBy("doc_id").count()
    share = copies.filter("count = 4").count() / 1000
    assert abs(share - math.exp(-4) * 4**4 / 24) < 0.05
    again = mixing.mix(docs.repartition(7), weights={"a": 1, "b": 1}, budget=80_000)
    assert sorted(map(tuple, got.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))


def test_large_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(20)], SCHEMA)
    n = mixing.mix(docs, weights={"a": 1}, budget=20 * 2000).count()
    assert abs(n - 40_000) < 1500


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "text", None), (3, "text", None), (None, "text", "b"), (4, "y" * 100_000, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit("clash")).withColumn("cdf", F.lit(1)).withColumn("rate", F.lit(2))
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "cdf", "rate", "copy", "shuffle_key"]
    assert got.filter("source = 'a'").groupBy("doc_id").count().count() <= 2
    two = got.filter("doc_id = 3").count()
    assert two % 2 == 0
    assert mixing.mix(docs, weights={}).count() <= 2 * 6
    assert mixing.mix(docs, weights={"zz": 1.0}).filter("source = 'b'").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sources_without_characters_or_weight(spark):
    rows = [(i, None, "none") for i in range(300)] + [(1000 + i, "text", "some") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert 200 < mixing.mix(docs).filter("source = 'none'").count() < 400  # a mean of one copy
    assert 200 < mixing.mix(docs, weights={"none": 1.0, "some": 1.0}).filter("source = 'none'").count() < 400
    assert mixing.mix(docs, weights={"some": 1.0}).filter("source = 'none'").count() == 0


def test_null_ids_share_no_shuffle_key(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(200)], SCHEMA)
    got = mixing.mix(docs)
    assert got.select("shuffle_key").distinct().count() > 150


def test_copies_by_brute_force(spark):
    """Counts of copies from the definition, in plain Python."""
    import hashlib

    rows = [(i, "x" * (i % 7), "abc"[i % 3]) for i in range(300)]
    chars = {s: sum(len(t) for _, t, x in rows if x == s) for s in "abc"}
    want = {}
    for i, _, s in rows:
        rate = chars[s] ** 0.5 / sum(c**0.5 for c in chars.values()) * sum(chars.values()) / chars[s]
        u = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:15], 16) / 2**60
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        if n:
            want[i] = n
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == want
