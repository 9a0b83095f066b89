import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestack.llm import warc
from lodestack.plans.storage import Scratch

SCHEMA = "page_id long, url string, html string"


def test_matches_sql(spark, small, same):
    assert same(warc.query(spark, small), warc.SQL) == 50


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/ü?x=1", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "u", "x" * 300_000), (9, "u", "<p>é\r\n\r\nWARC/1.1</p>"), (7, "v", "<p>é\r\n\r\nWARC/1.1</p>"), (None, "w", "<p>é\r\n\r\nWARC/1.1</p>"), (5, "r", "same row"), (5, "r", "same row")]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("refers_to", F.lit("clash"))
    scratch = Scratch(spark, "t")
    index = scratch.table(warc.write(pages, scratch.path("a")), "index")
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for page, url, html in rows:
        data = (html or "").encode()
        r = by[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if r.record_type == "response":
            assert bytes(r.payload) == data
    assert {p: (by[p].record_type, by[p].refers_to) for p in (1, 7, 9, 3, 2, 5)} == {1: ("response", None), 7: ("revisit", 1), 9: ("revisit", 1), 2: ("response", None), 3: ("revisit", 2), 5: ("response", None)}
    assert by[1].url == "http://a/ü?x=1" and by[2].url is None and "\n" not in by[3].url
    some = warc.read(index.filter("page_id in (4, 7)"))
    assert sorted(r.page_id for r in some.collect()) == [4, 7]
    assert warc.read(index.limit(0)).count() == 0
    assert warc.write(pages.limit(0), scratch.path("b")).count() == 0


def test_small_payloads_may_all_be_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], SCHEMA)
    got = {r.page_id: r.refers_to for r in warc.revisits(pages, least_bytes=5).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_ranges_coalesce():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 200_000, 7), ("b", 0, 4), ("b", 4, warc.SPAN), ("b", warc.SPAN + 4, 1)]
    assert list(warc.ranges(places)) == [("a", 0, 15, [0, 1]), ("a", 200_000, 7, [2]), ("b", 0, 4, [3]), ("b", 4, warc.SPAN, [4]), ("b", warc.SPAN + 4, 1, [5])]
    assert list(warc.ranges([])) == []


def test_archives_roll_over_and_damage_is_seen(spark, monkeypatch):
    member, name = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(member)["payload_digest"] == name
    import zlib

    whole = zlib.decompress(member, 31).replace(b"payload\r\n", b"pAyload\r\n")
    gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(whole) + gzip.flush())


def test_reading_is_dealt_by_archive_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 4096)
    pages = spark.createDataFrame([(i, "u", "".join(chr(33 + (i * 7 + k * k) % 90) for k in range(3000))) for i in range(60)], SCHEMA)
    scratch = Scratch(spark, "t")
    index = scratch.table(warc.write(pages, scratch.path("a")), "index")
    got = warc.read(index)
    assert got.rdd.getNumPartitions() > 1 and got.count() == 60
