"""Transactions, sortable ids, streams with timers, and what has no form in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import chunking, codec, compression
from lodestack.operators import items, oplog, store
from lodestack.plans import catalogue, storage
from lodestack.plans.views import Views
from lodestack.streaming import feed


def test_transactions_against_a_plain_loop(spark):
    rng = random.Random(3)
    held = {(p, f"k{k}") for p in range(4) for k in range(6) if rng.random() < 0.5}
    writes = [(t, rng.randrange(4) if rng.random() < 0.1 else p, f"k{rng.randrange(6)}", rng.choice(["put", "create", "replace", "delete"]), t * 10 + n) for t in range(200) for p in [rng.randrange(4)] for n in range(rng.randint(1, 3))]
    rows = spark.createDataFrame(writes, "txn long, pk long, sk string, op string, body long")
    before = spark.createDataFrame([(p, k, -1) for p, k in held], "pk long, sk string, body long")
    want, now = {}, {k: -1 for k in held}
    for t in range(200):
        mine = [w for w in writes if w[0] == t]
        keys = [(w[1], w[2]) for w in mine]
        if len({p for p, _ in keys}) > 1 or len(set(keys)) < len(keys):
            want[t] = "refused"
        elif all((w[3] != "create" or k not in now) and (w[3] != "replace" or k in now) for w, k in zip(mine, keys)):
            want[t] = "committed"
            for w, k in zip(mine, keys):
                now.pop(k, None)
                if w[3] != "delete":
                    now[k] = w[4]
        else:
            want[t] = "conflict"
    told = storage.Scratch(spark, "t").table(items.transact(before, rows), "verdicts")
    assert {r.txn: r.verdict for r in told.collect()} == want and len(set(want.values())) == 3
    assert {(r.pk, r.sk): r.body for r in items.apply(before, rows, told).collect()} == now


def test_sortable_ids(spark):
    rows = spark.createDataFrame([(1_700_000_000_000 + i // 40, i) for i in range(200)], "ms long, seq long")
    got = [(r.seq, r.id) for r in items.sortable_ids(rows, "ms", "seq").collect()]
    ids = [x for _, x in sorted(got)]
    assert ids == sorted(ids) and len(set(ids)) == 200 and all(len(x) == 26 and set(x) <= set(items.ALPHABET) for x in ids)
    value = 0
    for c in ids[0][:10]:
        value = value * 32 + items.ALPHABET.index(c)
    assert value == 1_700_000_000_000
    assert items.sortable_ids(rows.limit(0), "ms", "seq").count() == 0


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "a long, b long")
    assert all(r.n == r.a + 1 for r in storage.numbered(rows, "n", "a").collect())


def test_streaming_chunks_are_those_of_the_whole():
    rng = random.Random(1)
    params = chunking.ChunkParams.for_average(256)
    for size in (0, 1, 63, 64, 65, 1023, 1024, 1025, 20_000):
        data = rng.randbytes(size // 2) + b"ab" * (size // 4) + rng.randbytes(size - size // 2 - size // 4 * 2)
        ends = chunking.cuts(data, params)
        want = [data[i:j] for i, j in zip([0, *ends], ends)]
        assert b"".join(want) == data and all(len(x) <= params.largest for x in want)
        for read_size in (1, 7, 64, 1000, None):
            at = [0]

            def read(n):
                part = data[at[0] : at[0] + n]
                at[0] += len(part)
                return part

            assert list(chunking.chunk_stream(read, params, read_size)) == want


def test_the_format_is_pinned():
    assert codec.format_fingerprint() == "7fe7f41ed27eb62ee11659e68e907359eb49c2a6a2ae1689f9a18c8fddd90174"


def test_leases_run_out(spark, tmp_path):
    """A claim holds until its time is over; its holder renews it; then the next one gets it."""
    import time

    source, schema = tmp_path / "claims", "env long, worker string"
    source.mkdir()
    scratch = storage.Scratch(spark, "leases")
    out, n = scratch.path("out"), [0]

    def claims(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = feed.leases(spark.readStream.schema(schema).parquet(str(source)), 8_000)
        n[0] += 1
        query = stream.writeStream.outputMode("append").option("checkpointLocation", scratch.base + "/check").trigger(once=True).foreachBatch(lambda b, k: b.write.mode("append").parquet(f"{out}/{n[0]}")).start()
        assert query.awaitTermination(60)  # one batch: timers alone would go on for ever
        return {(r.env, r.worker): r.granted for r in spark.read.schema("env long, worker string, granted boolean").parquet(f"{out}/{n[0]}").collect()}

    begin = time.time()
    assert claims((1, "a"), (2, "b")) == {(1, "a"): True, (2, "b"): True}
    second = claims((1, "c"), (2, "b"))
    if time.time() - begin < 7:
        assert second == {(1, "c"): False, (2, "b"): True}
    time.sleep(9)
    assert claims((1, "c"), (2, "d")) == {(1, "c"): True, (2, "d"): True}


def test_late_events_after_the_watermark_are_dropped(spark, tmp_path):
    """Windows close behind the watermark; what comes later than that is not counted."""
    schema, source = "event_id long, user_id long, event_type string, ts timestamp", tmp_path / "e"
    scratch = storage.Scratch(spark, "late")
    out = scratch.path("out")

    def send(k, *rows):
        spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, 1, 'x', timestamp '{t}')" for i, t in rows) + " AS t(event_id, user_id, event_type, ts)").selectExpr("cast(event_id as long) event_id", "cast(user_id as long) user_id", "event_type", "ts").coalesce(1).write.mode("append").parquet(str(source))
        stream = feed.daily_counts(spark.readStream.schema(schema).parquet(str(source)), "1 hour")
        stream.writeStream.outputMode("append").option("checkpointLocation", scratch.base + "/check").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{out}/{k}")).start().awaitTermination(60)
        return sorted((str(r.day)[:10], r.n) for r in spark.read.schema("day timestamp, event_type string, n long").parquet(f"{out}/{k}").collect())

    source.mkdir()
    assert send(1, (1, "2024-01-01 10:00:00"), (2, "2024-01-01 23:30:00")) == []
    assert send(2, (3, "2024-01-01 23:50:00"), (4, "2024-01-03 12:00:00")) == [("2024-01-01", 3)]
    assert send(3, (5, "2024-01-01 09:00:00"), (6, "2024-01-05 00:00:00")) == [("2024-01-03", 1)]


def test_chunk_dedup_by_brute_force(spark, small):
    """What ``chunk_dedup`` says, from the chunker and a set."""
    params, seen, offered, created, stored = chunking.ChunkParams.for_average(1024), set(), 0, 0, 0
    total = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        data, start = r.text.encode(), 0
        for end in chunking.cuts(data, params):
            part, start = data[start:end], end
            offered, total = offered + 1, total + len(part) + 2
            if part not in seen:
                seen.add(part)
                created, stored = created + 1, stored + len(part) + 2
    got = catalogue.queries()["chunk_dedup"](spark, small).first()
    assert (got.offered, got.created, got.bytes_offered, got.bytes_stored) == (offered, created, total, stored)
    assert got.dedup_ratio == pytest.approx((total - stored) / total, abs=1e-6)


def test_zstd_sizes_by_the_library(spark, small):
    import zstandard

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = catalogue.queries()["zstd_sizes"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        stored = next(v for k, v in r.asDict().items() if "stored" in k)
        raw = texts[r["key"]]
        assert stored <= len(raw) + 16 and (len(raw) < 400 or stored < len(raw))
    data = b"some bytes " * 500
    assert zstandard.ZstdDecompressor().decompress(zstandard.ZstdCompressor().compress(data)) == data and compression.stored_sizes is not None


def test_cas_updates_by_a_plain_fold(spark, small):
    rows = catalogue.queries()["cas_updates"](spark, small).collect()
    state = {}
    for r in sorted(rows, key=lambda r: (r.env, r.ref, r.seq)):
        generation, alive = state.get((r.env, r.ref), (0, False))
        fine = not alive if r.op == "create" else alive and not r.tag and r.expected == generation
        if fine:
            generation, alive = (1 if r.op == "create" else generation + 1), r.op != "delete"
            state[r.env, r.ref] = generation, alive
        assert (r.verdict, r.generation) == ("accepted" if fine else "conflict", generation)
    log = Views(spark, small).oplog()
    assert len(rows) == log.count() and {r.verdict for r in rows} == {"accepted", "conflict"}


def test_reverts_branches_and_labels(spark):
    log = spark.createDataFrame([(1, 1, "main", 10), (1, 2, "main", 11), (1, 3, "dev", 20), (2, 1, "main", 30)], "env long, sequence long, ref string, after long")
    commits = spark.createDataFrame([(10,), (20,)], "node long")
    asked = spark.createDataFrame([(1, "main", 10), (1, "main", 11), (1, "main", 20), (2, "main", 10)], "env long, ref string, to long")
    assert [tuple(r) for r in oplog.revert(log, commits, asked).collect()] == [(1, 4, "main", 11, 10)]
    refs = oplog.refs(log)
    want = spark.createDataFrame([(1, "b", None, None), (1, "main", 5, None), (2, "c", 7, 1), (3, "d", None, None)], "env long, ref string, target long, ttl_days int")
    assert sorted(tuple(r) for r in oplog.create_branches(refs, want, "main", 100).collect()) == [(1, "b", 11, 1, None), (2, "c", 7, 1, 100 + 86_400_000_000)]
    rows = spark.createDataFrame([(1, 1, "active", {"a": "1", "b": "2"}), (1, 2, None, {"b": "3"}), (1, 3, "archived", None), (2, 1, None, None)], "env long, seq long, state string, labels map<string,string>")
    assert {r.env: (r.state, r.labels) for r in oplog.labels_now(rows).collect()} == {1: ("archived", {"b": "3"}), 2: (None, None)}


def test_objects_are_written_once_each(spark, tmp_path):
    rows = store.chunks_of(spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")).select("name", "framed")
    back = items.write_objects(rows, f"file://{tmp_path}/objects")
    assert back.count() == 2 and back.filter(F.lower(F.hex(F.substring("name", 1, 1))) != F.col("shard")).count() == 0
