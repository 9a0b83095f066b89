"""Chunking, encoding, shapes, names and compression."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import chunking, codec, compression, naming
from lodestack.operators import trees


def scalar_cut(data, start, p, table):
    """The definition: hash from the smallest size on, beginning at zero."""
    n = min(len(data) - start, p.largest)
    if n <= p.smallest:
        return n
    h, normal = 0, min(p.average, n)
    for i in range(p.smallest, n):
        h = ((h << 1) + int(table[data[start + i]])) & (1 << 64) - 1
        if not h & (p.strict if i < normal else p.loose):
            return i
    return n


def scalar_cuts(data, p):
    table, ends, start = chunking.gear_table(), [], 0
    while start < len(data):
        start += scalar_cut(data, start, p, table)
        ends.append(start)
    return ends


@pytest.mark.parametrize("average", [8, 64, 256, 1024])
@pytest.mark.parametrize("seed", range(6))
def test_kernel_equals_the_definition(average, seed):
    r = random.Random(seed)
    data = r.randbytes(r.randrange(0, 20_000)) if seed % 2 else bytes(r.choice(b"ab") for _ in range(6000)) + b"\0" * 5000
    p = chunking.ChunkParams.for_average(average)
    assert chunking.cuts(data, p) == scalar_cuts(data, p)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_make_up_the_content(data):
    p = chunking.ChunkParams.for_average(64)
    ends = chunking.cuts(data, p)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(0 < n <= p.largest for n in sizes) and all(n >= p.smallest for n in sizes[:-1])


def test_insertions_leave_most_chunks():
    data = random.Random(9).randbytes(400_000)
    p = chunking.ChunkParams.for_average(1024)

    def pieces(d):
        ends = chunking.cuts(d, p)
        return {d[a:b] for a, b in zip([0, *ends], ends)}

    old = pieces(data)
    assert 0.6 * 1024 <= len(data) / len(old) <= 1.6 * 1024
    assert len(pieces(data[:200_000] + b"x" * 16 + data[200_000:]) - old) <= 3
    new = pieces(data[:500] + b"y" * 64 + data[500:])
    assert sum(map(len, new & old)) > 0.9 * len(data)
    assert sum(map(len, pieces(data[:100_000] + bytes(2000) + data[102_000:]) - old)) < 20_000
    with pytest.raises(ValueError):
        chunking.ChunkParams.for_average(100)


def test_production_masks():
    p = chunking.PRODUCTION
    assert (p.smallest, p.average, p.largest) == (256 << 10, 1 << 20, 4 << 20)
    assert (p.strict, p.loose) == (0xFFFFFC0000000000, 0xFFFFC00000000000)


def test_null_and_empty_content_has_no_chunk(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"abc")], "k long, c binary")
    assert [(r.k, r.length) for r in chunking.chunk(rows, "k", "c").collect()] == [(3, 3)]


A, B = b"\xaa" * 32, b"\xbb" * 32
OBJECTS = [
    b"x",
    codec.Blob(0, ()),
    codec.Blob(1, ((A, 1000), (B, 2000))),
    codec.Tree(0, ()),
    codec.Tree(0, (codec.Entry(b"README.md", codec.FILE, A, 0o644, 11), codec.Entry(b"data", codec.DIRECTORY, B, 0, 0), codec.Entry(b"run.sh", codec.FILE, A, 0o755, 42))),
    codec.Commit(A, (A, B), b"\xcd" * 16, "one", "two", -5, "m\n", (("a", "1"), ("b", ""))),
]


@pytest.mark.parametrize("obj", OBJECTS)
def test_codec_round_trip_and_strictness(obj):
    framed = codec.encode(obj)
    assert codec.decode(framed) == obj and codec.is_canonical(framed)
    for bad in (framed + b"\0", framed[:-1], b"\x09" + framed[1:], framed[:1] + b"\x02" + framed[2:], b""):
        assert not codec.is_canonical(bad) or isinstance(obj, bytes)


def test_golden_encodings():
    assert codec.encode(b"hello") == b"\x01\x01hello"
    assert codec.encode(codec.Blob(0, ((A, 11),))) == b"\x02\x01\0\0\0\0\x01" + A + (11).to_bytes(8, "big")
    assert codec.encode(OBJECTS[4]).startswith(b"\x03\x01\0\0\0\0\x03\x09README.md\x01" + A + b"\x01\xa4" + (11).to_bytes(8, "big"))


@pytest.mark.parametrize(
    "obj",
    [
        b"",
        codec.Blob(1, ((A, 1),)),
        codec.Blob(0, ((A, 0),)),
        codec.Tree(0, (codec.Entry(b"b", 1, A, 0o644, 1), codec.Entry(b"a", 1, A, 0o644, 1))),
        codec.Tree(0, (codec.Entry(b"..", 1, A, 0o644, 1),)),
        codec.Tree(0, (codec.Entry(b"a/b", 1, A, 0o644, 1),)),
        codec.Tree(0, (codec.Entry(b"a", 1, A, 0o600, 1),)),
        codec.Tree(0, (codec.Entry(b"a", 4, A, 0, 1),)),
        codec.Commit(A, (A, A), b"\0" * 16, "a", "a", 0, ""),
        codec.Commit(A, (), b"\0" * 16, "", "a", 0, ""),
        codec.Commit(A, (), b"\0" * 16, "a", "a", 0, "", (("b", ""), ("a", ""))),
    ],
)
def test_what_is_not_canonical(obj):
    with pytest.raises(codec.NotCanonical):
        codec.encode(obj)


SHAPE = trees.Shape(8, 2, 32, 4096)


def _entries(n, salt=0):
    return [codec.Entry(b"f%06d" % i, codec.FILE, hashlib.sha256(b"%d" % (i + salt)).digest(), 0o644, 100 + i) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 31, 32, 33, 100, 1000, 4000])
def test_tree_nodes_hold_every_entry(n):
    made = trees.build(_entries(n), SHAPE)
    leaves = [codec.decode(f) for _, level, f in made if level == 0]
    assert [e for t in leaves for e in t.entries] == _entries(n)
    assert all(len(codec.decode(f).entries) >= 2 for _, level, f in made if level)
    assert all(hashlib.sha256(f).digest() == name for name, _, f in made)


def test_an_insertion_changes_few_nodes():
    base = _entries(4000)
    extra = codec.Entry(b"f001000a", codec.FILE, A, 0o644, 5)
    old = {name for name, _, _ in trees.build(base, SHAPE)}
    new = {name for name, _, _ in trees.build(sorted([*base, extra], key=lambda e: e.name), SHAPE)}
    assert len(new - old) <= 6
    fewer = {name for name, _, _ in trees.build(base[:1000] + base[1001:], SHAPE)}
    assert len(fewer & old) > 0.9 * len(old)
    wide = trees.build(_entries(10_000), trees.Shape())
    assert max(level for _, level, _ in wide) <= 2 and all(len(f) <= (128 << 10) + 2 for _, _, f in wide)


def test_blob_nodes_keep_order_and_size():
    chunks = [(hashlib.sha256(b"%d" % i).digest(), 1000 + i) for i in range(500)]
    made = trees.build_blob(chunks, SHAPE)
    assert [e for _, level, f in made if level == 0 for e in codec.decode(f).entries] == chunks
    assert sum(n for _, n in codec.decode(made[-1][2]).entries) == sum(n for _, n in chunks)
    assert trees.build_blob([], SHAPE)[-1][2] == codec.encode(codec.Blob(0, ()))


def test_boundary_is_the_same_in_sql_and_python(spark):
    keys = [f"key{i}" for i in range(300)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", naming.is_boundary("k", 3, 8).alias("b")).collect()
    assert {r.k: r.b for r in rows} == {k: trees.ends_node(k.encode(), 3, trees.Shape(period=8)) for k in keys}


def test_compression():
    text = b"the quick brown fox jumps over the lazy dog\n" * 500
    noise = random.Random(4).randbytes(200_000)
    assert len(compression.compress(text)) < len(text) / 4
    assert len(compression.compress(noise)) == len(noise) + 1 and compression.compress(b"abc")[0] == compression.RAW
    assert all(compression.decompress(compression.compress(x)) == x for x in (text, noise, b"", b"abc"))
    for bad in (b"", b"\x07abc"):
        with pytest.raises(ValueError):
            compression.decompress(bad)


def test_shards_and_bounds(spark):
    names = [hashlib.sha256(b"%d" % i).digest() for i in range(400)] + [b"\xff" * 32, b"\0" * 32]
    df = spark.createDataFrame([(n,) for n in names], "name binary").select("name", naming.shard_of("name", 5).alias("s"))
    for r in df.collect():
        low, high = naming.shard_bounds(5, r.s)
        assert low <= bytes(r.name) < high and r.s == bytes(r.name)[0] >> 3
    assert df.filter(naming.in_shard("name", 5, 31)).count() == df.filter("s = 31").count()


def test_range_headers(spark):
    cases = {"bytes=0-4": (0, 4), "bytes=5-": (5, 9), "bytes=-3": (7, 9), "bytes=-30": (0, 9), "bytes=-0": None, "bytes=0-4,6-7": None, "bytes=9-10": None, "bytes=5-4": None, "items=0-1": None, "bytes=": None, "Bytes=1-1": (1, 1)}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", naming.byte_range("h", F.lit(10).cast("long")).alias("r")).collect()
    assert {r.h: r.r and tuple(r.r) for r in rows} == cases


def test_glob_star_crosses_slashes(spark):
    import fnmatch

    names = ["a/b", "a/b/c", "ab", "a.b", "a[b", "x+y/z", "a\nb"]
    globs = ["a*", "*b", "a?b", "[a-x]*", "[!a]*", "x+*", "*", "a.b", "a/*/c"]
    df = spark.createDataFrame([(g, n) for g in globs for n in names], "g string, n string").select("g", "n", F.rlike("n", naming.fnmatch_regex("g")).alias("m"))
    assert all(r.m == fnmatch.fnmatchcase(r.n, r.g) for r in df.collect())


def test_paths(spark):
    cases = {"a//b/": (["a", "b"], True), "/": ([], True), "a/../b": (["a", "..", "b"], False), "é/" + "x" * 255: (["é", "x" * 255], True), "x" * 256: (["x" * 256], False)}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", naming.path_components("p").alias("c"), naming.valid_path("p").alias("v")).collect()
    assert {r.p: (r.c, r.v) for r in rows} == cases


def test_many_small_files_need_no_group_each(spark):
    """Nodes of many files, one of them long, equal those built file by file."""
    rows = [(f, i, hashlib.sha256(b"%d-%d" % (f, i)).digest(), 10 + i) for f in range(300) for i in range(1 + f % 7 if f else 9000)]
    chunks = spark.createDataFrame(rows, "file long, ordinal int, target binary, size long")
    made = trees.file_nodes(chunks, SHAPE)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.file, bytes(r.name), r.level, bytes(r.framed), r.is_root) for r in made.collect())
    want = []
    for f in range(300):
        nodes = trees.build_blob([(t, n) for g, _, t, n in rows if g == f], SHAPE)
        want += [(f, *node, i == len(nodes) - 1) for i, node in enumerate(nodes)]
    assert got == sorted(want)
