"""Publishing, reading back and editing versions, and what they cost in objects."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import chunking, codec
from lodestack.operators import publish, trees
from lodestack.plans.storage import Scratch

PARAMS, SHAPE = chunking.ChunkParams.for_average(4096), trees.Shape(8, 2, 32, 4096)
FILES = "path string, kind string, mode int, content binary"
CATALOG, REFS = "name binary", "env long, ref string, target binary, generation long"


def make(spark, files, catalog=None, refs=None, **more):
    none = spark.createDataFrame([], CATALOG), spark.createDataFrame([], REFS)
    return publish.publish(spark.createDataFrame(files, FILES), none[0] if catalog is None else catalog, none[1] if refs is None else refs, 7, "main", "w", "message", bytes(16), 5, PARAMS, SHAPE, **more)


def environment(wide=0):
    files = [("harbor.yaml", "file", 420, b"name: x"), ("README.md", "file", 420, b"# read me"), ("task/prompt.md", "file", 420, b"do it"), ("task/verifier.py", "file", 493, b"print(1)"), ("task/link", "link", 0, b"../data"), ("data/train.bin", "file", 420, random.Random(42).randbytes(60_000)), ("empty.txt", "file", 420, b""), ("none", "directory", 0, None), ("a/b/c/none", "directory", 0, None)]
    return files + [(f"wide/f{i:06}.txt", "file", 420, f"file {i}".encode()) for i in range(wide)]


def held(done):
    return {bytes(r.name) for r in done.objects.select("name").collect()}


def read(spark, objects, root):
    return {r.path: (r.kind, r.mode, r.size) for r in publish.checkout(objects, root).collect()}


def test_what_is_published_is_read_back(spark):
    files = environment(wide=300)
    done = make(spark, files)
    objects = Scratch(spark, "t").table(done.objects, "objects")
    found = publish.checkout(objects, done.root)
    data = {r.path: bytes(r.content) for r in publish.contents(objects, found).collect()}
    assert data == {p: c for p, k, _, c in files if k != "directory"}
    assert {p: (k, m, n) for p, (k, m, n) in read(spark, objects, done.root).items()} == {p: (codec.LINK if k == "link" else codec.FILE, 0 if k == "link" else m, len(c)) for p, k, m, c in files if k != "directory"}
    assert objects.filter("sha2(framed, 256) <> lower(hex(name))").count() == 0 and all(codec.is_canonical(bytes(r.framed)) for r in objects.collect())
    log = done.log.first()
    assert (log.env, log.ref, log.before, bytes(log.after), log.generation) == (7, "main", None, done.commit, 1)
    assert {bytes(r["name"]) for r in done.keepset.collect()} == held(done)
    assert not read(spark, objects, publish._name(publish.EMPTY_TREE))


def test_costs_in_objects(spark):
    """Publishing again stores nothing, a new commit stores itself, a small change its path."""
    files = environment()
    one = make(spark, files)
    objects = Scratch(spark, "t").table(one.objects, "objects")
    catalog = objects.select("name")
    again = make(spark, files, catalog)
    assert again.commit == one.commit and again.objects.filter("created").count() == 0
    refs = spark.createDataFrame([(7, "main", one.commit, 1)], REFS)
    recommitted = make(spark, files, catalog, refs, expected=1)
    assert recommitted.objects.filter("created").select("kind").collect() == [(codec.COMMIT,)]
    assert codec.decode(bytes(recommitted.objects.filter("created").first().framed)).parents == (one.commit,)
    changed = [(p, k, m, b"do it better" if p == "task/prompt.md" else c) for p, k, m, c in files]
    small = make(spark, changed, catalog, refs)
    assert small.objects.filter("created").count() <= 6  # a chunk, a file, two directories, a commit
    appended = [(p, k, m, c + b"x" if p == "data/train.bin" else c) for p, k, m, c in files]
    assert make(spark, appended, catalog, refs).objects.filter("created").count() <= 7
    with pytest.raises(publish.Refused):
        make(spark, files, catalog, refs, expected=0)


def test_edits_as_by_hand(spark):
    files = environment(wide=100)
    done = make(spark, files)
    objects = Scratch(spark, "t").table(done.objects.drop("created"), "objects")
    before = read(spark, objects, done.root)
    blob = {r.path: r.target for r in publish.checkout(objects, done.root).collect()}
    edits = lambda rows: spark.createDataFrame([(s, p, op, codec.FILE, bytes(blob["README.md"]), 420, 9) for s, p, op in rows], "seq int, path string, op string, kind int, target binary, mode int, size long")
    entry = (codec.FILE, 420, 9)

    def after(rows):
        root, nodes = publish.edit(objects, done.root, edits(rows), SHAPE)
        whole = Scratch(spark, "t").table(objects.unionByName(nodes).dropDuplicates(["name"]), "objects")
        new = nodes.join(objects, "name", "left_anti").count()
        return root, read(spark, whole, root), new

    root, got, new = after([(1, "x/y/z", "set"), (1, "wide/f000050.txt", "set"), (2, "task/link", "remove")])
    assert got == {k: v for k, v in before.items() if k != "task/link"} | {"x/y/z": entry, "wide/f000050.txt": entry}
    assert after([(1, "nowhere/at/all", "remove"), (1, "absent", "remove")])[0] == done.root
    assert after([(1, "README.md", "set")])[0] == done.root  # it is that already
    assert after([(1, "README.md", "remove"), (2, "README.md", "set")])[0] == done.root
    root, got, new = after([(1, "task/prompt.md", "remove"), (1, "task/verifier.py", "remove"), (1, "task/link", "remove")])
    assert got == {k: v for k, v in before.items() if not k.startswith("task/")} and new <= 3
    # The emptied directory stays: removing it as an entry gives another root.
    assert after([(1, "task", "remove")])[0] != root and after([(1, "task", "remove")])[1] == got
    for bad in ("README.md/x", "task/link/x"):
        with pytest.raises(publish.Refused):
            after([(1, bad, "set")])
        with pytest.raises(publish.Refused):
            after([(1, bad, "remove")])
    with pytest.raises(publish.Refused):
        after([(1, "p", "set"), (2, "p/q", "set")])
    with pytest.raises(publish.Refused):
        publish.edit(objects, done.root, edits([(1, "", "set")]), SHAPE)


def test_edits_equal_a_fresh_publish(spark):
    """The root after edits is the root of the edited files published anew."""
    files = environment(wide=40)
    done = make(spark, files)
    objects = Scratch(spark, "t").table(done.objects.drop("created"), "objects")
    target = publish.checkout(objects, done.root).filter("path = 'harbor.yaml'").first().target
    changed = [f for f in files if f[0] not in ("wide/f000003.txt", "task/prompt.md")] + [("wide/new", "file", 420, b"name: x"), ("deep/er/new", "file", 420, b"name: x")]
    edits = [(1, "wide/f000003.txt", "remove"), (1, "task/prompt.md", "remove"), (1, "wide/new", "set"), (1, "deep/er/new", "set")]
    rows = spark.createDataFrame([(s, p, op, codec.FILE, bytes(target), 420, 7) for s, p, op in edits], "seq int, path string, op string, kind int, target binary, mode int, size long")
    assert publish.edit(objects, done.root, rows, SHAPE)[0] == make(spark, changed).root


def test_a_missing_object_is_no_empty_directory(spark):
    done = make(spark, environment())
    broken = done.objects.filter(F.col("name") != F.lit(done.root))
    with pytest.raises(publish.Refused):
        publish.checkout(broken, done.root)


def test_nothing_published(spark):
    done = make(spark, [])
    assert done.root == publish._name(publish.EMPTY_TREE) and done.objects.count() == 2
