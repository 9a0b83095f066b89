"""Publishing a version: files become chunks, file nodes, directories, a commit, a log entry.

Directories are built from the deepest level up, one grouped step a level; an
edit reads and rebuilds only the directories on the paths that it touches.
Nothing is mutated: every step offers objects by name, and what the catalogue
holds already is not stored again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import chunking, codec
from lodestack.functions.naming import frame, name_of
from lodestack.operators import trees
from lodestack.plans.storage import Scratch

OBJECTS = "name binary, kind int, size long, framed binary"
ENTRIES = "dir string, entry string, kind int, target binary, mode int, size long"
#: Levels of directories, or of nodes below a file, beyond which a walk is refused.
DEEPEST = 1000
EMPTY_TREE, EMPTY_BLOB = codec.encode(codec.Tree(0, ())), codec.encode(codec.Blob(0, ()))


class Refused(ValueError):
    """An edit or a commit that cannot be made."""


def _name(framed: bytes) -> bytes:
    return hashlib.sha256(framed).digest()


def _objects(rows: DataFrame, kind: int) -> DataFrame:
    return rows.select("name", F.lit(kind).alias("kind"), F.octet_length("framed").cast("long").alias("size"), "framed")


def _depth(dir: Column) -> Column:
    return F.when(dir == "", F.lit(0)).otherwise(F.size(F.split(dir, "/")))


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def empty_tree(spark: SparkSession) -> DataFrame:
    """The object of a directory with nothing in it."""
    return spark.createDataFrame([(_name(EMPTY_TREE), codec.TREE, len(EMPTY_TREE), EMPTY_TREE)], OBJECTS)


def store_files(files: DataFrame, params: chunking.ChunkParams, shape: trees.Shape, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(path, target, size) of each file of ``files`` (path, content), and the
    objects that make them up (S03, K20). A null content is an empty file."""
    chunks = chunking.chunk(files.select("path", "content"), "path", "content", params).withColumn("framed", frame(1, "data"))
    chunks = scratch.table(chunks.select(F.col("path").alias("file"), "ordinal", name_of("framed").alias("target"), F.col("length").alias("size"), "framed"), "chunks")
    nodes = scratch.table(trees.file_nodes(chunks.select("file", "ordinal", "target", "size"), shape), "blobs")
    empty = files.filter(F.coalesce(F.octet_length("content"), F.lit(0)) == 0).select("path", F.lit(_name(EMPTY_BLOB)).alias("target"), F.lit(0).cast("long").alias("size"))
    sizes = chunks.groupBy("file").agg(F.sum("size").alias("size"))
    roots = nodes.filter("is_root").join(sizes, "file").select(F.col("file").alias("path"), F.col("name").alias("target"), "size").unionAll(empty)
    spark = files.sparkSession
    none = spark.createDataFrame([(_name(EMPTY_BLOB), codec.BLOB, len(EMPTY_BLOB), EMPTY_BLOB)], OBJECTS)
    made = _objects(chunks.select(F.col("target").alias("name"), "framed"), codec.CHUNK).unionAll(_objects(nodes, codec.BLOB)).unionAll(none.filter(F.lit(not empty.isEmpty())))
    return roots, made


def store_tree(entries: DataFrame, shape: trees.Shape, scratch: Scratch, explicit: DataFrame | None = None, level: int | None = None) -> tuple[bytes, DataFrame]:
    """The root name and the directory nodes of entries (dir, entry, kind,
    target, mode, size), deepest directories first (C15, R11). ``explicit``
    names directories (dir) that stay though they hold nothing."""
    spark = entries.sparkSession
    rows = scratch.table(entries.select("dir", "entry", F.col("kind").cast("int").alias("kind"), "target", F.col("mode").cast("int").alias("mode"), F.col("size").cast("long").alias("size")).withColumn("depth", _depth(F.col("dir"))), "entries")
    bare = (explicit if explicit is not None else spark.createDataFrame([], "dir string")).select("dir").distinct().withColumn("depth", _depth(F.col("dir")))
    bare = scratch.table(bare, "bare")
    most = max(rows.agg(F.max("depth")).first()[0] or 0, bare.agg(F.max("depth")).first()[0] or 0)
    if most > DEEPEST:
        raise Refused(f"a directory {most} levels deep")
    made: list[DataFrame] = []
    above = spark.createDataFrame([], ENTRIES)
    for depth in range(most, -1, -1):
        # What an edit rebuilt stands for what the directory held under that name.
        old = rows.filter(F.col("depth") == depth).drop("depth").join(above.select("dir", "entry"), ["dir", "entry"], "left_anti")
        here = old.unionByName(above)
        nodes = scratch.table(trees.nodes(here, shape), "directories")
        made.append(nodes)
        roots = nodes.filter("is_root").select("dir", F.col("name").alias("target"))
        empty = bare.filter(F.col("depth") == depth).select("dir").join(roots, "dir", "left_anti")
        roots = scratch.table(roots.unionAll(empty.select("dir", F.lit(_name(EMPTY_TREE)).alias("target"))), "roots")
        above = roots.filter("dir <> ''").select(_parent(F.col("dir")).alias("dir"), _leaf(F.col("dir")).alias("entry"), F.lit(codec.DIRECTORY).alias("kind"), "target", F.lit(0).alias("mode"), F.lit(0).cast("long").alias("size"))
    top = roots.filter("dir = ''").first()
    out = empty_tree(spark)
    for nodes in made:
        out = out.unionAll(_objects(nodes, codec.TREE))
    return bytes(top["target"]) if top else _name(EMPTY_TREE), out.dropDuplicates(["name"])


@dataclass
class Published:
    """What one publish offers. ``objects`` (name, kind, size, framed, created)
    holds each object once; only those created are new to the catalogue."""

    root: bytes
    commit: bytes
    objects: DataFrame
    log: DataFrame
    keepset: DataFrame


def commit(spark: SparkSession, root: bytes, parents: tuple[bytes, ...], author: str, message: str, change_id: bytes, timestamp_us: int, metadata: dict[str, str] | None = None) -> DataFrame:
    """The object of a commit; metadata is sorted, the author commits."""
    framed = codec.encode(codec.Commit(root, parents, change_id, author, author, timestamp_us, message, tuple(sorted((metadata or {}).items()))))
    return spark.createDataFrame([(_name(framed), codec.COMMIT, len(framed), framed)], OBJECTS)


def publish_tree(root: bytes, objects: DataFrame, catalog: DataFrame, refs: DataFrame, env: int, ref: str, author: str, message: str, change_id: bytes, timestamp_us: int, expected: int | None = None, sequence: int = 1, metadata: dict[str, str] | None = None) -> Published:
    """A commit of a tree on a ref (V15): the objects with whether the catalogue
    (name) lacks them, the log row and the keep-set rows.

    ``refs`` (env, ref, target, generation) is the state now. With ``expected``
    the ref must be at that generation, else the publish is refused; the parent
    is the commit that the ref names, and the same tree under the same head
    makes no new commit: nothing is offered then.
    """
    spark = objects.sparkSession
    head = refs.filter((F.col("env") == env) & (F.col("ref") == ref)).first()
    generation = head["generation"] if head else 0
    if expected is not None and expected != generation:
        raise Refused(f"{ref} is at generation {generation}, not {expected}")
    parents = (bytes(head["target"]),) if head else ()
    made = commit(spark, root, parents, author, message, change_id, timestamp_us, metadata)
    name = bytes(made.first()["name"])
    each = objects.unionByName(made).dropDuplicates(["name"])
    each = each.join(catalog.select("name").withColumn("_held", F.lit(True)), "name", "left").withColumn("created", F.col("_held").isNull()).drop("_held")
    log = spark.createDataFrame([(env, sequence, ref, parents[0] if parents else None, name, timestamp_us, generation + 1)], "env long, sequence long, ref string, before binary, after binary, at_us long, generation long")
    return Published(root, name, each, log, each.select(F.lit(env).cast("long").alias("env"), "name"))


def publish(files: DataFrame, catalog: DataFrame, refs: DataFrame, env: int, ref: str, author: str, message: str, change_id: bytes, timestamp_us: int, params: chunking.ChunkParams = chunking.PRODUCTION, shape: trees.Shape = trees.Shape(), **more) -> Published:
    """A directory as a version (V15, S04): ``files`` (path, kind, mode, content)
    with kind 'file', 'link' or 'directory', as ``sources.files.scan`` gives them."""
    scratch = Scratch(files.sparkSession, "publish")
    held = files.filter("kind <> 'directory'")
    roots, objects = store_files(held, params, shape, scratch)
    objects = scratch.table(objects, "objects")
    kind = F.when(F.col("kind") == "link", codec.LINK).otherwise(codec.FILE)
    entries = held.select("path", kind.alias("kind"), F.when(F.col("kind") == "link", 0).otherwise(F.col("mode")).alias("mode")).join(roots, "path")
    entries = entries.select(_parent(F.col("path")).alias("dir"), _leaf(F.col("path")).alias("entry"), "kind", "target", "mode", "size")
    root, nodes = store_tree(entries, shape, scratch, files.filter("kind = 'directory'").select(F.col("path").alias("dir")))
    offered = scratch.table(objects.unionByName(nodes).dropDuplicates(["name"]), "offered")
    return publish_tree(root, offered, catalog, refs, env, ref, author, message, change_id, timestamp_us, **more)


def _decoded(rows: DataFrame, keys: str) -> DataFrame:
    """Children of nodes (keys..., framed): level, place, entry, kind, target, mode, size."""
    names = [c for c in rows.columns if c != "framed"]
    extra = ["level", "place", "entry", "kind", "target", "mode", "size"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, framed in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                node = codec.decode(framed)
                for k, e in enumerate(node.entries):
                    at.append(i)
                    found.append((node.level, k, e.name.decode(), e.kind, e.target, e.mode, e.size) if isinstance(node, codec.Tree) else (node.level, k, None, None, e[0], None, e[1]))
            left = batch.take(pa.array(at, pa.int32())) if at else batch.slice(0, 0)
            columns = list(zip(*found)) if found else [[]] * len(extra)
            yield pa.RecordBatch.from_arrays([*left.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types))], [*names, *extra])

    return rows.select(*names, "framed").mapInArrow(run, f"{keys}, level int, place int, entry string, kind int, target binary, mode int, size long")


def _walk(objects: DataFrame, roots: DataFrame, scratch: Scratch, wanted: DataFrame | None = None) -> DataFrame:
    """Entries (ENTRIES) of the directories below ``roots`` (dir, name); with
    ``wanted`` (dir) only of those, each read node by node. A node that the
    objects lack is an error."""
    nodes = objects.select("name", "framed")
    step, out = scratch.table(roots, "walk"), []
    for _ in range(DEEPEST):
        if step.isEmpty():
            break
        found = step.join(nodes, "name", "left")
        lost = found.filter("framed is null").first()
        if lost:
            raise Refused(f"directory '{lost['dir']}' names an object that is missing")
        rows = scratch.table(_decoded(found.select("dir", "framed"), "dir string"), "read")
        leaves = rows.filter("level = 0").select("dir", "entry", "kind", "target", "mode", "size")
        out.append(leaves)
        path = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.concat_ws("/", "dir", "entry"))
        below = leaves.filter(F.col("kind") == codec.DIRECTORY).select(path.alias("dir"), F.col("target").alias("name"))
        if wanted is not None:
            below = below.join(wanted.select("dir"), "dir", "left_semi")
        step = scratch.table(rows.filter("level > 0").select("dir", F.col("target").alias("name")).unionAll(below), "walk")
    else:
        raise Refused(f"more than {DEEPEST} levels")
    whole = objects.sparkSession.createDataFrame([], ENTRIES)
    for part in out:
        whole = whole.unionByName(part)
    return whole


def checkout(objects: DataFrame, root: bytes) -> DataFrame:
    """(path, kind, mode, size, target) of every file and link below a root."""
    spark = objects.sparkSession
    entries = _walk(objects, spark.createDataFrame([("", root)], "dir string, name binary"), Scratch(spark, "checkout"))
    path = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.concat_ws("/", "dir", "entry"))
    return entries.filter(F.col("kind") != codec.DIRECTORY).select(path.alias("path"), "kind", "mode", "size", "target")


def contents(objects: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content) of files (path, target), from their chunks in order. One
    file is one row by nature; ``ranges`` reads parts of one."""
    spark = objects.sparkSession
    scratch = Scratch(spark, "contents")
    nodes = objects.select("name", "framed")
    step, chunks = scratch.table(files.select("path", F.col("target").alias("name"), F.lit("").alias("order")), "walk"), []
    for _ in range(DEEPEST):
        if step.isEmpty():
            break
        rows = scratch.table(_decoded(step.join(nodes, "name").select("path", "order", "framed"), "path string, order string"), "read")
        # Places as fixed-width text: their order is the order of the bytes.
        order = F.concat("order", F.lpad(F.hex("place"), 8, "0"))
        chunks.append(rows.filter("level = 0").select("path", order.alias("order"), F.col("target").alias("name")))
        step = scratch.table(rows.filter("level > 0").select("path", F.col("target").alias("name"), order.alias("order")), "walk")
    parts = chunks[0] if chunks else spark.createDataFrame([], "path string, order string, name binary")
    for more in chunks[1:]:
        parts = parts.unionByName(more)
    data = parts.join(nodes, "name").select("path", F.struct("order", F.hex(F.substring("framed", 3, 1 << 30)).alias("data")).alias("c"))
    whole = data.groupBy("path").agg(F.sort_array(F.collect_list("c")).alias("c"))
    joined = whole.select("path", F.unhex(F.array_join(F.transform("c", lambda x: x["data"]), "")).alias("content"))
    return files.select("path").join(joined, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"").cast("binary")))


def edit(objects: DataFrame, root: bytes, edits: DataFrame, shape: trees.Shape = trees.Shape()) -> tuple[bytes, DataFrame]:
    """The root after edits (seq, path, op, kind, target, mode, size), and the
    directory nodes to offer (R09-R11, V19).

    The last edit of a path counts. Setting makes the directories above it;
    removing what is absent is no error, and an emptied directory stays. A path
    through a file is refused, be it an old or a new one. Only directories on
    the paths are read and rebuilt, deepest first; all others keep their names.
    """
    spark = objects.sparkSession
    scratch = Scratch(spark, "edit")
    last = edits.groupBy("path").agg(F.max(F.struct("seq", "op", "kind", "target", "mode", "size")).alias("e")).select("path", "e.op", "e.kind", "e.target", "e.mode", "e.size")
    last = scratch.table(last.withColumn("dir", _parent(F.col("path"))).withColumn("entry", _leaf(F.col("path"))), "edits")
    if last.filter("path is null or path = ''").first():
        raise Refused("the root of a tree is no entry")
    parts = F.split("dir", "/")
    up = lambda rows: rows.select(F.explode(F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))).alias("dir")).distinct()
    touched = scratch.table(up(last), "touched")
    held = scratch.table(_walk(objects, spark.createDataFrame([("", root)], "dir string, name binary"), scratch, touched), "held")
    full = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.concat_ws("/", "dir", "entry"))
    in_way = held.filter(F.col("kind") != codec.DIRECTORY).select(full.alias("dir")).unionAll(last.filter("op = 'set'").select(F.col("path").alias("dir")))
    blocked = in_way.join(up(last).filter("dir <> ''"), "dir", "left_semi").first()
    if blocked:
        raise Refused(f"'{blocked['dir']}' is a file on the way")
    kept = held.join(last.select("dir", "entry"), ["dir", "entry"], "left_anti")
    rows = kept.unionByName(last.filter("op = 'set'").select("dir", "entry", F.col("kind").cast("int").alias("kind"), "target", F.col("mode").cast("int").alias("mode"), F.col("size").cast("long").alias("size")))
    # Directories that were there stay, those that only a removal names are not made.
    there = held.filter(F.col("kind") == codec.DIRECTORY).select(full.alias("dir")).join(touched, "dir", "left_semi")
    return store_tree(rows, shape, scratch, there.unionAll(spark.createDataFrame([("",)], "dir string")))
