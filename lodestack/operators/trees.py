"""Directories as path tables, and their export as content-defined tree nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import codec
from lodestack.functions.naming import path_components

DOMAIN = b"lodestack.tree.split.v1"


@dataclass(frozen=True)
class Shape:
    """Entries between boundaries on average, and the clamps of a node."""

    period: int = 448
    least: int = 64
    most: int = 2048
    node_bytes: int = 128 << 10


def ends_node(key: bytes, level: int, shape: Shape) -> bool:
    """The same boundary as functions.naming.is_boundary (C11)."""
    return int(hashlib.sha256(DOMAIN + bytes([level]) + key).hexdigest()[:15], 16) % shape.period == 0


def split(keys: list[bytes], sizes: list[int], level: int, shape: Shape) -> list[range]:
    """Runs of ordered entries that share a node.

    A node closes at its byte budget, at ``most`` entries, or at a boundary key
    once it has ``least``. Above the leaves no node has a single child: the
    last one takes a child from its neighbour if that keeps two, else joins it.
    """
    nodes: list[range] = []
    begin = used = 0
    for i, (key, size) in enumerate(zip(keys, sizes)):
        used += size
        n = i + 1 - begin
        if used >= shape.node_bytes or n >= shape.most or (n >= shape.least and ends_node(key, level, shape)):
            nodes.append(range(begin, i + 1))
            begin, used = i + 1, 0
    if begin < len(keys):
        nodes.append(range(begin, len(keys)))
    if level and len(nodes) > 1 and len(nodes[-1]) == 1:
        before, last = nodes[-2], nodes[-1]
        nodes[-2:] = [range(before.start, before.stop - 1), range(before.stop - 1, last.stop)] if len(before) > 2 else [range(before.start, last.stop)]
    return nodes


def build(entries: list[codec.Entry], shape: Shape) -> list[tuple[bytes, int, bytes]]:
    """(name, level, framed) of every node of one directory, the root last.

    Above the leaves an entry is named by the last key below it.
    """
    made: list[tuple[bytes, int, bytes]] = []
    level = 0
    while True:
        # 44 bytes an entry, and its name.
        runs = split([e.name for e in entries], [44 + len(e.name) for e in entries], level, shape) or [range(0)]
        above = []
        for run in runs:
            part = tuple(entries[i] for i in run)
            framed = codec.encode(codec.Tree(level, part))
            name = hashlib.sha256(framed).digest()
            made.append((name, level, framed))
            above.append(codec.Entry(part[-1].name if part else b"", codec.DIRECTORY, name, 0, 0))
        if len(runs) == 1:
            return made
        entries, level = above, level + 1


def build_blob(chunks: list[tuple[bytes, int]], shape: Shape) -> list[tuple[bytes, int, bytes]]:
    """The same for a file's chunks (name, size): split by the children's names (C14)."""
    made: list[tuple[bytes, int, bytes]] = []
    level = 0
    while True:
        runs = split([t for t, _ in chunks], [40] * len(chunks), level, shape) or [range(0)]
        above = []
        for run in runs:
            part = tuple(chunks[i] for i in run)
            framed = codec.encode(codec.Blob(level, part))
            name = hashlib.sha256(framed).digest()
            made.append((name, level, framed))
            above.append((name, sum(n for _, n in part)))
        if len(runs) == 1:
            return made
        chunks, level = above, level + 1


def nodes(paths: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(dir, name, level, framed, is_root) of directories whose entries are
    rows (dir, entry, kind, target, mode, size). A directory is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_k=[x.encode() for x in group["entry"]]).sort_values("_k")
        made = build([codec.Entry(k, int(kind), bytes(t), int(m), int(n)) for k, kind, t, m, n in zip(group["_k"], group["kind"], group["target"], group["mode"], group["size"])], shape)
        return pd.DataFrame({"dir": group["dir"].iloc[0], "name": [x[0] for x in made], "level": [x[1] for x in made], "framed": [x[2] for x in made], "is_root": [i == len(made) - 1 for i in range(len(made))]})

    return paths.groupBy("dir").applyInPandas(run, "dir string, name binary, level int, framed binary, is_root boolean")


def file_nodes(chunks: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(file, name, level, framed, is_root) of files whose chunks are rows (file, ordinal, target, size).

    Chunks come sorted by file and are cut into files as they pass: most files
    have few, and a group of its own for each would cost more than its nodes.
    """
    fields = [("file", chunks.schema["file"].dataType.simpleString(), None), ("name", "binary", pa.binary()), ("level", "int", pa.int32()), ("framed", "binary", pa.binary()), ("is_root", "boolean", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def nodes_of(rows: Iterator[tuple]) -> Iterator[tuple]:
            for file, group in groupby(rows, itemgetter(0)):
                made = build_blob([(t, n) for _, t, n in group], shape)
                yield from ((file, *node, i == len(made) - 1) for i, node in enumerate(made))

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        found = nodes_of(rows())
        while some := list(islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, (_, _, t) in zip(zip(*some), fields)], [f for f, _, _ in fields])

    dealt = chunks.select("file", "ordinal", "target", F.col("size").cast("long").alias("size")).repartition("file").sortWithinPartitions("file", "ordinal")
    return dealt.select("file", "target", "size").mapInArrow(run, ", ".join(f"{f} {kind}" for f, kind, _ in fields))


def resolve(paths: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked paths with ``outcome``: 'file' or 'directory', 'not a directory'
    where a file stands on the way, else 'not found' with the first component
    that is missing (R06, R07). Prefixes of a path are looked up by equality."""
    steps = asked.select("path", F.posexplode(F.transform(path_components("path"), lambda x, i: F.array_join(F.slice(path_components("path"), F.lit(1), i + 1), "/"))).alias("k", "step"))
    known = paths.select("path").withColumn("what", F.lit("file")).unionAll(directories(paths).select(F.col("dir").alias("path"), F.lit("directory"))).groupBy("path").agg(F.max("what").alias("what"))
    found = steps.join(known.withColumnRenamed("path", "step"), "step", "left")
    one = found.groupBy("path").agg(F.max_by("what", "k").alias("what"), F.max("k").alias("last"), F.min(F.when(F.col("what").isNull(), F.col("k"))).alias("gap"), F.min(F.when(F.col("what") == "file", F.col("k"))).alias("file"))
    outcome = F.when(F.col("file") < F.col("last"), "not a directory").when(F.col("gap").isNotNull(), "not found").otherwise(F.col("what"))
    return one.select("path", outcome.alias("outcome"), F.when(outcome == "not found", F.element_at(path_components("path"), F.col("gap") + 1)).alias("missing_at"))


def directories(paths: DataFrame) -> DataFrame:
    """Every directory above some path, once."""
    parts = path_components("path")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.filter(F.size(parts) > 1).select(F.explode(up).alias("dir")).distinct()


def listing(paths: DataFrame) -> DataFrame:
    """(dir, entry, kind, n_files, n_bytes) of every directory's entries: files, and subdirectories once."""
    parts = path_components("path")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("dir"), F.get(parts, n - 1).alias("entry"), F.when(n == F.size(parts), "file").otherwise("directory").alias("kind")))
    rows = paths.select(F.explode(each).alias("e"), "size").select("e.*", "size")
    return rows.groupBy("dir", "entry", "kind").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def edit(paths: DataFrame, edits: DataFrame) -> DataFrame:
    """The paths after edits (seq, path, op, target, size): the last edit of a
    path counts; setting replaces, removing what is absent is no error (R09-R11).
    Edits through a file are the caller's to refuse, by ``resolve``."""
    last = edits.groupBy("path").agg(F.max(F.struct("seq", "op", "target", "size")).alias("e")).select("path", "e.op", "e.target", "e.size")
    kept = paths.join(last.select("path"), "path", "left_anti").select("path", "target", "size")
    return kept.unionAll(last.filter("op = 'set'").select("path", "target", "size"))
