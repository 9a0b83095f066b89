"""Directories as tables, and tables back as directories."""

from __future__ import annotations

import os
import shutil
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.plans.storage import Scratch

#: Files whose content one batch of rows holds.
READ_FILES = 256
#: Names that a scan passes over (fixed values).
EXCLUDED = frozenset({".git", ".jj", "__pycache__", ".DS_Store"})
REGULAR, EXECUTABLE = 0o644, 0o755


def entries(root: str, excluded: frozenset[str] = EXCLUDED, below: str = "", deep: bool = True) -> Iterator[tuple[str, str, int, int]]:
    """(path, kind, mode, size) of what lies below a folder, each folder's
    children in the order of their encoded names (S01, S02). A file's mode
    keeps the owner's execute bit alone; sockets and devices are errors.
    ``below`` begins further down; not ``deep`` lists that folder alone."""
    todo = [below]
    while todo:
        folder = todo.pop()
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: os.fsencode(e.name))
        more = []
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.name in excluded:
                continue
            if e.is_symlink():
                yield path, "link", 0, len(os.fsencode(os.readlink(e.path)))
            elif e.is_dir():
                more.append(path)
                yield path, "directory", 0, 0
            elif e.is_file():
                yield path, "file", EXECUTABLE if e.stat().st_mode & stat.S_IXUSR else REGULAR, e.stat().st_size
            else:
                raise ValueError(f"{path} is neither file, folder nor link")
        todo += reversed(more) if deep else ()


def scan(spark: SparkSession, root: str, excluded: frozenset[str] = EXCLUDED, slices: int | None = None) -> DataFrame:
    """(path, kind, mode, size, content) of what lies below a folder, which the
    tasks must share: level by level, each folder is listed by a task, and
    content is read by the tasks too. The driver sees no list of files."""
    scratch = Scratch(spark, "scan")
    parts = slices or spark.sparkContext.defaultParallelism

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = list(entries(root, excluded, folder, deep=False))
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["path", "kind", "mode", "size"])

    step, rows = spark.createDataFrame([("",)], "path string"), None
    while rows is None or not step.isEmpty():
        level = scratch.table(step.mapInArrow(listed, "path string, kind string, mode int, size long"), "level")
        rows = level if rows is None else rows.unionAll(level)
        step = level.filter("kind = 'directory'").select("path").repartition(parts, "path")
    rows = rows.repartition(parts, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, READ_FILES):
                part = batch.slice(at, READ_FILES)
                content = []
                for path, kind in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    full = os.path.join(root, path)
                    if kind == "link":
                        content.append(os.fsencode(os.readlink(full)))
                    elif kind == "file":
                        with open(full, "rb") as f:
                            content.append(f.read())
                    else:
                        content.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], [*part.schema.names, "content"])

    return rows.mapInArrow(run, "path string, kind string, mode int, size long, content binary")


def materialize(rows: DataFrame, target: str, overwrite: bool = False) -> DataFrame:
    """Write rows (path, kind, mode, content) as a folder and return counts.

    Everything is written beside the target and renamed at the end, so that
    no reader sees half of it; an existing target is refused unless it may be
    replaced. Tasks and driver must share the folder.
    """
    if os.path.lexists(target) and not overwrite:
        raise FileExistsError(target)
    staging = f"{target}.{uuid.uuid4().hex}.tmp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, mode, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                full = os.path.normpath(os.path.join(staging, path))
                if not full.startswith(f"{staging}/"):
                    raise ValueError(f"{path} leaves the folder")
                os.makedirs(full if kind == "directory" else os.path.dirname(full), exist_ok=True)
                if kind == "link":
                    if os.path.lexists(full):
                        os.unlink(full)
                    os.symlink(os.fsdecode(content), full)
                elif kind == "file":
                    part = f"{full}.{uuid.uuid4().hex}.part"
                    with open(part, "wb") as f:
                        f.write(content or b"")
                    os.chmod(part, mode)
                    os.replace(part, full)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(c or b"") for c in batch.column(3).to_pylist()], pa.int64())], ["kind", "size"])

    os.makedirs(staging)
    try:
        done = rows.select("path", "kind", "mode", "content").mapInArrow(run, "kind string, size long").groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
        if os.path.lexists(target):
            shutil.rmtree(target)
        os.rename(staging, target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return rows.sparkSession.createDataFrame(done, "kind string, n long, bytes long")
