"""Image archives, packed or unpacked, as tables of their files."""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.images import ARCHIVE, decompress  # noqa: F401


#: Bytes of content in one batch of rows.
BATCH_BYTES = 16 << 20


def _files(path: str) -> Iterator[tuple[str, bytes]]:
    """Files of a folder or a tar, one at a time."""
    if os.path.isdir(path):
        for folder, below, names in os.walk(path):
            below.sort()
            for name in sorted(names):
                full = os.path.join(folder, name)
                with open(full, "rb") as f:
                    yield os.path.relpath(full, path), f.read()
        return
    with tarfile.open(path) as tar:
        for member in tar:
            if member.isfile():
                yield member.name.removeprefix("./"), tar.extractfile(member).read()


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, path, content) of every file of tars or folders, a task for
    each archive (S10). A task holds a batch of BATCH_BYTES or one larger file,
    never a whole archive."""
    rows = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(max(1, len(paths)), "archive")

    def made(archive: str, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["archive", "path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                for file in _files(archive):
                    held.append(file)
                    size += len(file[1])
                    if size >= BATCH_BYTES:
                        yield made(archive, held)
                        held, size = [], 0
                if held:
                    yield made(archive, held)

    return rows.mapInArrow(run, "archive string, path string, content binary")


def layouts(files: DataFrame) -> DataFrame:
    """(archive, layout): 'oci' where an index.json lies at the top, else
    'docker' where a manifest.json does; content decides, not the name (S10)."""
    return files.groupBy("archive").agg(F.when(F.max((F.col("path") == "index.json").cast("int")) == 1, "oci").when(F.max((F.col("path") == "manifest.json").cast("int")) == 1, "docker").alias("layout"))


def documents(files: DataFrame) -> DataFrame:
    """(archive, digest, text) of an OCI layout's JSON documents, told by their
    first character that is no blank, and the index as digest 'index' (S11)."""
    text = F.decode(F.col("content"), "utf-8")
    blobs = files.filter(F.col("path").startswith("blobs/sha256/") & F.hex(F.substring("content", 1, 1024)).rlike("^(20|09|0A|0D)*7B"))
    return blobs.select("archive", F.concat(F.lit("sha256:"), F.substring_index("path", "/", -1)).alias("digest"), text.alias("text")).unionAll(files.filter("path = 'index.json'").select("archive", F.lit("index"), text))


def docker_images(files: DataFrame) -> DataFrame:
    """(archive, image, config, ordinal, layer, gzipped, tags) of a docker archive's manifest."""
    listed = files.filter("path = 'manifest.json'").select("archive", F.posexplode(F.from_json(F.decode(F.col("content"), "utf-8"), ARCHIVE)).alias("image", "m"))
    return listed.select("archive", "image", F.col("m.Config").alias("config"), F.col("m.RepoTags").alias("tags"), F.posexplode("m.Layers").alias("ordinal", "layer")).withColumn("gzipped", F.col("layer").endswith(".gz"))


def digest_of(content: Column | str) -> Column:
    """The digest that names a blob."""
    return F.concat(F.lit("sha256:"), F.sha2(F.col(content) if isinstance(content, str) else content, 256))
