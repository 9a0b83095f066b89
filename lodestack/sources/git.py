"""Git histories as tables, read through the git command."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a large-file pointer begins, and the mode of a submodule.
POINTER = b"version https://git-lfs.github.com/spec/v1"
SUBMODULE = "160000"


def _git(repository: str, *arguments: str, text: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repository, *arguments], input=text, capture_output=True, check=True).stdout


#: Objects asked of one git process, and bytes of content in one batch of rows.
BATCH, BATCH_BYTES = 1000, 16 << 20


def objects(repository: str, names: list[str]) -> Iterator[bytes]:
    """The contents of objects in order, BATCH of them from one process."""
    for i in range(0, len(names), BATCH):
        out, at = _git(repository, "cat-file", "--batch", text="\n".join(names[i : i + BATCH]).encode() + b"\n"), 0
        for name in names[i : i + BATCH]:
            end = out.index(b"\n", at)
            head = out[at:end].split()
            if len(head) != 3:
                raise ValueError(f"object {name} is missing")
            at = end + 1 + int(head[2])
            yield out[end + 1 : at]
            at += 1


def history(repository: str, ref: str = "HEAD", limit: int | None = None) -> list[str]:
    """Commits of a ref, oldest first; with a limit the newest ones."""
    newest = _git(repository, "rev-list", "--topo-order", *([f"--max-count={limit}"] if limit else []), ref)
    return newest.decode().split()[::-1]


def commits(spark: SparkSession, repository: str, ref: str = "HEAD", limit: int | None = None) -> DataFrame:
    """(position, sha, tree, parents, author, committer, timestamp_us, message,
    change_id); parents outside the window are dropped (S05, S06, R13)."""
    ids = history(repository, ref, limit)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, sha string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = list(objects(repository, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["position", "sha", "raw"])

    return parse_commits(rows.mapInArrow(run, "position int, sha string, raw binary"))


def parse_commits(raw: DataFrame) -> DataFrame:
    """Commit objects (position, sha, raw) parsed with column functions: a head,
    a blank line, the message. Continued lines begin with a blank and belong to
    no field; identities end at '>', seconds become microseconds (S06)."""
    text = F.decode(F.col("raw"), "utf-8")
    head, message = F.substring_index(text, "\n\n", 1), F.substring(text, F.length(F.substring_index(text, "\n\n", 1)) + 3, F.length(text))
    lines = F.split(head, "\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name} ")), lambda x: F.substring(x, F.lit(len(name) + 2), F.length(x)))
    who = lambda name: F.concat(F.substring_index(F.get(field(name), F.lit(0)), ">", 1), F.lit(">"))
    seconds = F.regexp_extract(F.get(field("committer"), F.lit(0)), r"> (-?\d+)", 1).cast("long")
    rows = raw.select("position", "sha", F.get(field("tree"), F.lit(0)).alias("tree"), field("parent").alias("_p"), who("author").alias("author"), who("committer").alias("committer"), (seconds * 1_000_000).alias("timestamp_us"), message.alias("message"), F.substring("sha", 1, 32).alias("change_id"))
    known = rows.select(F.col("sha").alias("_s"))
    up = rows.select("sha", F.posexplode("_p").alias("k", "_s")).join(known, "_s", "left_semi").groupBy("sha").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "_s"))), lambda x: x["_s"]).alias("parents"))
    return rows.drop("_p").join(up, "sha", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def tree_entries(spark: SparkSession, repository: str, trees: list[str], known: DataFrame | None = None) -> DataFrame:
    """(tree, path, mode, type, sha, content) of whole trees, each different tree
    once; what cannot be imported has ``unsupported`` set (S07, S08).

    Trees are listed first; then each different blob is read once, whatever
    number of trees holds it, and none that ``known`` (sha) names: its content
    is null. Rows come in the order of path bytes, which is not git's.
    """
    rows = spark.createDataFrame([(x,) for x in dict.fromkeys(trees)], "tree string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                out = []
                for line in _git(repository, "ls-tree", "-r", "-z", "--full-tree", tree).split(b"\0")[:-1]:
                    meta, _, path = line.partition(b"\t")
                    out.append((tree, path, *meta.decode().split()))
                types = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["tree", "path", "mode", "type", "sha"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([c for _, c in rows], pa.binary())], ["_sha", "content"])

        for batch in batches:
            names, rows, size = batch.column(0).to_pylist(), [], 0
            for name, content in zip(names, objects(repository, names)):
                rows.append((name, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    listed = rows.mapInArrow(run, "tree string, path binary, mode string, type string, sha string")
    wanted = listed.filter("type = 'blob'").select("sha").distinct()
    if known is not None:
        wanted = wanted.join(known.select("sha"), "sha", "left_anti")
    found = wanted.mapInArrow(contents, "_sha string, content binary")
    return classify(listed.join(found, F.col("sha") == F.col("_sha"), "left").drop("_sha")).orderBy("tree", "path")


def classify(entries: DataFrame) -> DataFrame:
    """Entries (mode, content) with kind, file mode and ``unsupported``."""
    bad = F.when(F.col("mode") == SUBMODULE, "submodule").when(F.startswith(F.col("content"), F.lit(POINTER)), "large-file pointer")
    kind = F.when(F.col("mode") == "120000", "link").otherwise("file")
    return entries.withColumn("kind", kind).withColumn("file_mode", F.when(kind == "link", 0).when(F.col("mode") == "100755", 493).otherwise(420)).withColumn("unsupported", bad)


def unsupported_summary(entries: DataFrame) -> DataFrame:
    """Entries that cannot be imported by reason, sorted."""
    return entries.filter("unsupported is not null").groupBy(F.col("unsupported").alias("reason")).count().orderBy("reason")
