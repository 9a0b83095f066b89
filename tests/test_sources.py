"""Sources, sinks and streams."""

import gzip
import hashlib
import io
import json
import os
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestack.operators import images
from lodestack.plans.storage import Scratch
from lodestack.sources import archives, feed as source, files, git
from lodestack.streaming import feed


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "env"
    (root / "task").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".git" / "x").write_text("no")
    (root / "README.md").write_text("read me")
    (root / "empty").write_bytes(b"")
    (root / "task" / "run.sh").write_text("#!/bin/sh")
    os.chmod(root / "task" / "run.sh", 0o755)
    os.symlink("../README.md", root / "task" / "link")
    (root / "task" / "Zebra").write_text("z")
    return root


def test_scan_and_materialize(spark, folder, tmp_path):
    rows = files.scan(spark, str(folder))
    got = {r.path: (r.kind, r.mode, None if r.content is None else bytes(r.content)) for r in rows.collect()}
    assert got == {"README.md": ("file", 0o644, b"read me"), "empty": ("file", 0o644, b""), "task": ("directory", 0, None), "task/run.sh": ("file", 0o755, b"#!/bin/sh"), "task/link": ("link", 0, b"../README.md"), "task/Zebra": ("file", 0o644, b"z")}
    assert [p for p, *_ in files.entries(str(folder))] == ["README.md", "empty", "task", "task/Zebra", "task/link", "task/run.sh"]
    out = str(tmp_path / "out")
    stats = {r.kind: (r.n, r.bytes) for r in files.materialize(rows, out).collect()}
    assert stats["file"] == (4, 17) and stats["link"][0] == 1 and stats["directory"][0] == 1
    assert list(files.entries(out)) == list(files.entries(str(folder)))
    with pytest.raises(FileExistsError):
        files.materialize(rows, out)
    files.materialize(rows.filter("kind = 'file'"), out, overwrite=True)
    assert not os.path.lexists(f"{out}/task/link") and not [x for x in os.listdir(tmp_path) if x.endswith(".tmp")]
    with pytest.raises(Exception):
        files.materialize(spark.createDataFrame([("../evil", "file", 420, b"x")], "path string, kind string, mode int, content binary"), str(tmp_path / "o2"))
    assert not os.path.exists(tmp_path / "evil")


def test_git_history(spark, tmp_path):
    repo = str(tmp_path / "r")
    env = os.environ | {"GIT_AUTHOR_NAME": "A B", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d", "GIT_AUTHOR_DATE": "1700000000 +0100", "GIT_COMMITTER_DATE": "1700000001 +0000"}
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], env=env, check=True, capture_output=True)
    os.makedirs(repo)
    run("init", "-q", "-b", "main")
    for i in range(3):
        (tmp_path / "r" / f"f{i}").write_text(f"text {i}")
        run("add", "-A")
        run("commit", "-q", "-m", f"number {i}\n\nbody {i}")
    (tmp_path / "r" / "big").write_bytes(git.POINTER + b"\noid sha256:0\n")
    (tmp_path / "r" / "a").mkdir()
    (tmp_path / "r" / "a" / "x").write_text("x")
    (tmp_path / "r" / "a.b").write_text("y")
    os.symlink("f0", tmp_path / "r" / "ln")
    run("add", "-A")
    run("commit", "-q", "-m", "last")
    rows = git.commits(spark, repo).orderBy("position").collect()
    assert [r.message for r in rows] == ["number 0\n\nbody 0\n", "number 1\n\nbody 1\n", "number 2\n\nbody 2\n", "last\n"]
    assert [len(r.parents) for r in rows] == [0, 1, 1, 1] and rows[1].parents == [rows[0].sha]
    assert rows[0].author == "A B <a@b>" and rows[0].timestamp_us == 1_700_000_001_000_000 and rows[0].change_id == rows[0].sha[:32]
    two = git.commits(spark, repo, limit=2).orderBy("position").collect()
    assert [r.sha for r in two] == [r.sha for r in rows[2:]] and two[0].parents == []
    entries = git.tree_entries(spark, repo, [rows[-1].tree] * 2)
    got = [(bytes(r.path).decode(), r.kind, r.file_mode, r.unsupported) for r in entries.collect()]
    assert [x[0] for x in got] == sorted(x[0] for x in got) and ("ln", "link", 0, None) in got and ("big", "file", 420, "large-file pointer") in got
    assert [(r.reason, r["count"]) for r in git.unsupported_summary(entries).collect()] == [("large-file pointer", 1)]


def _tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_image_archives(spark, tmp_path):
    layer = b"plain layer bytes"
    config = json.dumps({"rootfs": {"diff_ids": ["sha256:" + hashlib.sha256(layer).hexdigest()]}}).encode()
    name = lambda b: "blobs/sha256/" + hashlib.sha256(b).hexdigest()
    manifest = json.dumps({"schemaVersion": 2, "config": {"digest": "sha256:" + hashlib.sha256(config).hexdigest()}, "layers": [{"digest": "sha256:" + hashlib.sha256(gzip.compress(layer, mtime=0)).hexdigest(), "size": 5, "mediaType": "application/vnd.oci.image.layer.v1.tar+gzip"}]}).encode()
    index = json.dumps({"schemaVersion": 2, "manifests": [{"digest": "sha256:" + hashlib.sha256(manifest).hexdigest(), "mediaType": images.MANIFEST_TYPES[0], "platform": {"architecture": "amd64", "os": "linux"}}]}).encode()
    oci, docker = str(tmp_path / "one.bin"), str(tmp_path / "two.bin")
    _tar(oci, {"index.json": index, name(manifest): manifest, name(config): config, name(gzip.compress(layer, mtime=0)): gzip.compress(layer, mtime=0), "manifest.json": b"[]"})
    _tar(docker, {"manifest.json": json.dumps([{"Config": "c.json", "Layers": ["l1/layer.tar", "l2.tar.gz"], "RepoTags": ["a:1"]}]).encode(), "c.json": config})
    found = archives.read_archives(spark, [oci, docker]).cache()
    assert {r.archive: r.layout for r in archives.layouts(found).collect()} == {oci: "oci", docker: "docker"}
    got = archives.docker_images(found.filter(F.col("archive") == docker)).orderBy("ordinal").collect()
    assert [(r.layer, r.gzipped, r.tags) for r in got] == [("l1/layer.tar", False, ["a:1"]), ("l2.tar.gz", True, ["a:1"])]
    docs = archives.documents(found.filter(F.col("archive") == oci))
    reached = images.resolve_nested(docs, docs.filter("digest = 'index'")).collect()
    assert {r.depth for r in reached} == {0, 1}
    assert archives.decompress(gzip.compress(layer), "gzip") == layer and archives.decompress(layer, "none") == layer


def test_stream_state_goes_on_from_batch_to_batch(spark, tmp_path):
    schema = "env long, ref string, seq long, op string, expected long, target long, tag boolean"
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "r", 1, "create", 0, 5, False), (1, "r", 2, "update", 1, 6, False)], schema).coalesce(1).write.parquet(folder)
    got = []

    def run():
        stream = feed.folded_updates(spark.readStream.schema(schema).parquet(folder))
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend((r.seq, r.verdict, r.generation) for r in b.collect())).start()
        q.awaitTermination()

    run()
    assert sorted(got) == [(1, "accepted", 1), (2, "accepted", 2)]
    spark.createDataFrame([(1, "r", 3, "update", 1, 7, False), (1, "r", 4, "update", 2, 8, False)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert sorted(got)[2:] == [(3, "conflict", 2), (4, "accepted", 3)]


def test_feed_source_streams_by_shard_and_resumes(spark, small, tmp_path):
    source.register(spark)
    events = spark.read.parquet(f"{small}/events.parquet")
    path = source.publish(events, 3)
    got = []

    def run():
        s = spark.readStream.format("lodestack_feed").schema(source.SCHEMA).option("shards", 3).load(path)
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend((r.shard, r.sequence) for r in b.collect())).start()
        q.awaitTermination()

    run()
    assert len(got) == len(set(got)) == events.count()
    more = feed.sharded(events.limit(5).withColumn("event_id", F.col("event_id") + 1_000_000), 3).select("shard", "sequence", F.col("user_id").alias("env"), "event_type", "ts", "value", "props")
    more.write.mode("append").partitionBy("shard").parquet(path)
    run()
    assert len(got) == len(set(got)) == events.count() + 5


def test_late_and_repeated_events(spark, small):
    n = feed.run_once(spark, f"{small}/events.parquet", lambda s: feed.deduplicated(s.unionByName(s))).count()
    assert n == spark.read.parquet(f"{small}/events.parquet").count()
    slides = feed.run_once(spark, f"{small}/events.parquet", lambda s: feed.sliding_counts(s, "2 days", "1 day"), mode="complete")
    assert slides.agg(F.sum("n")).first()[0] == 2 * n


def test_scratch_tables_follow_the_session(spark):
    scratch = Scratch(spark, "t")
    df = scratch.table(spark.range(5), "x")
    assert df.count() == 5
    scratch.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.base}/001-x").count()


def test_the_rest_does_not_need_the_training_data_package():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(here, "lodestack")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "lodestack.llm" not in f.read(), name
