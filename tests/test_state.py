"""Traps, folds, queues, retention and access on small hand-made inputs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.operators import access, graph, images, oplog, queue, ranges, retention, store, trees, versions


def test_diff_of_kind_and_mode_changes_and_empty_sides(spark):
    s = "path string, kind string, target string, mode int, size long"
    a = spark.createDataFrame([("same", "file", "t", 420, 1), ("mode", "file", "t", 420, 1), ("kind", "file", "t", 420, 5), ("gone", "file", "t", 420, 7)], s)
    b = spark.createDataFrame([("same", "file", "t", 420, 1), ("mode", "file", "t", 493, 1), ("kind", "link", "t", 0, 2), ("new", "file", "u", 420, None)], s)
    got = sorted((r.path, r.change, r.size_delta) for r in versions.diff(a, b).collect())
    assert got == [("gone", "removed", -7), ("kind", "added", 2), ("kind", "removed", -5), ("mode", "modified", 0), ("new", "added", 0)]
    assert versions.diff(a, a).count() == 0
    assert {r.change for r in versions.diff(a.limit(0), b).collect()} == {"added"} and {r.change for r in versions.diff(a, b.limit(0)).collect()} == {"removed"}
    assert [r.path for r in versions.diff(a, b, prefix="ki").collect()] == ["kind", "kind"]


def test_reach_on_a_shared_graph(spark):
    rng = random.Random(2)
    edges = [(i, j) for i in range(60) for j in rng.sample(range(i + 1, 61), min(3, 60 - i))]
    df = spark.createDataFrame(edges, "parent long, child long")
    roots = spark.createDataFrame([(1, 0), (2, 30), (2, 30), (3, 999)], "start long, node long")
    got = {}
    for r in graph.reach(roots, df).collect():
        got.setdefault(r.start, []).append(r.node)

    def walk(node):
        seen, todo = set(), [node]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += [b for a, b in edges if a == n]
        return sorted(seen)

    assert {k: sorted(v) for k, v in got.items()} == {1: walk(0), 2: walk(30), 3: [999]}
    with pytest.raises(RuntimeError):
        graph.reach(roots, df, bound=2)
    assert graph.reach(roots.limit(0), df).count() == 0


def test_cycles_end(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "parent long, child long")
    assert graph.reach(spark.createDataFrame([(0, 1)], "start long, node long"), df).count() == 3


def test_generation_fold_is_safe_from_aba(spark):
    u = pd.DataFrame([("create", 0, 5, False), ("create", 0, 6, False), ("update", 1, 7, False), ("update", 2, 5, False), ("update", 1, 9, False), ("delete", 3, 0, False), ("update", 4, 1, False), ("create", 0, 8, False)], columns=["op", "expected", "target", "tag"])
    state, verdicts, generations = oplog.fold_updates(None, u)
    assert verdicts == ["accepted", "conflict", "accepted", "accepted", "conflict", "accepted", "conflict", "accepted"]
    assert generations[-1] == 1 and state["target"] == 8
    _, tags, _ = oplog.fold_updates(None, pd.DataFrame([("create", 0, 5, True), ("update", 1, 6, True), ("delete", 1, 6, True)], columns=["op", "expected", "target", "tag"]))
    assert tags == ["accepted", "conflict", "conflict"]
    first, v1, _ = oplog.fold_updates(None, u.iloc[:4])
    assert v1 + oplog.fold_updates(first, u.iloc[4:])[1] == verdicts
    rows = spark.createDataFrame(u.assign(env=1, ref="r", seq=range(8)))
    assert [r.verdict for r in oplog.replay_updates(rows).orderBy("seq").collect()] == verdicts


def test_replay_and_mismatch(spark):
    rows = spark.createDataFrame([(1, 1, "k", "f", 10), (2, 1, "k", "f", 20), (3, 1, "k", "g", 30), (4, 2, "k", "g", 40)], "seq long, env long, key string, fingerprint string, outcome long")
    got = [(r.seq, r.verdict, r.outcome) for r in oplog.replay(rows).orderBy("seq").collect()]
    assert got == [(1, "executed", 10), (2, "replayed", 10), (3, "mismatch", None), (4, "executed", 40)]


def test_as_of_before_after_and_deleted(spark):
    log = spark.createDataFrame([(1, "r", 2, 10), (1, "r", 5, None), (1, "r", 7, 30)], "env long, ref string, sequence long, after long")
    asked = spark.createDataFrame([(1, "r", k) for k in (1, 2, 4, 5, 6, 7, 99)] + [(2, "r", 5)], "env long, ref string, at long")
    got = {(r.env, r["at"]): r.target for r in oplog.as_of(log, asked).collect()}
    assert got == {(1, 1): None, (1, 2): 10, (1, 4): 10, (1, 5): None, (1, 6): None, (1, 7): 30, (1, 99): 30, (2, 5): None}


def test_retention_boundaries(spark):
    cat = spark.createDataFrame([(b"a", 1, 100), (b"b", 2, 101), (b"c", 3, 0), (b"d", 4, 0)], "name binary, size long, written_at_us long")
    keep = spark.createDataFrame([("e", b"c"), ("f", b"c")], "env string, name binary")
    lease = retention.leased(spark.createDataFrame([(1, 200), (2, 201)], "session long, expires_at_us long"), spark.createDataFrame([(1, b"a"), (2, b"d")], "session long, name binary"), 200)
    policy = retention.Policy(grace_us=100, breaker_least=4, breaker_share=0.25)
    rows = retention.classify(cat, keep, lease, 200, policy)
    assert {bytes(r.name): r.state for r in rows.collect()} == {b"a": "candidate", b"b": "recent", b"c": "live", b"d": "leased"}
    plan = retention.plan(rows, policy).first()
    assert (plan.corpus, plan.candidates, plan.aborted) == (4, 1, False)  # a quarter is not more than a quarter
    assert retention.plan(rows.limit(0), policy).first().aborted is False
    marks = spark.createDataFrame([(b"a", 200)], "name binary, expires_at_us long")
    assert [r.action for r in retention.sweep(rows, marks, 200).collect()] == ["delete"]
    assert [r.action for r in retention.sweep(rows, marks, 199).collect()] == ["wait"]
    assert store.purge(marks, 200).count() == 0 and store.purge(marks, 199).count() == 1


def test_missing_counts_marked_objects(spark):
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "name binary")
    got = store.missing(n(b"a", b"a", b"b", b"c"), n(b"a", b"b"), n(b"b"))
    assert sorted(bytes(r.name) for r in got.collect()) == [b"b", b"c"]


def test_leases_and_settling(spark):
    q = spark.createDataFrame([(1, 5, "x", 50), (1, 4, "y", 60), (2, 1, "z", 10), (3, 9, "w", 5)], "env long, op_sequence long, commit string, enqueued_at long")
    held = spark.createDataFrame([(2, 100), (3, 101)], "env long, expires_at_us long")
    assert [(r.env, r.op_sequence) for r in queue.lease(q, held, 100, 10).collect()] == [(2, 1), (1, 4)]
    tries = spark.createDataFrame([(1, 1, 1, "failed"), (1, 1, 2, "succeeded"), (2, 1, 1, "failed"), (3, 1, 1, "failed"), (3, 1, 2, "failed"), (3, 1, 3, "failed")], "env long, op_sequence long, attempt long, status string")
    assert {r.env: r.state for r in queue.settle(tries).collect()} == {1: "done", 2: "pending", 3: "dropped"}


def test_failures_are_filtered_before_the_limit(spark):
    rows = spark.createDataFrame([(f"c{i:03}", "failed" if i < 5 else "succeeded", i) for i in range(100)], "commit string, status string, finished_at long")
    assert [r.commit for r in queue.failures(rows, 3).collect()] == ["c004", "c003", "c002"]


def test_manifests():
    assert queue.manifest(b"name: x\nbuild: {command: make all, timeout_seconds: 99999}\nimages: one")["command"] == ["/bin/sh", "-c", "make all"]
    got = queue.manifest("version: 2\nbuild:\n  command: [a, 1]\n  env: {B: 1, A: x}\nsync: {z: 1}\nimages: [p, q]")
    assert (got["command"], got["timeout_seconds"], got["env"], got["images"], got["version"]) == (["a", "1"], 900, {"A": "x", "B": "1"}, ["p", "q"], 2)
    assert queue.manifest(b"")["error"] is None and queue.manifest(None)["error"] is None
    for bad in ("- a", "build: 3", "build: {}", "build: {command: []}", "build: {command: a, timeout_seconds: 0}", "a: [", "version: x"):
        assert queue.manifest(bad)["error"], bad


def test_selectors(spark):
    rows = spark.createDataFrame([("id:7",), ("name:a/*",), ("labels:b=2,a=1",), ("labels:",), ("labels:k",), ("other:x",), ("plain",)], "t string").select("t", access.parse_selector("t").alias("s")).collect()
    got = {r.t: r.s and (r.s.kind, r.s.pattern, r.s.labels) for r in rows}
    assert got == {"id:7": ("id", "7", None), "name:a/*": ("name", "a/*", None), "labels:b=2,a=1": ("labels", None, {"a": "1", "b": "2"}), "labels:": ("labels", None, {}), "labels:k": ("labels", None, {"k": ""}), "other:x": None, "plain": None}
    ops = spark.createDataFrame([(["read", "build"],), (["fly"],), ([],)], "o array<string>").select(access.operations(F.col("o")).alias("m")).collect()
    assert [r.m for r in ops] == [9, None, 0]


def test_permits_join_by_equalities(spark):
    envs = spark.createDataFrame([(1, "org/a", {"t": "x"}), (2, "org/b", {}), (3, "other/a", {"t": "x"})], "env long, name string, labels map<string,string>")
    grants = spark.createDataFrame([("p", 1, None, "name:org/*"), ("p", 1, 3, "labels:"), ("q", 2, None, "labels:"), ("r", 1, None, "id:2"), ("r", 1, 1, "labels:t=x"), ("s", 1, 2, "labels:t=x"), ("t", 1, None, "labels:t=x"), ("u", 1, None, "labels:t=y,z=1")], "principal string, ops int, pin long, selector string")
    want = sorted([("p", 1), ("p", 2), ("p", 3), ("r", 2), ("r", 1), ("t", 1), ("t", 3)])
    found = access.permits(grants, envs, 1)
    assert sorted((r.principal, r.env) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_globs_match_as_fnmatch(spark):
    import fnmatch
    import random

    rng = random.Random(2)
    names = sorted({"".join(rng.choice("ab/c.") for _ in range(rng.randint(1, 16))) for _ in range(150)})
    globs = sorted({"".join(rng.choice(["a", "b", "/", "c", ".", "*", "*", "?", "[ab]", "[!a]"]) for _ in range(rng.randint(1, 9))) for _ in range(200)} | {"*", "?", names[0], "a*", "*a", "b" * 20 + "*"})
    got = access.glob_matches(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in globs], "pattern string"))
    assert sorted((r.name, r.pattern) for r in got.collect()) == sorted((n, g) for n in names for g in globs if fnmatch.fnmatchcase(n, g))
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranges_by_stretches_against_brute_force(spark):
    import random

    rng = random.Random(6)
    sizes = {f: [rng.choice([0, 1, 7, 64, 300]) for _ in range(rng.randint(1, 30))] for f in range(6)}
    c = ranges.offsets(spark.createDataFrame([(f, k, n) for f, s in sizes.items() for k, n in enumerate(s)], "file long, ordinal int, size long"))
    asked = sorted({(f, rng.randint(0, 3000), rng.choice([1, 5, 64, 1000, 1 << 62])) for f in range(7) for _ in range(20)})
    asked = list({(f, o): (f, o, n) for f, o, n in asked}.values())
    got = ranges.read(c, spark.createDataFrame(asked, "file long, offset long, length long"), stretch=64)
    want = []
    for f, o, n in asked:
        start = 0
        for k, size in enumerate(sizes.get(f, [])):
            lo, hi = max(start, o), min(start + size, o + n)
            if lo < hi:
                want.append((f, o, k, lo - start, hi - lo))
            start += size
    assert sorted((r.file, r.offset, r.ordinal, r.skip, r["take"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("plain", [0, 2])
def test_deep_graphs_are_contracted(spark, monkeypatch, plain):
    """Long histories with branches and merges, entered at many places, against a plain search."""
    import random
    from collections import deque

    rng = random.Random(plain)
    edges = {(i, i + 1) for i in range(0, 90) if i not in (30, 61)} | {(30, 200), (30, 31), (200, 201), (201, 40), (61, 300), (70, 75), (10, 85), (300, 301), (301, 302)}
    edges |= {(1000 + i, 1000 + i + rng.randint(1, 3)) for i in range(40) for _ in range(2)}
    roots = [(1, 0), (1, 50), (1, 33), (2, 61), (3, 200), (3, 60), (4, 999), (5, 1000), (5, 1007), (6, 45), (6, 20)]
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", plain)
    monkeypatch.setattr(graph, "COMPACT", 2)
    want = {}
    for start in {s for s, _ in roots}:
        todo = deque((n, 0) for s, n in roots if s == start)
        while todo:
            n, d = todo.popleft()
            if want.get((start, n), 1 << 30) <= d:
                continue
            want[start, n] = d
            todo.extend((c, d + 1) for p, c in edges if p == n)
    got = graph.reach(spark.createDataFrame(roots, "start long, node long"), spark.createDataFrame(sorted(edges), "parent long, child long")).collect()
    assert {(r.start, r.node): r.depth for r in got} == want and len(got) == len(want)


def test_a_long_history_takes_few_rounds(spark):
    chain = spark.range(0, 3000).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    got = graph.reach(spark.createDataFrame([(1, 0)], "start long, node long"), chain, bound=40)
    assert got.count() == 3001 and got.agg(F.max("depth")).first()[0] == 3000


def test_merges_of_three_sides(spark):
    side = lambda **files: spark.createDataFrame([(p, "file", t, 420, 1) for p, t in files.items()], "path string, kind string, target string, mode int, size long")
    base = side(same="0", mine="0", theirs="0", both="0", apart="0", gone="0", cut="0", fight="0")
    ours = side(same="0", mine="1", theirs="0", both="2", apart="1", gone="0", fight="1", new="1", twice="3")
    theirs = side(same="0", mine="0", theirs="1", both="2", apart="2", cut="0", twice="3", clash="x")
    ours = ours.unionByName(side(clash="y"))
    got = {r.path: r.target or r.conflict for r in versions.merge(base, ours, theirs).collect()}
    assert got == {"same": "0", "mine": "1", "theirs": "1", "both": "2", "apart": True, "fight": True, "new": "1", "twice": "3", "clash": True}


def test_ranges_clamp_and_refuse(spark):
    c = ranges.offsets(spark.createDataFrame([(1, 1, 10), (1, 2, 5), (1, 3, 7)], "file long, ordinal int, size long"))
    ask = lambda o, n: [(r.ordinal, r.skip, r.take) for r in ranges.read(c, spark.createDataFrame([(1, o, n)], "file long, offset long, length long")).orderBy("ordinal").collect()]
    assert ask(8, 4) == [(1, 8, 2), (2, 0, 2)] and ask(20, 100) == [(3, 5, 2)] and ask(22, 1) == [] and ask(-1, 5) == [] and ask(3, 0) == []


def test_pages(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    page = lambda after, n: [(r.k, r.next_cursor) for r in ranges.page(rows, "k", after, n).orderBy("k").collect()]
    assert page(None, 3) == [(0, 2), (1, 2), (2, 2)] and page(7, 2) == [(8, None), (9, None)] and page(9, 2) == []


def test_paths_resolve(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/d",)], "path string")
    asked = spark.createDataFrame([("a/b/c",), ("a",), ("a/d/x",), ("a/q/z",), ("w",)], "path string")
    got = {r.path: (r.outcome, r.missing_at) for r in trees.resolve(p, asked).collect()}
    assert got == {"a/b/c": ("file", None), "a": ("directory", None), "a/d/x": ("not a directory", None), "a/q/z": ("not found", "q"), "w": ("not found", "w")}


def test_nested_indexes_beyond_four_levels_are_refused(spark):
    doc = lambda *d: '{"manifests":[' + ",".join(f'{{"digest":"{x}"}}' for x in d) + "]}"
    docs = spark.createDataFrame([("d0", doc("d1", "e")), ("d1", doc("d2")), ("d2", doc("d3")), ("d3", doc("d4")), ("d4", "a manifest"), ("e", "not json")], "digest string, text string")
    got = {r.digest: r.depth for r in images.resolve_nested(docs, docs.filter("digest = 'd0'")).collect()}
    assert got == {"d0": 0, "d1": 1, "e": 1, "d2": 2, "d3": 3, "d4": 4}
    deeper = docs.filter("digest <> 'd4'").unionAll(spark.createDataFrame([("d4", doc("d5"))], docs.schema))
    with pytest.raises(ValueError):
        images.resolve_nested(deeper, deeper.filter("digest = 'd0'"))


def test_layers_of_unequal_lists(spark):
    rows = spark.createDataFrame([(1, '{"layers":[{"digest":"a","size":1,"mediaType":"x"}]}', '{"rootfs":{"diff_ids":["d"]}}'), (2, '{"layers":[]}', '{"rootfs":{"diff_ids":["d"]}}')], "image long, manifest string, config string")
    got = {r.image: (r.digest, r.diff_id, r.error is not None) for r in images.layers(rows).collect()}
    assert got == {1: ("a", "d", False), 2: (None, None, True)}
