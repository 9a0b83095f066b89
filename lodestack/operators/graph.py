"""Reachability over content and history graphs.

A semi-naive loop: each round joins only the newest nodes with the edges, drops
what is known, and is written to the shared folder. Keys of every start are
carried along, so one loop serves all starts at once. Graphs that go deeper
than PLAIN_ROUNDS are contracted first: stretches without a branch, as histories
are made of, become one node each by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.plans.storage import Scratch

#: Levels walked one by one before the rest of the graph is contracted.
PLAIN_ROUNDS = 12
#: Levels after which what is known is written as one table.
COMPACT = 8


class _Known:
    """A growing set of rows: the tables of the last rounds and one of all before."""

    def __init__(self, first: DataFrame, scratch: Scratch, keys: list[str], value: str):
        self.scratch, self.keys, self.value = scratch, keys, value
        self.parts = [first.select(*keys, value)]

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionAll(part)
        return out

    def add(self, part: DataFrame) -> None:
        self.parts.append(part.select(*self.keys, self.value))
        if len(self.parts) > COMPACT:
            self.parts = [self.scratch.table(self.least(), "known")]

    def least(self) -> DataFrame:
        return self.rows().groupBy(*self.keys).agg(F.min(self.value).alias(self.value))


def reach(roots: DataFrame, edges: DataFrame, bound: int = 100_000) -> DataFrame:
    """(start, node, depth) of everything reachable from roots (start, node)
    along edges (parent, child); roots themselves at depth 0.

    Each node once for each start, at its smallest depth. Edges to nodes that
    are missing from the data end there. More than ``bound`` rounds raise:
    an incomplete set must never pass for a live one (R01-R03, T1).
    """
    scratch = Scratch(roots.sparkSession, "reach")
    step = scratch.table(roots.select("start", "node").distinct().withColumn("depth", F.lit(0)), "level")
    known = _Known(step, scratch, ["start", "node"], "depth")
    edges = scratch.table(edges.select("parent", "child").distinct(), "edges")
    for depth in range(1, min(bound, PLAIN_ROUNDS) + 1):
        found = step.select("start", "node").join(edges, F.col("node") == F.col("parent")).select("start", F.col("child").alias("node")).distinct()
        step = scratch.table(found.join(known.rows(), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if step.isEmpty():
            return known.rows()
        known.add(step)
    deep = _reach_contracted(step, edges, bound - PLAIN_ROUNDS, scratch)
    return known.rows().unionAll(deep).groupBy("start", "node").agg(F.min("depth").alias("depth"))


def stretches(edges: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """(node, head, offset) of nodes behind the first of an unbranched stretch:
    its first node, and the steps from there. A step belongs to a stretch if it
    is the only way out of its parent and the only way into its child."""
    out = edges.groupBy("parent").agg(F.count("*").alias("_o")).filter("_o = 1").select("parent")
    into = edges.groupBy("child").agg(F.count("*").alias("_i")).filter("_i = 1").select("child")
    single = edges.join(out, "parent", "left_semi").join(into, "child", "left_semi")
    now = scratch.table(single.select(F.col("child").alias("node"), F.col("parent").alias("head"), F.lit(1).cast("long").alias("offset")), "stretches")
    for _ in range(most_rounds):
        ahead = now.select(F.col("node").alias("_n"), F.col("head").alias("_h"), F.col("offset").alias("_k"))
        both = now.join(ahead, F.col("head") == F.col("_n"), "left")
        after = scratch.table(both.select("node", F.coalesce("_h", "head").alias("head"), (F.col("offset") + F.coalesce("_k", F.lit(0))).alias("offset"), F.col("_h").isNotNull().alias("moved")), "stretches")
        scratch.drop(now)
        done = after.filter("moved").isEmpty()
        now = after.select("node", "head", "offset")
        if done:
            return now
    raise RuntimeError("a stretch without an end: the graph has a cycle")


def _reach_contracted(roots: DataFrame, edges: DataFrame, bound: int, scratch: Scratch) -> DataFrame:
    """(start, node, depth) reachable from roots (start, node, depth): stretches
    are entered, left at their end and written out once at the end."""
    behind = stretches(edges, scratch)
    at = lambda rows, column: rows.join(behind.withColumnsRenamed({"node": "_n", "head": "_h", "offset": "_k"}), F.col(column) == F.col("_n"), "left")
    inner = edges.join(behind, F.col("child") == F.col("node"), "left_anti")
    leaves = at(inner, "parent").select(F.coalesce("_h", "parent").alias("head"), F.coalesce("_k", F.lit(0)).alias("last"), "child")
    leaves = scratch.table(leaves, "leaves")
    # How a start enters a stretch: where, and at which depth its first node would lie.
    first = at(roots, "node").select("start", F.coalesce("_h", "node").alias("head"), F.coalesce("_k", F.lit(0)).cast("long").alias("offset"), F.col("depth").cast("long").alias("depth"))
    entries = scratch.table(first.withColumn("base", F.col("depth") - F.col("offset")).drop("depth"), "entries")
    every = [entries]
    step = scratch.table(entries.groupBy("start", "head").agg(F.min("base").alias("base")), "step")
    known = _Known(step, scratch, ["start", "head"], "base")
    # A stretch entered behind its head may be entered at the head later, deeper but with more of it.
    whole = _Known(entries.filter("offset = 0").groupBy("start", "head").agg(F.min("base").alias("base")), scratch, ["start", "head"], "base")
    for _ in range(bound):
        found = step.join(leaves, "head").groupBy("start", F.col("child").alias("head")).agg(F.min(F.col("base") + F.col("last") + 1).alias("base"))
        old = whole.least().withColumnRenamed("base", "_base")
        new = scratch.table(found.join(old, ["start", "head"], "left").filter("_base is null or base < _base").drop("_base"), "new")
        if new.isEmpty():
            break
        every.append(new.select("start", "head", F.lit(0).cast("long").alias("offset"), "base"))
        whole.add(new)
        better = known.least().withColumnRenamed("base", "_base")
        step = scratch.table(new.join(better, ["start", "head"], "left").filter("_base is null or base < _base").drop("_base"), "step")
        known.add(step)
        if len(every) > COMPACT:
            every = [scratch.table(_union(every).groupBy("start", "head", "offset").agg(F.min("base").alias("base")), "entries")]
    else:
        raise RuntimeError(f"not complete after {bound} rounds")
    all_entries = _union(every).groupBy("start", "head", "offset").agg(F.min("base").alias("base"))
    members = behind.unionByName(behind.select("head").distinct().select(F.col("head").alias("node"), "head", F.lit(0).cast("long").alias("offset")))
    # Nodes on no stretch are their own.
    alone = all_entries.join(members.select("head").distinct(), "head", "left_anti").select("start", F.col("head").alias("node"), F.col("base").alias("depth"))
    marks = all_entries.select("start", "head", "offset", "base", F.lit(None).cast(members.schema["node"].dataType).alias("node"))
    asked = all_entries.select("start", "head").distinct().join(members, "head").select("start", "head", "offset", F.lit(None).cast("long").alias("base"), "node")
    upto = Window.partitionBy("start", "head").orderBy("offset").rangeBetween(Window.unboundedPreceding, 0)
    inside = marks.unionByName(asked).withColumn("best", F.min("base").over(upto)).filter("node is not null and best is not null")
    return alone.unionAll(inside.select("start", "node", F.col("best") + F.col("offset")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def first_parent_log(heads: DataFrame, parents: DataFrame, limit: int) -> DataFrame:
    """(start, node, position): the first-parent history of each head (start,
    node), newest first, ``limit`` commits at most (R05).

    ``parents`` holds (child, parent) of first parents: a chain, so a recursive
    query walks it without a distinct.
    """
    return heads.sparkSession.sql(
        f"""WITH RECURSIVE log MAX RECURSION LEVEL {limit + 1} AS (
          SELECT start, node, 0 AS position FROM {{heads}}
          UNION ALL
          SELECT log.start, p.parent, log.position + 1 FROM log JOIN {{parents}} p ON p.child = log.node
          WHERE log.position + 1 < {limit})
        SELECT start, node, position FROM log LIMIT ALL""",
        heads=heads,
        parents=parents,
    )


def reachable(requests: DataFrame, reached: DataFrame) -> DataFrame:
    """Requests (start, node) with whether the start reaches the node."""
    known = reached.select("start", "node").distinct().withColumn("_r", F.lit(True))
    return requests.join(known, ["start", "node"], "left").withColumn("reachable", F.coalesce("_r", F.lit(False))).drop("_r")


def exclusive(reached: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes and bytes that only one start reaches: what deleting it frees."""
    lone = reached.groupBy("node").agg(F.count("*").alias("n"), F.min("start").alias("start")).filter("n = 1")
    return lone.join(sizes, "node").groupBy("start").agg(F.count("*").alias("n_nodes"), F.sum("size").alias("n_bytes"))


def keepsets(refs: DataFrame, oplog: DataFrame, edges: DataFrame, horizon: int) -> DataFrame:
    """(env, name): everything that an environment's refs, or log entries not
    older than ``horizon``, reach; all environments in one loop (G05, G06).

    Roots without any edge or object contribute themselves alone.
    """
    recent = oplog.filter(F.col("at_us") >= horizon)
    roots = refs.select("env", F.col("target").alias("node")).unionAll(recent.select("env", F.col("before").alias("node"))).unionAll(recent.select("env", F.col("after").alias("node")))
    roots = roots.filter("node is not null").select(F.col("env").alias("start"), "node").distinct()
    return reach(roots, edges).select(F.col("start").alias("env"), F.col("node").alias("name"))
