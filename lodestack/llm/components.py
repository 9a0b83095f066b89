"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.plans.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), where the
    component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until
    the edges are a forest of stars. Each round only takes minima per node, is
    written to the shared folder and drops the round before, so a lost
    executor repeats one round at most. Loops and null ends are ignored; an
    empty graph gives an empty result.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = scratch.table(flat, "edges")
    for _ in range(most_rounds):
        ends = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, now["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low.withColumnRenamed("a", "u"), large["a"] == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.table(low.select("a", F.col("m").alias("b")).unionAll(rest).distinct(), "edges")
        scratch.drop(now)
        now = after
        roles = now.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select(F.col("b").alias("u"), F.lit(0), F.lit(1)))
        loose = roles.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if loose.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
