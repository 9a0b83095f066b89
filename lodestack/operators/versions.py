"""Differences between two versions, as one full outer join over flattened paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, prefix: str | None = None) -> DataFrame:
    """Changes (change, path, kind, old_target, new_target, old_size, new_size,
    size_delta) between two path tables (path, kind, target, mode, size).

    Leaves only. Equal kind, target and mode is no change; another kind is a
    removal and an addition; another mode alone is a modification (J01-J04). A
    missing side has size 0 in the delta (C24). Either table may be empty. A
    prefix reaches both scans before the join.
    """
    if prefix is not None:
        before, after = (x.filter(F.col("path").startswith(prefix)) for x in (before, after))
    a = before.select("path", *[F.col(c).alias(f"a_{c}") for c in ("kind", "target", "mode", "size")])
    b = after.select("path", *[F.col(c).alias(f"b_{c}") for c in ("kind", "target", "mode", "size")])
    both = a.join(b, "path", "full_outer")
    same = F.col("a_kind").eqNullSafe(F.col("b_kind")) & F.col("a_target").eqNullSafe(F.col("b_target")) & F.col("a_mode").eqNullSafe(F.col("b_mode"))
    both = both.filter(~same)
    lone = F.lit(None).cast("string")
    gone = F.struct(F.lit("removed").alias("change"), F.col("a_kind").alias("kind"), F.col("a_target").alias("old_target"), lone.alias("new_target"), F.col("a_size").alias("old_size"), F.lit(None).cast("long").alias("new_size"))
    new = F.struct(F.lit("added").alias("change"), F.col("b_kind").alias("kind"), lone.alias("old_target"), F.col("b_target").alias("new_target"), F.lit(None).cast("long").alias("old_size"), F.col("b_size").alias("new_size"))
    changed = F.struct(F.lit("modified").alias("change"), F.col("b_kind").alias("kind"), F.col("a_target").alias("old_target"), F.col("b_target").alias("new_target"), F.col("a_size").alias("old_size"), F.col("b_size").alias("new_size"))
    rows = F.when(F.col("a_kind").isNull(), F.array(new)).when(F.col("b_kind").isNull(), F.array(gone)).when(F.col("a_kind") != F.col("b_kind"), F.array(gone, new)).otherwise(F.array(changed))
    out = both.select("path", F.explode(rows).alias("c")).select("c.change", "path", "c.kind", "c.old_target", "c.new_target", "c.old_size", "c.new_size")
    return out.withColumn("size_delta", F.coalesce("new_size", F.lit(0)) - F.coalesce("old_size", F.lit(0)))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, conflict, kind, target, mode, size) of the merged version, and of
    paths that both sides changed in different ways, whose other columns are
    null. What one side alone changed or removed counts; a path that both
    removed, or one removed while the other left it alone, is gone."""
    side = lambda rows, n: rows.select("path", F.struct("kind", "target", "mode").alias(f"{n}_what"), F.col("size").alias(f"{n}_size"))
    both = side(base, "o").join(side(ours, "a"), "path", "full_outer").join(side(theirs, "b"), "path", "full_outer")
    old, a, b = F.col("o_what"), F.col("a_what"), F.col("b_what")
    conflict = ~a.eqNullSafe(b) & ~a.eqNullSafe(old) & ~b.eqNullSafe(old)
    both = both.withColumns({"conflict": conflict, "what": F.when(~conflict, F.when(a.eqNullSafe(old), b).otherwise(a)), "size": F.when(~conflict, F.when(a.eqNullSafe(old), F.col("b_size")).otherwise(F.col("a_size")))})
    return both.filter(F.col("conflict") | F.col("what").isNotNull()).select("path", "conflict", "what.kind", "what.target", "what.mode", "size")


def summary(changes: DataFrame, *by: str) -> DataFrame:
    """Changes and bytes by kind of change and the given columns."""
    return changes.groupBy(*by, "change").agg(F.count("*").alias("n_changes"), F.sum("size_delta").alias("bytes_delta"))


def first_page(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows in order, each with whether more follow.

    One row more than asked is fetched: a top-k, not a sort of everything.
    """
    page = rows.orderBy(*order).limit(limit + 1)
    page = page.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) > limit)  # limit + 1 rows at most
    return page.orderBy(*order).limit(limit)
