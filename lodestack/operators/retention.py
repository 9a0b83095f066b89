"""Garbage collection and retention as set queries over the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.naming import shard_of


@dataclass(frozen=True)
class Policy:
    """grace_us: age below which nothing is collected. breaker_share: a plan
    for more than this share of the corpus stops, once it has breaker_least objects."""

    grace_us: int = 7 * 86_400_000_000
    tombstone_us: int = 2 * 86_400_000_000
    breaker_share: float = 0.05
    breaker_least: int = 1000
    shard_bits: int = 4


def leased(sessions: DataFrame, session_objects: DataFrame, now: int) -> DataFrame:
    """Names that a session open at ``now`` has written; expiry itself is closed."""
    return session_objects.join(sessions.filter(F.col("expires_at_us") > now).select("session"), "session", "left_semi").select("name").distinct()


def classify(catalog: DataFrame, keepset: DataFrame, lease: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """Catalog rows with ``state``: live, leased, recent or candidate.

    Keep-set and leases are reduced to different names before the two joins.
    """
    kept = keepset.select("name").distinct().withColumn("_live", F.lit(True))
    held = lease.select("name").distinct().withColumn("_leased", F.lit(True))
    rows = catalog.join(kept, "name", "left").join(held, "name", "left")
    state = F.when(F.col("_live"), "live").when(F.col("_leased"), "leased").when(F.col("written_at_us") > now - policy.grace_us, "recent").otherwise("candidate")
    return rows.withColumn("state", state).drop("_live", "_leased")


def plan(classified: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row: the corpus, what is live, leased, recent or to go, and whether
    the breaker stops it (G01, G02, A09). The share must exceed the limit."""
    count = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0))
    one = classified.agg(F.count("*").alias("corpus"), count("live").alias("live"), count("leased").alias("leased"), count("recent").alias("too_recent"), count("candidate").alias("candidates"), F.coalesce(F.sum(F.when(F.col("state") == "candidate", F.col("size"))), F.lit(0)).alias("bytes_reclaimable"))
    share = F.when(F.col("corpus") == 0, 0.0).otherwise(F.col("candidates") / F.col("corpus"))
    return one.withColumn("aborted", (F.col("corpus") >= policy.breaker_least) & (F.col("candidates") > 0) & (share > policy.breaker_share))


def by_shard(classified: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Live and collectable objects of each shard of the name space."""
    return classified.groupBy(shard_of("name", policy.shard_bits).alias("shard")).agg(F.sum((F.col("state") == "live").cast("long")).alias("live"), F.sum((F.col("state") == "candidate").cast("long")).alias("candidates"))


def sweep(classified: DataFrame, tombstones: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """What a run does to each candidate: 'mark' first, 'delete' once its mark
    has expired, 'wait' between (G03). A candidate keeps its older mark."""
    marks = tombstones.groupBy("name").agg(F.min("expires_at_us").alias("expires_at_us"))
    rows = classified.filter("state = 'candidate'").select("name", "size").join(marks, "name", "left")
    return rows.withColumn("action", F.when(F.col("expires_at_us").isNull(), "mark").when(F.col("expires_at_us") <= now, "delete").otherwise("wait"))


def sweep_report(actions: DataFrame) -> DataFrame:
    """Objects and bytes by action: the plan's and what went are told apart."""
    return actions.groupBy("action").agg(F.count("*").alias("n_objects"), F.sum("size").alias("n_bytes"))


def orphan_names(claims: DataFrame, envs: DataFrame) -> DataFrame:
    """Name claims (name, env) whose environment is gone or has another name."""
    rows = claims.join(envs.select(F.col("env").alias("_env"), F.col("name").alias("_name")), F.col("env") == F.col("_env"), "left")
    return rows.filter(F.col("_name").isNull() | (F.col("_name") != F.col("name"))).select("name", "env", F.when(F.col("_env").isNull(), "absent").otherwise("renamed").alias("reason"))


def expired_refs(refs: DataFrame, now: int) -> DataFrame:
    """Ephemeral refs whose expiry is at or before ``now``."""
    return refs.filter((F.col("lifecycle") == "ephemeral") & (F.col("expires_at_us") <= now))


def maintenance(refs: DataFrame, claims: DataFrame, envs: DataFrame, tombstones: DataFrame, now: int) -> DataFrame:
    """Rows that each step of a maintenance pass touches, and their total."""
    steps = [("expired_refs", expired_refs(refs, now)), ("orphan_names", orphan_names(claims, envs)), ("purged_tombstones", tombstones.filter(F.col("expires_at_us") <= now))]
    rows = None
    for name, df in steps:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        rows = one if rows is None else rows.unionAll(one)
    return rows.unionAll(rows.agg(F.sum("n").alias("n")).select(F.lit("total").alias("step"), "n"))
