"""The change feed with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.operators.oplog import fold_updates
from lodestack.plans.storage import Scratch

DELAY = "1 hour"


def ref_window():
    return Window.partitionBy("env", "ref").orderBy("sequence")


def sharded(events: DataFrame, shards: int) -> DataFrame:
    """Events with their shard and their place in it."""
    return events.withColumn("shard", F.col("user_id") % shards).withColumn("sequence", F.col("event_id"))


def cursor(events: DataFrame) -> DataFrame:
    """The last sequence of each shard: what a reader has seen (ST02)."""
    return events.groupBy("shard").agg(F.max("sequence").alias("sequence"))


def deduplicated(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event once though it is delivered at least once (ST03)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events of each type by day of event time; late ones up to ``delay`` count (ST07)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame, length: str, step: str, delay: str = DELAY) -> DataFrame:
    """Events by sliding windows of event time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def matched(left: DataFrame, right: DataFrame, key: str, within: str, delay: str = DELAY) -> DataFrame:
    """A stream-stream join of events of one key whose times differ by ``within`` at most."""
    a = left.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).alias("a")
    b = right.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).alias("b")
    near = F.expr(f"b.ts >= a.ts - interval {within} AND b.ts <= a.ts + interval {within}")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def source(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream, with the schema it has now."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if single:
        reader, path = reader.option("pathGlobFilter", path.rsplit("/", 1)[1]), path.rsplit("/", 1)[0]
    return reader.parquet(path)


def run_once(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All that a source holds through a streaming query, as a table.

    Each micro-batch overwrites its own folder, so a repeated batch leaves one
    result; a complete-mode batch is the whole result and its last one counts.
    """
    scratch = Scratch(spark, "stream")
    out, done = scratch.path("out"), scratch.path("checkpoint")
    stream = transform(source(spark, path))
    last: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        last.append(number)
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", done).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    numbers = sorted(set(last))
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/{numbers[-1]}")
    return spark.read.schema(stream.schema).parquet(*[f"{out}/{n}" for n in numbers])


def folded_updates(updates: DataFrame) -> DataFrame:
    """A stream of ref updates (env, ref, seq, op, expected, target, tag) with
    verdicts; each ref's state goes on from batch to batch (V05, ST05)."""
    state_schema = "generation long, target long, alive boolean"
    schema = "env long, ref string, seq long, verdict string, generation long"

    def run(key: tuple, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = None
        if state.exists:
            generation, target, alive = state.get
            now = {"generation": generation, "target": target, "alive": alive}
        rows = pd.concat(list(groups)).sort_values("seq")
        now, verdicts, generations = fold_updates(now, rows)
        state.update((int(now["generation"]), None if now["target"] is None else int(now["target"]), bool(now["alive"])))
        yield pd.DataFrame({"env": key[0], "ref": key[1], "seq": rows["seq"].values, "verdict": verdicts, "generation": generations})

    return updates.groupBy("env", "ref").applyInPandasWithState(run, schema, state_schema, "append", "NoTimeout")


def leases(claims: DataFrame, held_ms: int) -> DataFrame:
    """A stream of claims (env, worker) with who gets each environment: a claim
    holds for ``held_ms`` of processing time, then the next one takes over; its
    holder's claims renew it (ST05, ST06)."""
    schema = "env long, worker string, granted boolean"

    def run(key: tuple, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        # A claim may come before the timer of a lease that has run out.
        holder, until = state.get if state.exists else (None, 0)
        rows = pd.concat(list(groups))
        granted = []
        for worker in rows["worker"]:
            fine = until <= now or holder == worker
            if fine:
                holder, until = worker, now + held_ms
            granted.append(fine)
        state.update((holder, int(until)))
        state.setTimeoutDuration(max(1, int(until - now)))
        yield pd.DataFrame({"env": key[0], "worker": rows["worker"].values, "granted": granted})

    return claims.groupBy("env").applyInPandasWithState(run, schema, "worker string, until long", "append", "ProcessingTimeTimeout")


def sessions(events: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """Session windows of each user's events: one ends after ``gap`` without any (ST07)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
