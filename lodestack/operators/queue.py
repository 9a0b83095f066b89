"""Build queue and results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.plans.storage import numbered

ATTEMPTS = 3
ABANDONED_US = 2 * 3600 * 1_000_000
TIMEOUT, LONGEST = 900, 3600
#: File names of an environment manifest, the first that exists counts.
MANIFEST_NAMES = ("environment.yaml", "environment.yml")


def oldest_per_env(queue: DataFrame) -> DataFrame:
    """The first entry of each environment by operation."""
    rest = [c for c in queue.columns if c not in ("env", "op_sequence")]
    return queue.groupBy("env").agg(F.min(F.struct("op_sequence", *rest)).alias("e")).select("env", "e.*")


def lease(queue: DataFrame, leases: DataFrame, now: int, limit: int) -> DataFrame:
    """Entries to lease next: the oldest of each environment without a live
    lease, the longest waiting first; a lease that expires now is over (B02)."""
    free = queue.join(leases.filter(F.col("expires_at_us") > now).select("env"), "env", "left_anti")
    return oldest_per_env(free).orderBy("enqueued_at", "env").limit(limit)


def settle(attempts: DataFrame) -> DataFrame:
    """Attempts (env, op_sequence, attempt, status) of each entry as its state:
    done, waiting for a retry, or dropped after the last one (B03)."""
    one = attempts.groupBy("env", "op_sequence").agg(F.max(F.struct("attempt", "status")).alias("l"), F.count("*").alias("attempts"))
    state = F.when(F.col("l.status") == "succeeded", "done").when(F.col("attempts") >= ATTEMPTS, "dropped").otherwise("pending")
    return one.select("env", "op_sequence", "attempts", state.alias("state"))


def claims(requests: DataFrame) -> DataFrame:
    """Build requests (seq, commit, at_us, status, done_us) with what each gets
    (B05): the first of a commit builds; a later one finds a finished build, one
    in progress, or one abandoned for two hours, which it takes over."""
    earlier = Window.partitionBy("commit").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("_done", F.min("done_us").over(earlier)).withColumn("_last", F.max("at_us").over(earlier))
    verdict = F.when(F.col("_last").isNull(), "build").when(F.col("_done") <= F.col("at_us"), "cached").when(F.col("at_us") - F.col("_last") < ABANDONED_US, "busy").otherwise("takeover")
    return rows.select("seq", "commit", verdict.alias("verdict"))


def failures(results: DataFrame, limit: int) -> DataFrame:
    """The newest failed builds: filtered first, then limited."""
    return results.filter("status = 'failed'").orderBy(F.col("finished_at").desc(), "commit").limit(limit)


def depth(queue: DataFrame) -> DataFrame:
    """Waiting entries in all and the environments they belong to."""
    return queue.agg(F.count("*").alias("depth"), F.countDistinct("env").alias("envs"))


def dispatch(events: DataFrame, envs: DataFrame) -> DataFrame:
    """Events with ``verdict``: 'enqueued' for an update of an environment's
    default ref, else 'ignored', a missing environment included (J14, ST04).
    Works on streams: the environments are the static side."""
    rows = events.join(envs.select(F.col("env").alias("_env"), "default_ref"), F.col("env") == F.col("_env"), "left")
    fine = (F.col("event_type") == "ref.updated") & (F.col("ref") == F.col("default_ref"))
    return rows.withColumn("verdict", F.when(fine, "enqueued").otherwise("ignored")).drop("_env", "default_ref")


def enqueue(entries: DataFrame, queue: DataFrame) -> DataFrame:
    """Entries that are new: (env, op_sequence) neither queued nor repeated (B01, ST03)."""
    return entries.dropDuplicates(["env", "op_sequence"]).join(queue.select("env", "op_sequence"), ["env", "op_sequence"], "left_anti")


def trigger(log: DataFrame, queue: DataFrame) -> DataFrame:
    """A manual build of each environment at its newest operation, and whether
    that is not queued already (B08)."""
    newest = log.groupBy("env").agg(F.max("sequence").alias("op_sequence"))
    held = queue.select("env", "op_sequence").distinct().withColumn("_h", F.lit(True))
    return newest.join(held, ["env", "op_sequence"], "left").select("env", "op_sequence", F.col("_h").isNull().alias("enqueued"))


def sync(requests: DataFrame) -> DataFrame:
    """The last request of each (env, commit) with a platform id that an update
    keeps: ids follow the order in which keys first came (B10)."""
    one = requests.groupBy("env", "commit").agg(F.min("seq").alias("first"), F.max_by("payload", "seq").alias("payload"), F.count("*").alias("n"))
    key = F.concat_ws(":", F.lit("sync"), "env", "commit")
    rows = numbered(one.select(key.alias("key"), "first", "payload", (F.col("n") > 1).alias("updated")), "_k", "first", "key")
    return rows.withColumn("platform_id", F.concat(F.lit("env-"), F.col("_k"))).drop("_k")


def results(log: DataFrame) -> DataFrame:
    """Build results now, from events (seq, commit, event, status): 'record'
    writes one, the last counts; 'release' drops a claim that has not finished;
    'invalidate' drops whatever there is (B06)."""
    last = F.struct("seq", "status")
    terminal = F.col("status").isin("succeeded", "failed")
    done = log.groupBy("commit").agg(F.max(F.when((F.col("event") == "record") & terminal, last)).alias("d"), F.max(F.when((F.col("event") == "record") & ~terminal, last)).alias("c"), F.max(F.when(F.col("event") == "release", F.col("seq"))).alias("r"), F.max(F.when(F.col("event") == "invalidate", F.col("seq"))).alias("i"))
    since = lambda x, *seqs: F.when(x["seq"] > F.greatest(F.lit(-1), *[F.coalesce(s, F.lit(-1)) for s in seqs]), x)
    alive = F.greatest(since(F.col("d"), F.col("i")), since(F.col("c"), F.col("i"), F.col("r")))
    return done.withColumn("a", alive).filter("a is not null").select("commit", "a.status", "a.seq")


def turn(queue: DataFrame, leases: DataFrame, known: DataFrame, outcomes: DataFrame, now: int, limit: int) -> DataFrame:
    """One turn of ``limit`` workers over a queue (env, op_sequence, commit,
    enqueued_at, attempts): what becomes of each leased entry (B07).

    ``known`` (commit, status, at_us) are build results, ``outcomes`` (commit,
    status) what building would give. A finished result is used as it is, a
    build in progress leaves the entry queued, and of several leased entries of
    a commit one builds. A failure is recorded only with the last attempt:
    before that the claim is released, so that the retry does not find it.
    """
    leased = lease(queue, leases, now, limit)
    rows = leased.join(known.select("commit", F.col("status").alias("_s"), F.col("at_us").alias("_at")), "commit", "left").join(outcomes.select("commit", F.col("status").alias("_o")), "commit", "left")
    first = leased.groupBy("commit").agg(F.min(F.struct("env", "op_sequence")).alias("_f"))
    rows = rows.join(first, "commit")
    busy = (F.col("_s") == "running") & (now - F.col("_at") < ABANDONED_US) | (F.struct("env", "op_sequence") != F.col("_f"))
    tries = F.col("attempts") + 1
    action = F.when(F.col("_s").isin("succeeded", "failed"), "cached").when(F.coalesce(busy, F.lit(False)), "released").when(F.col("_o") == "succeeded", "built").when(tries >= ATTEMPTS, "dropped").otherwise("retried")
    recorded = F.when(action == "built", "succeeded").when(action == "dropped", "failed")
    return rows.select("env", "op_sequence", "commit", action.alias("action"), recorded.alias("recorded"), F.when(action.isin("built", "dropped", "retried"), tries).otherwise(F.col("attempts")).alias("attempts"))


def parse_manifests(files: DataFrame) -> DataFrame:
    """Manifests (key, content) parsed: name, version, command, workdir,
    timeout, env, images, sync, and ``error`` where one is not valid (B11).

    A string command runs in a shell; the timeout is cut to the longest
    allowed; images may be one string. Other file names of the same key are the
    caller's to drop, by MANIFEST_NAMES.
    """
    kind = files.schema["key"].dataType.simpleString()
    schema = f"key {kind}, name string, version int, command array<string>, workdir string, timeout_seconds int, env map<string,string>, images array<string>, sync map<string,string>, error string"

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([{"key": k, **manifest(c)} for k, c in zip(batch["key"], batch["content"])], columns=["key", "name", "version", "command", "workdir", "timeout_seconds", "env", "images", "sync", "error"])

    return files.select("key", "content").mapInPandas(run, schema)


def manifest(content: bytes | str | None) -> dict:
    """One manifest's fields; see parse_manifests."""
    import yaml

    out = {"name": "", "version": 1, "command": None, "workdir": None, "timeout_seconds": None, "env": None, "images": [], "sync": {}, "error": None}
    try:
        doc = yaml.safe_load(content or b"")
        if doc is None:
            return out
        if not isinstance(doc, dict):
            raise ValueError("not a mapping")
        out["name"], out["version"] = str(doc.get("name", "")), int(doc.get("version", 1))
        images = doc.get("images") or []
        out["images"] = [images] if isinstance(images, str) else [str(x) for x in images]
        out["sync"] = {str(k): str(v) for k, v in sorted((doc.get("sync") or {}).items())}
        if (build := doc.get("build")) is not None:
            command = build.get("command")
            if not command or not isinstance(command, (str, list)):
                raise ValueError("a build needs a command")
            timeout = int(build.get("timeout_seconds", TIMEOUT))
            if timeout <= 0:
                raise ValueError("the timeout must be positive")
            out |= {"command": ["/bin/sh", "-c", command] if isinstance(command, str) else [str(x) for x in command], "workdir": str(build.get("workdir", ".")), "timeout_seconds": min(timeout, LONGEST), "env": {str(k): str(v) for k, v in sorted((build.get("env") or {}).items())}}
    except (ValueError, AttributeError, TypeError, yaml.YAMLError) as error:
        out["error"] = str(error).split("\n")[0]
    return out
