"""Versioned state as a log: sequences, as-of state, undo, replay and folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_sequence(arrivals: DataFrame, env: str, *order: str) -> DataFrame:
    """Gap-free numbers of each environment's operations in arrival order."""
    return arrivals.withColumn("sequence", F.row_number().over(Window.partitionBy(env).orderBy(*order)).cast("long"))


def with_before(log: DataFrame) -> DataFrame:
    """``before``: what a ref pointed to, the previous ``after`` of (env, ref)."""
    return log.withColumn("before", F.lag("after").over(Window.partitionBy("env", "ref").orderBy("sequence")))


def latest(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` operations of each environment."""
    newest = Window.partitionBy("env").orderBy(F.col("sequence").desc())
    return log.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def refs(log: DataFrame) -> DataFrame:
    """Each ref's target and generation now; deleted refs are gone."""
    last = log.groupBy("env", "ref").agg(F.max(F.struct("sequence", "after")).alias("l"), F.count("*").alias("generation"))
    return last.filter("l.after is not null").select("env", "ref", F.col("l.after").alias("target"), "generation")


def as_of(log: DataFrame, questions: DataFrame) -> DataFrame:
    """Ref targets as of a sequence: questions (env, ref, at) with ``target``
    null where the ref did not exist (V11).

    Log and questions run through one window: linear, where a range join would
    pair every question with every earlier operation.
    """
    rows = log.select("env", "ref", F.col("sequence").alias("at"), F.struct(F.col("after").alias("t")).alias("s"), F.lit(0).alias("asks"))
    rows = rows.unionAll(questions.select("env", "ref", "at", F.lit(None).cast(rows.schema["s"].dataType), F.lit(1)))
    order = Window.partitionBy("env", "ref").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("target", F.last("s", ignorenulls=True).over(order)["t"]).filter("asks = 1").select("env", "ref", "at", "target")


def undo(log: DataFrame, current: DataFrame) -> DataFrame:
    """The operation that undoes each entry: delete where it created the ref,
    create where the ref is gone since, else an update at the generation that
    the ref has now (V10)."""
    rows = log.join(current.select("env", "ref", F.col("target").alias("now"), "generation"), ["env", "ref"], "left")
    action = F.when(F.col("before").isNull(), F.when(F.col("now").isNull(), "nothing").otherwise("delete")).when(F.col("now").isNull(), "create").otherwise("update")
    return rows.select("env", "sequence", "ref", action.alias("action"), F.col("before").alias("target"), F.when(action == "update", F.col("generation")).alias("expected_generation"))


def replay(requests: DataFrame) -> DataFrame:
    """Requests (seq, env, key, fingerprint, outcome) with what each gets: the
    first of a key executes, an equal one replays its outcome, another is a
    mismatch (V09). Records never expire unless the caller filters them (T3)."""
    first = requests.groupBy("env", "key").agg(F.min(F.struct("seq", "fingerprint", "outcome")).alias("f"))
    rows = requests.join(first, ["env", "key"])
    verdict = F.when(F.col("seq") == F.col("f.seq"), "executed").when(F.col("fingerprint") == F.col("f.fingerprint"), "replayed").otherwise("mismatch")
    return rows.select("seq", "env", "key", verdict.alias("verdict"), F.when(verdict != "mismatch", F.col("f.outcome")).alias("outcome"))


def changes(log: DataFrame) -> DataFrame:
    """Commits of each change, newest first, repeats kept."""
    return log.groupBy("change").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "commit")), asc=False), lambda x: x["commit"]).alias("commits"))


def newest_notes(notes: DataFrame) -> DataFrame:
    """The last body of each (commit, namespace)."""
    return notes.groupBy("commit", "namespace").agg(F.max_by("body", "seq").alias("body"), F.max("seq").alias("seq"))


def fold_updates(state: dict | None, updates: pd.DataFrame) -> tuple[dict, list[str], list[int]]:
    """One ref's updates (op, expected, target) in order: verdicts and the
    generation after each (V04-V06, K08).

    Creating needs the ref absent; updating and deleting need the expected
    generation, so a target that comes back is no match (ABA). Tags freeze once
    created.
    """
    state = dict(state or {"generation": 0, "target": None, "alive": False})
    verdicts, generations = [], []
    for op, expected, target, tag in zip(updates["op"], updates["expected"], updates["target"], updates["tag"]):
        if op == "create":
            fine = not state["alive"]
        else:
            fine = state["alive"] and not tag and expected == state["generation"]
        if fine:
            state = {"generation": 1 if op == "create" else state["generation"] + 1, "target": None if op == "delete" else target, "alive": op != "delete"}
        verdicts.append("accepted" if fine else "conflict")
        generations.append(int(state["generation"]))
    return state, verdicts, generations


def replay_updates(updates: DataFrame) -> DataFrame:
    """Updates (env, ref, seq, op, expected, target, tag) with ``verdict`` and
    ``generation``, folded for each ref: a later verdict hangs on the earlier
    ones, which no window function expresses. One ref is one group."""
    names = ["env", "ref", "seq", "op", "expected", "target", "tag"]
    kinds = ", ".join(f"{n} {updates.schema[n].dataType.simpleString()}" for n in names)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        _, verdicts, generations = fold_updates(None, group)
        return group[names].assign(verdict=verdicts, generation=generations)

    return updates.select(*names).groupBy("env", "ref").applyInPandas(run, f"{kinds}, verdict string, generation long")


def open_sessions(sessions: DataFrame, pages: DataFrame, now: int) -> DataFrame:
    """Sessions renewable at ``now`` with their recorded names, repeats once."""
    names = pages.groupBy("session").agg(F.countDistinct("name").alias("n_names"))
    return sessions.filter(F.col("expires_at_us") > now).join(names, "session", "left").fillna(0, ["n_names"])


def fork(refs: DataFrame, env: object, new_env: object) -> DataFrame:
    """Ref rows of a fork: the same targets at generation 1; no content moves."""
    return refs.filter(F.col("env") == F.lit(env)).select(F.lit(new_env).alias("env"), "ref", "target", F.lit(1).cast("long").alias("generation"))


def outbox(log: DataFrame) -> DataFrame:
    """The events of log rows (env, sequence, ref, before, after): each mutation
    says itself what happened, so none is emitted without its row or twice (K12)."""
    kind = F.when(F.col("before").isNull(), "ref.created").when(F.col("after").isNull(), "ref.deleted").otherwise("ref.updated")
    return log.filter("before is not null or after is not null").select("env", "sequence", "ref", kind.alias("event_type"), F.concat_ws(":", "env", "sequence").alias("event_key"))


def revert(log: DataFrame, commits: DataFrame, requests: DataFrame) -> DataFrame:
    """Log rows of requests (env, ref, to) that set a ref back to an earlier
    commit (V16): numbered after the environment's last, ``before`` is what the
    ref names now. A target that is no commit (node) or not the same ref's past
    is left out; no content moves."""
    past = log.select("env", "ref", F.col("after").alias("to")).distinct()
    last = log.groupBy("env").agg(F.max("sequence").alias("_n"))
    fine = requests.join(commits.select(F.col("node").alias("to")), "to", "left_semi").join(past, ["env", "ref", "to"], "left_semi")
    rows = fine.join(refs(log).select("env", "ref", F.col("target").alias("before")), ["env", "ref"], "left").join(last, "env")
    order = Window.partitionBy("env").orderBy("ref", "to")
    return rows.select("env", (F.col("_n") + F.row_number().over(order)).alias("sequence"), "ref", "before", F.col("to").alias("after"))


def create_branches(refs_now: DataFrame, requests: DataFrame, default_ref: str, now: int) -> DataFrame:
    """Ref rows of requests (env, ref, target, ttl_days) (V18): a null target is
    that of the default ref, a time to live becomes an expiry, and a ref that
    exists or has no target is left out."""
    base = refs_now.filter(F.col("ref") == default_ref).select("env", F.col("target").alias("_t"))
    rows = requests.join(base, "env", "left").join(refs_now.select("env", "ref"), ["env", "ref"], "left_anti")
    target = F.coalesce("target", "_t")
    return rows.filter(target.isNotNull()).select("env", "ref", target.alias("target"), F.lit(1).cast("long").alias("generation"), (F.lit(now) + F.col("ttl_days") * 86_400_000_000).cast("long").alias("expires_at_us"))


def labels_now(updates: DataFrame) -> DataFrame:
    """State and labels of each environment (env, seq, state, labels): each
    update replaces the whole map, and the last one that sets a field counts (V03)."""
    pick = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))
    keyed = updates.withColumn("labels", F.array_sort(F.map_entries("labels")))
    return keyed.groupBy("env").agg(pick("state").alias("s"), pick("labels").alias("l")).select("env", "s.state", F.map_from_entries("l.labels").alias("labels"))


def change_prefix(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """Change ids asked for by prefix: ``change`` of an exact match, else of the
    only match; ``n_matches`` tells nothing from too many (J13).

    Every beginning of a change id is a key (ids have a fixed, small length),
    and only those that are asked for stay, so there is no comparison of all
    with all.
    """
    starts = F.transform(F.sequence(F.lit(1), F.length("change")), lambda n: F.substring(F.col("change"), F.lit(1), n))
    cut = changes.select("env", "change").distinct().filter(F.length("change") > 0).select("env", "change", F.explode(starts).alias("prefix")).join(asked, ["env", "prefix"], "left_semi")
    found = asked.join(cut, ["env", "prefix"], "left").groupBy("env", "prefix").agg(F.count("change").alias("n_matches"), F.max(F.when(F.col("change") == F.col("prefix"), F.col("change"))).alias("exact"), F.min("change").alias("one"))
    return found.select("env", "prefix", "n_matches", F.coalesce("exact", F.when(F.col("n_matches") == 1, F.col("one"))).alias("change"))
