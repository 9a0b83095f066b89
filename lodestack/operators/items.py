"""Keyed items: scans over partitions, transactions, renames, sessions, sortable ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.plans.storage import numbered

#: Crockford's alphabet of base 32 (fixed value).
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def kind_scan(items: DataFrame, kind: str) -> DataFrame:
    """Every item (pk, sk, kind, ...) of a kind over all partitions. Nothing is
    cut off, so no partition starves another (S15, T5)."""
    return items.filter(F.col("kind") == kind)


def global_scan(items: DataFrame, space: str, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Items (space, key, ...) of a global space whose key begins with a
    prefix, in key order; a limit is a page (S16)."""
    rows = items.filter((F.col("space") == space) & F.col("key").startswith(prefix)).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def delete_global(items: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items (space, key, ...) without some keys, and for each asked key
    whether it existed (K11)."""
    asked = keys.select("space", "key").distinct()
    held = items.select("space", "key").distinct().withColumn("_h", F.lit(True))
    return items.join(asked, ["space", "key"], "left_anti"), asked.join(held, ["space", "key"], "left").select("space", "key", F.col("_h").isNotNull().alias("existed"))


def key_audit(objects: DataFrame) -> DataFrame:
    """Stored keys (key, path) with what is wrong with each, null for nothing:
    temporary files are passed over, a key lies under its first two bytes, and
    is 64 hexadecimal digits (S20)."""
    rows = objects.filter(~F.substring_index("path", "/", -1).startswith(".tmp-"))
    place = F.concat(F.substring("key", 1, 2), F.lit("/"), F.substring("key", 3, 2), F.lit("/"), F.col("key"))
    fault = F.when(~F.col("key").rlike("^[0-9a-f]{64}$"), "malformed").when(F.col("path") != place, "misplaced")
    return rows.select("key", "path", fault.alias("fault"))


def write_objects(objects: DataFrame, folder: str) -> DataFrame:
    """Write objects (name, framed) as a table split by the first byte of the
    name and return what reads it back (K03). Spark writes beside the target
    and moves files at commit, so a reader sees all of a write or none; equal
    names are one object."""
    rows = objects.dropDuplicates(["name"]).withColumn("shard", F.lower(F.hex(F.substring("name", 1, 1))))
    rows.repartition("shard").write.mode("append").partitionBy("shard").parquet(folder)
    return objects.sparkSession.read.schema(f"{objects.select('name', 'framed').schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, shard string").parquet(folder)


def transact(items: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions (txn, pk, sk, op, body) in order of ``txn``, each with its
    verdict: 'committed', 'refused' if it touches more than one partition or a
    key twice, or 'conflict' if a condition fails (K07, K08).

    op is 'put', 'create' (the key must be absent), 'replace' (it must exist)
    or 'delete'. All writes of a transaction count or none does. A later one
    sees what earlier ones left, so a partition is folded in order; partitions
    are independent, and of ``items`` (pk, sk) only keys that are written count.
    """
    shape = writes.groupBy("txn").agg(F.countDistinct("pk").alias("_p"), F.count("*").alias("_n"), F.countDistinct("pk", "sk").alias("_k"), F.min("pk").alias("pk"))
    fine = shape.filter("_p = 1 and _n = _k").select("txn")
    held = items.select("pk", "sk").distinct().join(writes.select("pk", "sk").distinct(), ["pk", "sk"], "left_semi")
    rows = writes.join(fine, "txn", "left_semi").select("txn", "pk", "sk", "op")
    begin = held.select(F.lit(None).cast(rows.schema["txn"].dataType).alias("txn"), "pk", "sk", F.lit("held").alias("op"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("txn", "pk")}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        now = set(group.loc[group["op"] == "held", "sk"])
        out = []
        for txn, part in group[group["op"] != "held"].groupby("txn", sort=True):
            good = all((op != "create" or sk not in now) and (op != "replace" or sk in now) for sk, op in zip(part["sk"], part["op"]))
            if good:
                for sk, op in zip(part["sk"], part["op"]):
                    (now.discard if op == "delete" else now.add)(sk)
            out.append((txn, group["pk"].iloc[0], "committed" if good else "conflict"))
        return pd.DataFrame(out, columns=["txn", "pk", "verdict"])

    told = rows.unionByName(begin).groupBy("pk").applyInPandas(run, f"txn {kind['txn']}, pk {kind['pk']}, verdict string")
    return told.select("txn", "verdict").unionAll(shape.filter("_p > 1 or _n > _k").select("txn", F.lit("refused")))


def apply(items: DataFrame, writes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items (pk, sk, body) after the committed transactions: the last write of
    a key counts, and a deleted key is gone."""
    done = writes.join(verdicts.filter("verdict = 'committed'").select("txn"), "txn", "left_semi")
    last = done.groupBy("pk", "sk").agg(F.max(F.struct("txn", "op", "body")).alias("w"))
    kept = items.select("pk", "sk", "body").join(last.select("pk", "sk"), ["pk", "sk"], "left_anti")
    return kept.unionAll(last.filter("w.op <> 'delete'").select("pk", "sk", "w.body"))


def rename(envs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (seq, env, new_name) of a batch with old name and verdict (V02):
    'missing' environment, 'same' name, 'taken', or 'renamed'.

    New names are claimed before old ones are released, so a name that is given
    up in a batch is free only in the next one, and two names are not swapped.
    Of several claims of a name the first counts, as of several renames of an
    environment.
    """
    rows = requests.join(envs.select("env", F.col("name").alias("old_name")), "env", "left")
    rows = rows.join(envs.select(F.col("name").alias("new_name"), F.lit(True).alias("_held")), "new_name", "left")
    open_ = rows.filter("old_name is not null and _held is null")
    mine = open_.groupBy("env").agg(F.min("seq").alias("seq"))
    first = open_.join(mine, ["env", "seq"], "left_semi").groupBy("new_name").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_won"))
    verdict = F.when(F.col("old_name").isNull(), "missing").when(F.col("old_name") == F.col("new_name"), "same").when(F.col("_won"), "renamed").otherwise("taken")
    return rows.join(first, "seq", "left").select("seq", "env", "old_name", "new_name", verdict.alias("verdict"))


def renew_sessions(sessions: DataFrame, pages: DataFrame, asked: DataFrame, now: int, ttl: int) -> tuple[DataFrame, DataFrame]:
    """Sessions (session, expires_at_us) and their pages (session, page, ...)
    after renewals (session): one that has expired by ``now`` is not renewed,
    and the pages carry their session's expiry (V13)."""
    hit = asked.select("session").distinct().withColumn("_r", F.lit(True))
    fresh = F.when(F.col("_r") & (F.col("expires_at_us") > now), F.lit(now + ttl)).otherwise(F.col("expires_at_us"))
    out = sessions.join(hit, "session", "left").withColumn("expires_at_us", fresh).drop("_r")
    return out, pages.drop("expires_at_us").join(out.select("session", "expires_at_us"), "session")


def uploaded(pages: DataFrame) -> DataFrame:
    """(session, place, name) of every recorded object in recorded order, from
    pages (session, page, names) (V14)."""
    each = pages.select("session", "page", F.posexplode("names").alias("pos", "name"))
    return each.withColumn("place", F.struct("page", "pos")).select("session", "page", "pos", "name")


def _base32(value: Column, digits: int) -> Column:
    shifts = F.sequence(F.lit(5 * (digits - 1)), F.lit(0), F.lit(-5))
    return F.array_join(F.transform(shifts, lambda k: F.substring(F.lit(ALPHABET), (F.expr("0L") + F.call_function("shiftright", value, k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))), "")


def sortable_ids(rows: DataFrame, at_ms: str, *order: str, seed: str = "lodestack") -> DataFrame:
    """``rows`` with ``id``: 26 characters that sort by time and, where times
    are equal, by ``order`` (C30). The first ten are the milliseconds, eight are
    drawn from the seed, and the last eight number the rows, so ids of a batch
    neither clash nor fall out of order, however many share a millisecond."""
    drawn = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:5], "big")
    out = numbered(rows, "_k", at_ms, *order)
    return out.withColumn("id", F.concat(_base32(F.col(at_ms), 10), _base32(F.lit(drawn).cast("long"), 8), _base32(F.col("_k"), 8))).drop("_k")
