"""Content-addressed tables: deduplicating inserts, existence, keep-sets, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.naming import frame, kind_of, name_of, ratio, shard_of


def verify(objects: DataFrame) -> DataFrame:
    """Objects (name, framed) with ``fault``: null, 'corrupt' where the name is
    not the frame's digest, or 'malformed' where the header is unknown (K01, S21)."""
    bad = ~kind_of("framed").between(1, 4) | (F.hex(F.substring("framed", 2, 1)) != "01")
    return objects.withColumn("fault", F.when(F.coalesce(bad, F.lit(True)), "malformed").when(name_of("framed") != F.col("name"), "corrupt"))


def insert(offered: DataFrame, catalog: DataFrame) -> DataFrame:
    """Offered rows (seq, name, size) with ``created`` and ``stored_size``: the
    first offer of a name that the catalog lacks is stored, all others store
    nothing (K02, B01). Offers are reduced to the first of each name before
    the catalog is joined."""
    first = offered.groupBy("name").agg(F.min("seq").alias("_first"))
    new = first.join(catalog.select("name"), "name", "left_anti")
    out = offered.join(new.withColumnRenamed("name", "_name"), (F.col("name") == F.col("_name")) & (F.col("seq") == F.col("_first")), "left")
    return out.select(*offered.columns, F.col("_first").isNotNull().alias("created"), F.when(F.col("_first").isNotNull(), F.col("size")).otherwise(F.lit(0)).cast("long").alias("stored_size"))


def tally(rows: DataFrame, *by: str) -> DataFrame:
    """Offers, created objects, bytes offered and stored, and the share that
    deduplication saved: 0 where nothing was offered (A01, C25)."""
    out = rows.groupBy(*by).agg(F.count("*").alias("offered"), F.coalesce(F.sum(F.col("created").cast("long")), F.lit(0)).alias("created"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_offered"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("bytes_stored"))
    return out.withColumn("dedup_ratio", F.round(ratio((F.col("bytes_offered") - F.col("bytes_stored")).cast("double"), F.col("bytes_offered")), 6))


def record(entries: DataFrame, *keys: str, keep: str, newest: bool = False) -> DataFrame:
    """One entry of each key: the first by ``keep``, or the newest."""
    rest = F.struct(keep, *[c for c in entries.columns if c not in (*keys, keep)])
    best = entries.groupBy(*keys).agg((F.max if newest else F.min)(rest).alias("_e"))
    return best.select(*keys, "_e.*").select(*entries.columns)


def missing(offered: DataFrame, catalog: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Different offered names that are not stored, or are marked for deletion."""
    asked = offered.select("name").distinct()
    held = catalog.select("name").join(tombstones.select("name"), "name", "left_anti")
    return asked.join(held, "name", "left_anti")


def live(names: DataFrame, keepset: DataFrame) -> DataFrame:
    """Names that any environment keeps."""
    return names.join(keepset.select("name"), "name", "left_semi")


def held_by(requests: DataFrame, keepset: DataFrame) -> DataFrame:
    """Requests (env, name) that the environment itself keeps."""
    return requests.join(keepset, ["env", "name"], "left_semi")


def merge_keepset(keepset: DataFrame, added: DataFrame) -> DataFrame:
    """Rows that a merge inserts: those not kept yet, each once."""
    return added.select("env", "name").distinct().join(keepset, ["env", "name"], "left_anti")


def replace_keepset(keepset: DataFrame, env: Column | str, names: DataFrame) -> DataFrame:
    """The keep-set with one environment's names replaced."""
    return keepset.filter(F.col("env") != env).unionByName(names.select(F.lit(env).alias("env"), "name").distinct())


def confirmed_hints(lookups: DataFrame, alternates: DataFrame, catalog: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Lookups (algorithm, encoded) answered by an alternate digest whose object
    is stored and not marked for deletion (J10)."""
    newest = record(alternates, "algorithm", "encoded", keep="seq", newest=True)
    hits = lookups.join(newest, ["algorithm", "encoded"])
    return hits.join(missing(hits, catalog, tombstones), "name", "left_anti")


def purge(tombstones: DataFrame, now: int) -> DataFrame:
    """Tombstones that stay when those expired at ``now``, the instant included, go."""
    return tombstones.filter(F.col("expires_at_us") > now)


def sizes_by_env(keepset: DataFrame) -> DataFrame:
    """Kept names of each environment."""
    return keepset.groupBy("env").agg(F.count("*").alias("n_names"))


def shared(keepset: DataFrame) -> DataFrame:
    """Names that more than one environment keeps, with how many."""
    return keepset.groupBy("name").agg(F.countDistinct("env").alias("n_envs")).filter("n_envs > 1")


def distribution(objects: DataFrame, bits: int = 4) -> DataFrame:
    """Objects and bytes of each kind by the leading bits of their names."""
    return objects.groupBy(shard_of("name", bits).alias("bucket"), "kind").agg(F.count("*").alias("n_objects"), F.sum("size").alias("n_bytes"))


def total(objects: DataFrame) -> DataFrame:
    """Objects and bytes of a catalog; zeros for an empty one."""
    return objects.agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def chunks_of(rows: DataFrame) -> DataFrame:
    """Rows (content) as framed chunks (name, framed, size)."""
    framed = rows.withColumn("framed", frame(1, "content"))
    return framed.withColumn("name", name_of("framed")).withColumn("size", F.octet_length("framed").cast("long"))


def import_report(entries: DataFrame, known: DataFrame) -> DataFrame:
    """One row about an import of entries (commit, tree, blob, size): different
    commits, trees and blobs, blobs that ``known`` (blob) holds, the bytes of the
    source with every mention and those stored anew, and the share that was
    saved of the source's bytes, 0 for none (A17, C26)."""
    seen = known.select("blob").distinct().withColumn("_k", F.lit(True))
    blobs = entries.groupBy("blob").agg(F.max("size").alias("size"), F.sum("size").alias("mentioned")).join(seen, "blob", "left")
    stored = F.sum(F.when(F.col("_k").isNull(), F.col("size")).otherwise(0))
    counts = entries.agg(F.countDistinct("commit").alias("commits"), F.countDistinct("tree").alias("trees"))
    sums = blobs.agg(F.count("*").alias("blobs"), F.count("_k").alias("reused"), F.coalesce(F.sum("mentioned"), F.lit(0)).alias("source_bytes"), F.coalesce(stored, F.lit(0)).cast("long").alias("stored_bytes"))
    one = counts.crossJoin(sums)  # a row each
    return one.withColumn("dedup_ratio", F.round(ratio((F.col("source_bytes") - F.col("stored_bytes")).cast("double"), F.col("source_bytes")), 6))
