"""Offsets, byte ranges and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(chunks: DataFrame, file: str = "file", order: str = "ordinal") -> DataFrame:
    """Chunks with ``start``, the bytes of the file before them."""
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


#: Bytes of a stretch of a file by which chunks and requests meet.
STRETCH = 4 << 20


def read(chunks: DataFrame, requests: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The parts of chunks (file, ordinal, size, start) that requests (file,
    offset, length) cover: (file, offset, ordinal, skip, take) (O01, O02).

    Ranges past the end are cut; a negative offset or length is refused and
    covers nothing. Chunks and requests meet by file and stretch, so a request
    only sees the chunks near it; a pair that meets in several stretches counts
    in the one where it begins to overlap.
    """
    ends = chunks.groupBy("file").agg(F.max(F.col("start") + F.col("size")).alias("_end"))
    asked = requests.filter("offset >= 0 and length > 0").select("file", "offset", "length").join(ends, "file").filter("offset < _end")
    asked = asked.withColumn("_stop", F.col("offset") + F.least(F.col("length"), F.col("_end") - F.col("offset"))).drop("length", "_end")
    at = lambda x: F.floor(x / F.lit(stretch))
    asked = asked.withColumn("_at", F.explode(F.sequence(at(F.col("offset")), at(F.col("_stop") - 1))))
    parts = chunks.select("file", "ordinal", "size", "start").filter("size > 0").withColumn("_at", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.col("size") - 1))))
    hit = parts.join(asked, ["file", "_at"]).filter("start < _stop and start + size > offset").filter(F.col("_at") == at(F.greatest("start", "offset")))
    skip = F.greatest(F.col("offset") - F.col("start"), F.lit(0))
    take = F.least(F.col("start") + F.col("size"), F.col("_stop")) - F.greatest("start", "offset")
    return hit.select("file", "offset", "ordinal", skip.alias("skip"), take.alias("take"))


def page(rows: DataFrame, key: str, after: object | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in key order, with the cursor of the page after
    it, null unless one more row exists (O04, S14)."""
    rest = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    some = rest.orderBy(key).limit(limit + 1)
    whole = Window.partitionBy(F.lit(0))  # limit + 1 rows at most
    some = some.withColumn("_k", F.row_number().over(whole.orderBy(key))).withColumn("_n", F.count("*").over(whole))
    last = F.max(F.when(F.col("_k") <= limit, F.col(key))).over(whole)
    return some.withColumn("next_cursor", F.when(F.col("_n") > limit, last)).filter(F.col("_k") <= limit).drop("_k", "_n")


def scan(items: DataFrame, pk: object, prefix: str, after: str | None = None, limit: int | None = None, descending: bool = False) -> DataFrame:
    """Items (pk, sk, ...) of a partition whose sort key begins with a prefix,
    in order from ``after``, itself excluded (S14)."""
    rows = items.filter((F.col("pk") == F.lit(pk)) & F.col("sk").startswith(prefix))
    if after is not None:
        rows = rows.filter(F.col("sk") < after if descending else F.col("sk") > after)
    rows = rows.orderBy(F.col("sk").desc() if descending else F.col("sk"))
    return rows if limit is None else rows.limit(limit)
