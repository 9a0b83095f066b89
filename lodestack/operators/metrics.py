"""Gauges of a corpus, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.naming import metric_number


def snapshot(catalog: DataFrame, keepset: DataFrame, envs: DataFrame, tombstones: DataFrame, queue: DataFrame) -> DataFrame:
    """(metric, value) of the corpus: sizes, distinct kept names, sharing."""
    objects = catalog.agg(F.count("*").alias("corpus_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("corpus_bytes"))
    kept = keepset.agg(F.countDistinct("name").alias("live_objects"), F.count("*").alias("kept_references"))
    kept = kept.withColumn("references_per_object", F.when(F.col("live_objects") == 0, 0.0).otherwise(F.round(F.col("kept_references") / F.col("live_objects"), 6)))
    counts = [rows.agg(F.count("*").alias(name)) for name, rows in (("environments", envs), ("tombstones", tombstones), ("queue_depth", queue))]
    parts = [one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in one.columns])).alias("m")).select("m.*") for one in (objects, kept, *counts)]
    return reduce(DataFrame.unionAll, parts)


#: What a gauge says, and from where on it deserves a look.
DESCRIBED = {
    "corpus_objects": ("Objects that the catalogue holds.", None),
    "corpus_bytes": ("Bytes of those objects.", None),
    "live_objects": ("Different objects that some environment keeps.", None),
    "kept_references": ("Rows of all keep-sets.", None),
    "references_per_object": ("Environments that share a kept object, on average.", "below 1.1"),
    "environments": ("Environments that exist.", None),
    "tombstones": ("Swept names that must not be deduplicated against yet.", None),
    "queue_depth": ("Builds that wait.", "above 1000"),
}


def counters(increments: DataFrame) -> DataFrame:
    """(metric, value) of counters: all increments (metric, by) so far. They
    only go up; a negative increment is refused, that is left out (A14)."""
    return increments.filter("by >= 0").groupBy("metric").agg(F.sum("by").cast("double").alias("value"))


def described(rows: DataFrame, kind: str = "gauge") -> DataFrame:
    """(metric, value) with kind, help and ``investigate`` of DESCRIBED."""
    known = F.create_map(*[F.lit(x) for k, (text, when) in DESCRIBED.items() for x in (k, F.struct(F.lit(text).alias("help"), F.lit(when).cast("string").alias("investigate")))])
    about = F.element_at(known, F.col("metric"))
    return rows.select("metric", "value", F.lit(kind).alias("kind"), about["help"].alias("help"), about["investigate"].alias("investigate"))


def render(rows: DataFrame, prefix: str = "lodestack_") -> DataFrame:
    """Prometheus text of (metric, value) rows, and kind, help and investigate
    where they exist: HELP, TYPE and threshold lines before the value (A15)."""
    name = F.concat(F.lit(prefix), F.col("metric"))
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    lines = [F.concat(F.lit("# HELP "), name, F.lit(" "), has("help")), F.concat(F.lit("# TYPE "), name, F.lit(" "), F.coalesce(has("kind"), F.lit("gauge"))), F.concat(F.lit("# investigate when "), has("investigate")), F.concat(name, F.lit(" "), metric_number("value"))]
    return rows.select("metric", F.concat_ws("\n", *lines).alias("text"))
