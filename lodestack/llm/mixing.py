"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that brings its characters to its
target share. A document's number of copies is a Poisson variate of that mean,
inverted from a hash of its id, so every rerun draws the same copies. Copies
are then shuffled over the whole result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.rows import ROW, packed, unpacked
from lodestack.plans.storage import Scratch

SEED = "lodestack-mix"
#: Characters of a source to this power are its weight, unless weights are given.
TEMPERATURE = 0.5
_BITS = 60


def _draw(*parts: Column) -> Column:
    """60 bits of the MD5 of a key as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def source_name() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(src, chars) of each source; null sources are the source ''."""
    return docs.groupBy(source_name().alias("src")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))


def repetition_rates(sizes: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(src, rate, cdf): the mean number of copies of each source's documents,
    and the Poisson distribution function at 0, 1, ... as far as it matters.

    ``weights`` are relative targets by source; a source without one gets none
    of the mix. By default weights are the sizes to the power ``temperature``.
    ``budget`` is the characters aimed at in all, by default as many as there
    are. A source without characters but with a weight has a mean of one copy.
    """
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("chars").cast("double"), F.lit(temperature)))
    else:
        given = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], T.StructType([T.StructField("src", T.StringType()), T.StructField("w", T.DoubleType())]))
        weighed = sizes.join(given, "src", "left").fillna(0.0, ["w"])
    weight, chars = weighed.agg(F.sum("w"), F.sum("chars")).first()  # two numbers
    aim = F.lit(float(budget if budget is not None else chars or 0))
    rates = weighed.withColumn("rate", F.when((F.col("chars") == 0) & (F.col("w") > 0 if weights is not None else F.lit(True)), 1.0).when(F.col("chars") == 0, 0.0).otherwise(F.col("w") / F.lit(weight) * aim / F.col("chars") if weight else 0.0))
    # By logarithms, so that a large rate does not underflow; beyond 12 deviations nothing is left.
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    steps = rates.select("src", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k")).withColumn("l", F.when(F.col("k") == 0, -F.col("rate")).when(F.col("rate") > 0, F.ln(F.col("rate") / F.col("k"))))
    upto = Window.partitionBy("src").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.filter("rate > 0").withColumn("c", F.exp(F.sum("l").over(upto))).withColumn("c", F.sum("c").over(upto))
    cdf = sums.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("s")).select("src", F.col("s.c").alias("cdf"))
    return rates.join(cdf, "src", "left").select("src", "rate", F.coalesce("cdf", F.array(F.lit(1.0))).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, seed: str = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The mixture: every document as often as drawn, in the columns of
    ``docs`` plus ``copy`` (1, 2, ...) and ``shuffle_key``, which replace
    columns of those names.

    Rows lie in random partitions, ordered by ``shuffle_key`` in each. Rows of
    one doc_id are drawn alike; rows without one by their text, so they share no
    partition. An empty table gives an empty result; null texts have no
    characters; a rate of 1 is a mean, so that some documents go and others come
    twice.
    """
    sizes = source_sizes(docs)
    # Written first: Spark then knows the size and broadcasts the rates only if they are few.
    rates = Scratch(docs.sparkSession, "mixing").table(repetition_rates(sizes, weights, budget, temperature), "rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("")))))
    u = _draw(F.lit(seed), F.col("_name")) / F.lit(float(1 << _BITS))
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    out = packed(docs, source_name().alias("_src"), name.alias("_name"), without=("copy", "shuffle_key")).join(rates.withColumnRenamed("src", "_src"), "_src")
    out = out.withColumn("_u", u).withColumn("_n", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))))
    out = out.filter("_n > 0").select(ROW, "_name", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    key = _draw(F.lit(seed), F.lit("order"), F.col("_name"), F.col("copy").cast("string"))
    return unpacked(out, names, copy=F.col("copy"), shuffle_key=key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs)


SQL = """
WITH s AS (SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY 1),
w AS (SELECT src, chars, pow(CAST(chars AS DOUBLE), 0.5) AS w FROM s),
r AS (SELECT src, CASE WHEN chars = 0 THEN 1.0 ELSE w / (SELECT sum(w) FROM w) * (SELECT sum(chars) FROM s) / chars END AS rate FROM w),
p AS (SELECT src, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT src, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r)),
c AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM p),
d AS (SELECT doc_id, text, source, coalesce(source, '') AS src, CAST('0x' || substr(md5('lodestack-mix|' || doc_id), 1, 15) AS BIGINT) / 1152921504606846976.0 AS u FROM documents),
n AS (SELECT doc_id, count(*) FILTER (WHERE cdf <= u) AS n FROM (SELECT DISTINCT doc_id, src, u FROM d) JOIN c USING (src) GROUP BY doc_id)
SELECT doc_id, text, source, copy, CAST('0x' || substr(md5('lodestack-mix|order|' || doc_id || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, text, source, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM d JOIN n USING (doc_id))
"""
