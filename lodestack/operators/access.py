"""Authorization as joins: which grants let which principal at which environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.naming import fnmatch_regex

#: Operation bits; no bit implies another.
OPERATIONS = {"read": 1, "write": 2, "admin": 4, "build": 8, "fork": 16}
#: Characters of a name pattern, at its beginning or end, that it is joined by.
ANCHOR = 12
#: Parts that patterns without a fixed beginning or end are dealt to.
PARTS = 32


def operations(labels: Column) -> Column:
    """The mask of an array of operation names; null if one is unknown."""
    known = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    bits = F.transform(labels, lambda x: F.element_at(known, x))
    return F.when(F.forall(bits, lambda x: x.isNotNull()), F.aggregate(bits, F.lit(0), lambda a, x: a.bitwiseOR(x)))


def parse_selector(text: Column | str) -> Column:
    """(kind, pattern, labels) of 'id:…', 'name:…' or 'labels:k=v,…'; null for
    other kinds (P08)."""
    c = F.col(text) if isinstance(text, str) else text
    kind = F.substring_index(c, ":", 1)
    rest = F.substring(c, F.length(kind) + 2, F.length(c))
    pairs = F.transform(F.filter(F.split(rest, ","), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x))).otherwise(F.lit("")).alias("v")))
    labels = F.when(kind == "labels", F.map_from_entries(pairs))
    return F.when(kind.isin("id", "name", "labels"), F.struct(kind.alias("kind"), F.when(kind != "labels", rest).alias("pattern"), labels.alias("labels")))


def matches(selector: Column, env: Column, name: Column, labels: Column) -> Column:
    """Whether a parsed selector matches an environment (P02-P04): its id, its
    name by a shell pattern, or all the labels asked for, of which none matches
    everything."""
    wanted = F.forall(F.map_entries(selector["labels"]), lambda e: F.coalesce(F.element_at(labels, e["key"]) == e["value"], F.lit(False)))
    return F.when(selector["kind"] == "id", selector["pattern"] == env.cast("string")).when(selector["kind"] == "name", F.rlike(name, fnmatch_regex(selector["pattern"]))).otherwise(wanted)


def glob_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, pattern) of all that match, each once.

    Patterns with a fixed beginning meet names by it, others with a fixed end
    by that; both are equalities. Only patterns with neither are tried on every
    name, which is what they ask for: they are dealt to parts, so that no task
    holds them all.
    """
    all_names, asked = names.select("name").distinct(), patterns.select("pattern").distinct()
    lead, tail = F.regexp_extract("pattern", rf"^([^*?\[]{{0,{ANCHOR}}})", 1), F.regexp_extract("pattern", rf"([^*?\[\]]{{0,{ANCHOR}}})$", 1)
    key = F.when(lead != "", F.concat(F.lit("^"), lead)).when(tail != "", F.concat(F.lit("$"), tail))
    keyed = asked.withColumn("key", key)
    n = F.least(F.length("name"), F.lit(ANCHOR))
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.array(F.concat(F.lit("^"), F.left("name", k)), F.concat(F.lit("$"), F.right("name", k))))
    keys = all_names.filter("name <> ''").select("name", F.explode(F.array_distinct(F.flatten(ends))).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
    by_key = keys.join(keyed.filter("key is not null"), "key").select("name", "pattern")
    part = F.pmod(F.xxhash64("pattern"), F.lit(PARTS))
    spread = all_names.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    loose = spread.join(keyed.filter("key is null").select("pattern", part.alias("part")), "part").select("name", "pattern")
    return by_key.unionAll(loose).filter(F.rlike(F.col("name"), fnmatch_regex("pattern")))


def label_matches(envs: DataFrame, selectors: DataFrame) -> DataFrame:
    """(selector, env) of selectors (selector, s) by label that an environment
    (env, name, labels) satisfies (P04). They meet by the one of a selector's
    labels that the fewest environments carry."""
    held = envs.select("env", "labels", F.explode("labels").alias("k", "v"))
    counts = held.groupBy("k", "v").agg(F.count("*").alias("n"))
    wanted = selectors.select("selector", "s", F.explode("s.labels").alias("k", "v"))
    # A label that nobody carries counts as none: its selector matches nothing.
    rare = wanted.join(counts, ["k", "v"], "left").groupBy("selector").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "v")).alias("r"), F.first("s").alias("s")).select("selector", "s", "r.k", "r.v")
    hit = held.join(rare, ["k", "v"])
    return hit.filter(matches(F.col("s"), F.col("env"), F.lit(""), F.col("labels"))).select("selector", "env")


def permits(grants: DataFrame, envs: DataFrame, operation: int) -> DataFrame:
    """(principal, env) pairs that some grant allows.

    ``grants`` (principal, ops, pin, selector) and ``envs`` (env, name, labels).
    A grant may be pinned to one environment; any bit asked for suffices. Every
    kind of selector joins by an equality: ids and pins by the environment,
    names by a fixed end of the pattern, labels by the rarest one; a selector
    that matches everything needs no join. Selectors are told apart by what
    they say, not by who holds them.
    """
    able = grants.filter(F.col("ops").bitwiseAND(F.lit(operation)) != 0).withColumn("s", parse_selector("selector")).filter("s is not null")
    target = F.coalesce(F.col("pin").cast("string"), F.when(F.col("s.kind") == "id", F.col("s.pattern")))
    exact = able.withColumn("_env", target).filter("_env is not null")
    hits = exact.join(envs, F.col("_env") == F.col("env").cast("string")).filter(matches(F.col("s"), F.col("env"), F.col("name"), F.col("labels"))).select("principal", "env")
    every = (F.col("s.kind") == "labels") & (F.size("s.labels") == 0)
    open_ = able.filter(target.isNull()).withColumn("selector", F.when(every, "labels:").otherwise(F.col("selector")))
    kinds = open_.select("selector", "s").dropDuplicates(["selector"])
    named = kinds.filter("s.kind = 'name'").select("selector", "s.pattern")
    by_name = glob_matches(envs, named).join(named, "pattern").join(envs.select("name", "env"), "name").select("selector", "env")
    by_label = label_matches(envs, kinds.filter((F.col("s.kind") == "labels") & (F.size("s.labels") > 0)))
    found = by_name.unionAll(by_label).unionAll(envs.select(F.lit("labels:").alias("selector"), "env"))
    return hits.unionAll(open_.select("principal", "selector").join(found, "selector").select("principal", "env")).distinct()


def could_name(grants: DataFrame, names: DataFrame, operation: int) -> DataFrame:
    """(principal, name) of names that need not exist yet: unpinned grants by
    name pattern alone (P06)."""
    able = grants.filter((F.col("ops").bitwiseAND(F.lit(operation)) != 0) & F.col("pin").isNull()).withColumn("s", parse_selector("selector")).filter("s.kind = 'name'")
    able = able.select("principal", "s.pattern").distinct()
    return glob_matches(names, able).join(able, "pattern").select("principal", "name").distinct()


def narrow(ops: Column, asked: Column) -> Column:
    """What remains of a grant when less is asked for."""
    return ops.bitwiseAND(asked)


def authorize(requests: DataFrame, permitted: DataFrame) -> DataFrame:
    """Requests (principal, env) with ``outcome``: 'allowed' or 'not found'; an
    environment that is absent and one that is forbidden look alike (P11)."""
    known = permitted.withColumn("_p", F.lit(True))
    return requests.join(known, ["principal", "env"], "left").withColumn("outcome", F.when(F.col("_p"), "allowed").otherwise("not found")).drop("_p")
