"""Named queries over the driver's tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import naming
from lodestack.operators import access, graph, images, metrics, oplog, queue, ranges, retention, store, trees, versions
from lodestack.plans.views import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NOW = 700_000
POLICY = retention.Policy(grace_us=100_000, breaker_share=0.05, breaker_least=100)


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    """Register a function of Views under its own name."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = with_views(views, sql, recursive) if views else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import lodestack.plans.catalogue_more  # noqa: F401  registers the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import lodestack.plans.catalogue_more  # noqa: F401

    return dict(_SQL)


def text_name(column: str = "name") -> Column:
    return F.lower(F.hex(column)).alias(column)


_DIFF = """, bth AS (SELECT coalesce(a.path, b.path) AS path, a.kind AS ak, b.kind AS bk, a.target AS atg, b.target AS btg, a.size AS asz, b.size AS bsz FROM paths_a a FULL OUTER JOIN paths_b b ON a.path = b.path
  WHERE a.kind IS DISTINCT FROM b.kind OR a.target IS DISTINCT FROM b.target OR a.mode IS DISTINCT FROM b.mode),
changes AS (SELECT 'added' AS change, path, bk AS kind, NULL AS old_target, btg AS new_target, NULL AS old_size, bsz AS new_size FROM bth WHERE ak IS NULL OR ak <> bk
  UNION ALL SELECT 'removed', path, ak, atg, NULL, asz, NULL FROM bth WHERE bk IS NULL OR ak <> bk
  UNION ALL SELECT 'modified', path, bk, atg, btg, asz, bsz FROM bth WHERE ak = bk),
d AS (SELECT *, coalesce(new_size, 0) - coalesce(old_size, 0) AS size_delta FROM changes) """


@query(_DIFF + "SELECT * FROM d", "paths_a paths_b")
def diff_versions(v: Views) -> DataFrame:
    """J01 J02 J03 J04 C24."""
    return versions.diff(v.paths("a"), v.paths("b"))


@query(_DIFF + "SELECT split_part(path, '/', 1) AS lang, change, count(*) AS n_changes, CAST(sum(size_delta) AS BIGINT) AS bytes_delta FROM d GROUP BY ALL", "paths_a paths_b")
def diff_summary(v: Views) -> DataFrame:
    """J01 by language."""
    return versions.summary(versions.diff(v.paths("a"), v.paths("b")).withColumn("lang", F.substring_index("path", "/", 1)), "lang")


@query(_DIFF + "SELECT change, path, (SELECT count(*) FROM d) > 200 AS truncated FROM d ORDER BY path, change LIMIT 200", "paths_a paths_b")
def diff_truncated(v: Views) -> DataFrame:
    """A page of 200 changes is the feature."""
    return versions.first_page(versions.diff(v.paths("a"), v.paths("b")).select("change", "path"), 200, "path", "change")


@query("SELECT seq, name, size, kind FROM objects", "objects")
def object_names(v: Views) -> DataFrame:
    """C05 C07 C08."""
    d = v.table("documents")
    framed = naming.frame(1, F.encode("text", "utf-8"))
    return d.select(F.col("doc_id").alias("seq"), F.lower(F.hex(naming.name_of(framed))).alias("name"), F.octet_length(framed).cast("long").alias("size"), naming.kind_of(framed).alias("kind"))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'corrupt' WHEN doc_id % 10 = 1 THEN 'malformed' ELSE 'good' END AS fault, count(*) AS n FROM documents GROUP BY 1")
def verify_objects(v: Views) -> DataFrame:
    """Every tenth object gets a wrong byte, every other tenth a wrong header."""
    d = v.table("documents").select("doc_id", F.encode("text", "utf-8").alias("t"))
    good = naming.frame(1, "t")
    stored = F.when(F.col("doc_id") % 10 == 0, F.concat(good, F.unhex(F.lit("00")))).when(F.col("doc_id") % 10 == 1, F.concat(F.unhex(F.lit("0901")), F.col("t"))).otherwise(good)
    return store.verify(d.select(naming.name_of(good).alias("name"), stored.alias("framed"))).groupBy(F.coalesce("fault", F.lit("good")).alias("fault")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lower(hex(encode(text)[4:13])) AS slice FROM documents")
def payload_slice(v: Views) -> DataFrame:
    """Ten bytes from the payload's offset 3."""
    framed = naming.frame(1, F.encode("text", "utf-8"))
    return v.table("documents").select("doc_id", F.lower(F.hex(naming.payload(framed, 3, 10))).alias("slice"))


@query("SELECT CAST(CAST('0x' || substr(name, 1, 6) AS BIGINT) >> 16 AS INTEGER) AS shard, count(*) AS n FROM objects GROUP BY 1", "objects")
def name_shards(v: Views) -> DataFrame:
    """C21."""
    return v.objects().groupBy(naming.shard_of("name", 8).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT name FROM objects WHERE name >= '50' AND name < '60'", "objects")
def shard_scan(v: Views) -> DataFrame:
    """Shard 5 of 16 as a range."""
    return v.objects().filter(naming.in_shard("name", 4, 5)).select(text_name())


@query("SELECT CAST(CAST('0x' || substr(sha256(source), 1, 2) AS INTEGER) % 7 AS INTEGER) AS shard, count(*) AS n FROM documents GROUP BY 1")
def metadata_shards(v: Views) -> DataFrame:
    """C23."""
    return v.table("documents").groupBy(naming.partition_of("source", 7).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256(encode('lodestack.tree.split.v1') || '\\x02'::BLOB || encode(CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) % 16 = 0")
def boundary_keys(v: Views) -> DataFrame:
    """C11."""
    return v.table("documents").filter(naming.is_boundary(F.col("doc_id").cast("string"), 2, 16)).select("doc_id")


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}') AS fingerprint FROM documents""")
def request_fingerprints(v: Views) -> DataFrame:
    """C19."""
    return v.table("documents").select("doc_id", naming.fingerprint({"source": F.col("source"), "lang": F.col("lang"), "n": F.col("n_chars")}).alias("fingerprint"))


@query("""SELECT n_nationkey, name, regexp_matches(name, '^[a-z0-9][a-z0-9._-]{0,63}/[a-z0-9][a-z0-9._-]{0,127}$') AS env_ok, ref,
  regexp_matches(ref, '^refs/(heads|tags)/[A-Za-z0-9][A-Za-z0-9._/-]{0,255}$') AND NOT contains(ref, '//') AND NOT contains(ref, '..') AND NOT ends_with(ref, '/') AS ref_ok, starts_with(ref, 'refs/tags/') AS tag
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE lower('org/' || n_name) END AS name,
  CASE n_nationkey % 5 WHEN 0 THEN 'refs/heads/' || n_name WHEN 1 THEN 'refs/tags/' || n_name WHEN 2 THEN 'refs/heads/a//b' WHEN 3 THEN 'refs/heads/a..b' ELSE 'refs/heads/x/' END AS ref FROM nation)""")
def validated_names(v: Views) -> DataFrame:
    """C31 C32."""
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.lower("n_name")).otherwise(F.lower(F.concat(F.lit("org/"), F.col("n_name"))))
    ref = F.when(k % 5 == 0, F.concat(F.lit("refs/heads/"), F.col("n_name"))).when(k % 5 == 1, F.concat(F.lit("refs/tags/"), F.col("n_name"))).when(k % 5 == 2, "refs/heads/a//b").when(k % 5 == 3, "refs/heads/a..b").otherwise("refs/heads/x/")
    rows = v.table("nation").select("n_nationkey", name.alias("name"), ref.alias("ref"))
    return rows.select("n_nationkey", "name", naming.valid_env_name("name").alias("env_ok"), "ref", naming.valid_ref_name("ref").alias("ref_ok"), naming.is_tag("ref").alias("tag"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN greatest(p_size * 10 - p_partkey % 97 - 1, 0) WHEN 1 THEN p_partkey % 31 WHEN 2 THEN p_partkey % 31 END AS first,
  CASE p_partkey % 4 WHEN 0 THEN p_size * 10 - 1 WHEN 1 THEN p_size * 10 - 1 WHEN 2 THEN p_partkey % 31 + 4 END AS last FROM part
WHERE CASE p_partkey % 4 WHEN 0 THEN p_size > 0 WHEN 1 THEN p_partkey % 31 < p_size * 10 WHEN 2 THEN p_partkey % 31 + 4 < p_size * 10 ELSE false END""")
def range_headers(v: Views) -> DataFrame:
    """Suffix, open, closed and multiple ranges; refused ones are left out."""
    k = F.col("p_partkey")
    header = F.when(k % 4 == 0, F.concat(F.lit("bytes=-"), k % 97 + 1)).when(k % 4 == 1, F.concat(F.lit("bytes="), k % 31, F.lit("-"))).when(k % 4 == 2, F.concat(F.lit("bytes="), k % 31, F.lit("-"), k % 31 + 4)).otherwise("bytes=0-1,3-4")
    rows = v.table("part").select("p_partkey", naming.byte_range(header, (F.col("p_size") * 10).cast("long")).alias("r")).filter("r is not null")
    return rows.select("p_partkey", "r.first", "r.last")


_OFFERS = """, first AS (SELECT name, min(seq) AS f FROM objects GROUP BY name),
old AS (SELECT DISTINCT name FROM objects WHERE seq % 4 = 0),
offers AS (SELECT o.seq, o.env, o.lang, o.size, o.seq = f AND old.name IS NULL AS created FROM objects o JOIN first USING (name) LEFT JOIN old USING (name)) """


def _inserted(v: Views) -> DataFrame:
    return store.insert(v.objects(), v.objects().filter("seq % 4 = 0").select("name").distinct())


@query(_OFFERS + "SELECT seq, created, CASE WHEN created THEN size ELSE 0 END AS stored_size FROM offers", "objects")
def dedup_insert(v: Views) -> DataFrame:
    """A quarter of the documents is stored already."""
    return _inserted(v).select("seq", "created", "stored_size")


@query(_OFFERS + "SELECT lang, count(*) AS offered, CAST(sum(CAST(created AS INTEGER)) AS BIGINT) AS created, CAST(sum(size) AS BIGINT) AS bytes_offered, CAST(sum(CASE WHEN created THEN size ELSE 0 END) AS BIGINT) AS bytes_stored, round((sum(size) - sum(CASE WHEN created THEN size ELSE 0 END)) / CAST(sum(size) AS DOUBLE), 6) AS dedup_ratio FROM offers GROUP BY lang", "objects")
def dedup_stats(v: Views) -> DataFrame:
    """A01 C25."""
    return store.tally(_inserted(v), "lang")


@query("SELECT env, count(*) AS n_names FROM keepset GROUP BY env", "keepset")
def dedup_by_env(v: Views) -> DataFrame:
    """A03."""
    return store.sizes_by_env(v.keepset())


@query("SELECT name, count(DISTINCT env) AS n_envs FROM keepset GROUP BY name HAVING count(DISTINCT env) > 1", "keepset")
def shared_across_envs(v: Views) -> DataFrame:
    """A03 S19."""
    return store.shared(v.keepset()).select(text_name(), "n_envs")


@query("SELECT CAST(CAST('0x' || substr(name, 1, 1) AS BIGINT) AS INTEGER) AS bucket, kind, count(*) AS n_objects, CAST(sum(size) AS BIGINT) AS n_bytes FROM catalog GROUP BY ALL", "catalog")
def prefix_distribution(v: Views) -> DataFrame:
    """A05 C21."""
    return store.distribution(v.catalog())


@query("SELECT count(*) AS n_objects, CAST(sum(size) AS BIGINT) AS n_bytes FROM catalog", "catalog")
def corpus_total(v: Views) -> DataFrame:
    """A02."""
    return store.total(v.catalog())


@query("""SELECT unnest(['corpus_objects', 'corpus_bytes', 'live_objects', 'kept_references', 'environments', 'tombstones', 'queue_depth', 'references_per_object']) AS metric,
 unnest([CAST(a AS DOUBLE), b, c, d, e, f, g, round(d / CAST(c AS DOUBLE), 6)]) AS value FROM (SELECT (SELECT count(*) FROM catalog) a, (SELECT sum(size) FROM catalog) b, (SELECT count(DISTINCT name) FROM keepset) c, (SELECT count(*) FROM keepset) d,
 (SELECT count(*) FROM nation) e, (SELECT count(*) FROM tombstones) f, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') g)""", "catalog keepset tombstones")
def corpus_snapshot(v: Views) -> DataFrame:
    """A06 A07 A08."""
    return metrics.snapshot(v.catalog(), v.keepset(), v.envs(), v.tombstones(), v.queue().filter("status = 'running'"))


@query("SELECT 'corpus_bytes' AS metric, '# TYPE lodestack_corpus_bytes gauge' || chr(10) || 'lodestack_corpus_bytes ' || CAST(sum(size) AS BIGINT) AS text FROM catalog", "catalog")
def metrics_text(v: Views) -> DataFrame:
    """A15 C29."""
    return metrics.render(corpus_snapshot(v).filter("metric = 'corpus_bytes'"))


@query("SELECT DISTINCT name FROM objects WHERE seq % 2 = 0 AND name NOT IN (SELECT name FROM objects WHERE seq % 3 = 0 AND name NOT IN (SELECT name FROM tombstones))", "objects tombstones")
def missing_objects(v: Views) -> DataFrame:
    """J05 J06 J20."""
    return store.missing(v.objects().filter("seq % 2 = 0"), v.objects().filter("seq % 3 = 0"), v.tombstones()).select(text_name())


@query("SELECT seq, name FROM objects WHERE name IN (SELECT name FROM keepset)", "objects keepset")
def keepset_live(v: Views) -> DataFrame:
    """J07 J09."""
    return store.live(v.objects(), v.keepset()).select("seq", text_name())


@query("SELECT seq, env, name FROM objects WHERE (env, name) IN (SELECT (env, name) FROM keepset)", "objects keepset")
def keepset_holds(v: Views) -> DataFrame:
    """J08."""
    return store.held_by(v.objects(), v.keepset()).select("seq", "env", text_name())


@query("SELECT DISTINCT env, name FROM objects WHERE seq % 3 = 0 EXCEPT SELECT env, name FROM keepset", "objects keepset")
def keepset_merge(v: Views) -> DataFrame:
    """K14 G07."""
    return store.merge_keepset(v.keepset(), v.objects().filter("seq % 3 = 0")).select("env", text_name())


@query("SELECT env, name FROM keepset WHERE env <> 'src3' UNION ALL SELECT DISTINCT 'src3', name FROM objects WHERE seq % 50 = 0", "objects keepset")
def keepset_replace(v: Views) -> DataFrame:
    """K15."""
    return store.replace_keepset(v.keepset(), "src3", v.objects().filter("seq % 50 = 0")).select("env", text_name())


@query("SELECT name, min(written_at_us) AS written_at_us, arg_min(size, written_at_us) AS size FROM objects GROUP BY name", "objects")
def catalog_record(v: Views) -> DataFrame:
    """The first write of a name wins."""
    return store.record(v.objects().select("name", "written_at_us", "size"), "name", keep="written_at_us").select(text_name(), "written_at_us", "size")


@query(""", alt AS (SELECT 'sha1' AS algorithm, sha1(text) AS encoded, arg_max(o.name, o.seq) AS name, max(o.seq) AS seq FROM documents JOIN objects o ON doc_id = o.seq WHERE doc_id % 2 = 0 GROUP BY sha1(text))
SELECT doc_id, alt.name FROM documents JOIN alt ON sha1(text) = encoded WHERE alt.name IN (SELECT name FROM catalog) AND alt.name NOT IN (SELECT name FROM tombstones)""", "objects catalog tombstones")
def alt_digest_lookup(v: Views) -> DataFrame:
    """J10 K17."""
    named = v.objects().join(v.table("documents").select(F.col("doc_id").alias("seq"), F.sha1("text").alias("encoded")), "seq").withColumn("algorithm", F.lit("sha1"))
    alternates = named.filter("seq % 2 = 0").select("algorithm", "encoded", "seq", "name")
    lookups = named.select("algorithm", "encoded", F.col("seq").alias("doc_id"))
    return store.confirmed_hints(lookups, alternates, v.catalog(), v.tombstones()).select("doc_id", text_name())


@query("SELECT name, expires_at_us FROM tombstones WHERE expires_at_us > 700000", "tombstones")
def tombstone_purge(v: Views) -> DataFrame:
    """K16 A18 S17."""
    return store.purge(v.tombstones(), NOW).select(text_name(), "expires_at_us")


_GC = """, lease AS (SELECT DISTINCT name FROM session_objects WHERE session IN (SELECT session FROM sessions WHERE expires_at_us > 700000)),
gc AS (SELECT c.*, CASE WHEN name IN (SELECT name FROM keepset) THEN 'live' WHEN name IN (SELECT name FROM lease) THEN 'leased' WHEN written_at_us > 600000 THEN 'recent' ELSE 'candidate' END AS state FROM catalog c) """


def _classified(v: Views) -> DataFrame:
    return retention.classify(v.catalog(), v.keepset(), retention.leased(v.sessions(), v.session_objects(), NOW), NOW, POLICY)


@query(_GC + "SELECT count(*) AS corpus, count(*) FILTER (state = 'live') AS live, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'recent') AS too_recent, count(*) FILTER (state = 'candidate') AS candidates, CAST(sum(CASE WHEN state = 'candidate' THEN size ELSE 0 END) AS BIGINT) AS bytes_reclaimable, count(*) >= 100 AND count(*) FILTER (state = 'candidate') > 0.05 * count(*) AS aborted FROM gc", "catalog keepset sessions session_objects")
def gc_plan(v: Views) -> DataFrame:
    """G01 G02 G04 A09."""
    return retention.plan(_classified(v), POLICY)


@query(_GC + "SELECT CAST(CAST('0x' || substr(name, 1, 1) AS BIGINT) AS INTEGER) AS shard, count(*) FILTER (state = 'live') AS live, count(*) FILTER (state = 'candidate') AS candidates FROM gc GROUP BY 1", "catalog keepset sessions session_objects")
def gc_shards(v: Views) -> DataFrame:
    """G01 C21 S19."""
    return retention.by_shard(_classified(v), POLICY)


@query(_GC + ", a AS (SELECT size, CASE WHEN expires_at_us IS NULL THEN 'mark' WHEN expires_at_us <= 700000 THEN 'delete' ELSE 'wait' END AS action FROM gc LEFT JOIN tombstones USING (name) WHERE state = 'candidate') SELECT action, count(*) AS n_objects, CAST(sum(size) AS BIGINT) AS n_bytes FROM a GROUP BY 1", "catalog keepset sessions session_objects tombstones")
def gc_sweep(v: Views) -> DataFrame:
    """G03 K19."""
    return retention.sweep_report(retention.sweep(_classified(v), v.tombstones(), NOW, POLICY))


def _claims(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    return v.table("nation").select(F.when(k % 4 == 0, F.concat(F.lit("old/"), F.lower("n_name"))).otherwise(F.lower("n_name")).alias("name"), k.alias("env"))


def _claimed_envs(v: Views) -> DataFrame:
    return v.table("nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("env"), F.lower("n_name").alias("name"))


_ORPHANS = "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'old/' || lower(n_name) ELSE lower(n_name) END AS name, n_nationkey AS env, CASE WHEN n_nationkey % 5 = 0 THEN 'absent' ELSE 'renamed' END AS reason FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 4 = 0"


@query(_ORPHANS)
def orphan_names(v: Views) -> DataFrame:
    """J11."""
    return retention.orphan_names(_claims(v), _claimed_envs(v))


def _refs_with_expiry(v: Views) -> DataFrame:
    o = v.table("orders")
    return o.select(F.col("o_custkey").alias("env"), F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderpriority") == "1-URGENT", "ephemeral").otherwise("durable").alias("lifecycle"), F.col("o_orderkey").alias("expires_at_us"))


@query("SELECT o_custkey AS env, o_orderkey AS ref FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey <= 5000")
def expired_refs(v: Views) -> DataFrame:
    """G08 S17."""
    return retention.expired_refs(_refs_with_expiry(v), 5000).select("env", "ref")


@query(f""", s AS (SELECT 'expired_refs' AS step, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey <= 5000 UNION ALL SELECT 'orphan_names', count(*) FROM ({_ORPHANS}) UNION ALL SELECT 'purged_tombstones', count(*) FROM tombstones WHERE expires_at_us <= 5000)
SELECT * FROM s UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM s""", "tombstones")
def maintenance_pass(v: Views) -> DataFrame:
    """G09 A10."""
    return retention.maintenance(_refs_with_expiry(v), _claims(v), _claimed_envs(v), v.tombstones(), 5000)


def _heads(v: Views) -> DataFrame:
    return v.commits().groupBy("conv_id").agg(F.max("node").alias("node")).select(F.col("conv_id").alias("start"), "node")


@query(""", heads AS (SELECT conv_id AS start, max(node) AS node FROM commits GROUP BY conv_id),
log AS (SELECT start, node, 0 AS position FROM heads UNION ALL SELECT log.start, p.parent, log.position + 1 FROM log JOIN parents p ON p.child = log.node AND p.ordinal = 0 WHERE log.position + 1 < 50)
SELECT start, node, position FROM log""", "commits parents", True)
def log_first_parent(v: Views) -> DataFrame:
    """The newest 50 of each history are the feature."""
    return graph.first_parent_log(_heads(v), v.parents().filter("ordinal = 0"), 50)


_REACH = """, heads AS (SELECT conv_id AS start, max(node) AS node FROM commits GROUP BY conv_id),
walk AS (SELECT start, node FROM heads UNION SELECT walk.start, p.parent FROM walk JOIN parents p ON p.child = walk.node) """


def _edges(v: Views) -> DataFrame:
    return v.parents().select(F.col("child").alias("parent"), F.col("parent").alias("child"))


@query(_REACH + "SELECT start, node FROM walk", "commits parents", True)
def ancestors_closure(v: Views) -> DataFrame:
    """R03."""
    return graph.reach(_heads(v), _edges(v)).select("start", "node")


@query(_REACH + "SELECT c.conv_id AS start, c.node + c.turn % 2 * 1000 AS node, walk.node IS NOT NULL AS reachable FROM commits c LEFT JOIN walk ON walk.start = c.conv_id AND walk.node = c.node + c.turn % 2 * 1000", "commits parents", True)
def commit_reachability(v: Views) -> DataFrame:
    """Every other commit is asked for from another conversation."""
    asked = v.commits().select(F.col("conv_id").alias("start"), (F.col("node") + F.col("turn") % 2 * 1000).alias("node"))
    return graph.reachable(asked, graph.reach(_heads(v), _edges(v)))


_BRANCHES = """, branches AS (SELECT conv_id * 2 AS start, node FROM commits WHERE turn = 1 UNION ALL SELECT conv_id * 2 + 1, max(node) FROM commits GROUP BY conv_id),
walk AS (SELECT start, node FROM branches UNION SELECT walk.start, p.parent FROM walk JOIN parents p ON p.child = walk.node)
SELECT start, count(*) AS n_nodes, CAST(sum(size) AS BIGINT) AS n_bytes FROM (SELECT node, min(start) AS start FROM walk GROUP BY node HAVING count(*) = 1) JOIN commits USING (node) GROUP BY start"""


@query(_BRANCHES, "commits parents", True)
def branch_exclusive_bytes(v: Views) -> DataFrame:
    """A branch at the second message and one at the last."""
    c = v.commits()
    roots = c.filter("turn = 1").select((F.col("conv_id") * 2).alias("start"), "node").unionAll(c.groupBy("conv_id").agg(F.max("node").alias("node")).select((F.col("conv_id") * 2 + 1).alias("start"), "node"))
    return graph.exclusive(graph.reach(roots, _edges(v)), c.select("node", "size"))


@query(""", lg AS (SELECT env, seq - 20 AS "before", seq AS "after", written_at_us AS at_us FROM objects WHERE seq % 40 = 0),
r AS (SELECT env, max(seq) AS node FROM objects GROUP BY env UNION ALL SELECT env, "before" FROM lg WHERE at_us >= 400000 UNION ALL SELECT env, "after" FROM lg WHERE at_us >= 400000),
walk AS (SELECT env, node FROM r WHERE node IS NOT NULL UNION SELECT env, node - 20 FROM walk WHERE node IN (SELECT seq FROM objects) AND node % 20 < 10 AND node - 20 > 300)
SELECT env, node AS name FROM walk""", "objects", True)
def keepset_rebuild(v: Views) -> DataFrame:
    """All environments in one loop."""
    o = v.objects()
    refs = o.groupBy("env").agg(F.max("seq").alias("target"))
    log = o.filter("seq % 40 = 0").select("env", (F.col("seq") - 20).alias("before"), F.col("seq").alias("after"), F.col("written_at_us").alias("at_us"))
    edges = o.filter("seq % 20 < 10 and seq - 20 > 300").select(F.col("seq").alias("parent"), (F.col("seq") - 20).alias("child"))
    return graph.keepsets(refs, log, edges, 400_000)


@query("SELECT file, ordinal, size, coalesce(CAST(sum(size) OVER (PARTITION BY file ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM files", "files")
def chunk_offsets(v: Views) -> DataFrame:
    """O03 A04."""
    return ranges.offsets(v.files())


@query(""", c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY file ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM files),
q AS (SELECT o_orderkey AS file, o_orderkey % 40 AS "offset", 30 + o_custkey % 50 AS length FROM orders)
SELECT file, "offset", ordinal, CAST(greatest("offset" - start, 0) AS BIGINT) AS skip, CAST(least(start + size, "offset" + length) - greatest(start, "offset") AS BIGINT) AS take FROM c JOIN q USING (file) WHERE start < "offset" + length AND start + size > "offset" """, "files")
def range_read(v: Views) -> DataFrame:
    """O01 O02."""
    asked = v.table("orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 40).alias("offset"), (30 + F.col("o_custkey") % 50).alias("length"))
    return ranges.read(ranges.offsets(v.files()), asked)


@query("SELECT p_partkey, p_name, 350 AS next_cursor FROM part WHERE p_partkey > 300 AND p_partkey <= 350")
def page_keyset(v: Views) -> DataFrame:
    """A page is the feature."""
    return ranges.page(v.table("part").select("p_partkey", "p_name"), "p_partkey", 300, 50)


@query("SELECT path AS sk, size FROM paths_a WHERE split_part(path, '/', 1) = 'en' AND starts_with(path, 'en/src1') AND path > 'en/src1/5' ORDER BY path", "paths_a")
def prefix_scan(v: Views) -> DataFrame:
    """S13 S14."""
    items = v.paths("a").select(F.substring_index("path", "/", 1).alias("pk"), F.col("path").alias("sk"), "size")
    return ranges.scan(items, "en", "en/src1", after="en/src1/5").select("sk", "size")


@query('SELECT env, sequence, ref, "before", "after" FROM oplog', "oplog")
def oplog_dense_seq(v: Views) -> DataFrame:
    """V08 V07."""
    e = v.table("events").select(F.col("user_id").alias("env"), F.col("event_type").alias("ref"), F.col("event_id").alias("after"), "ts")
    return oplog.with_before(oplog.dense_sequence(e, "env", "ts", "after")).select("env", "sequence", "ref", "before", "after")


@query('SELECT env, sequence, "after" FROM (SELECT *, row_number() OVER (PARTITION BY env ORDER BY sequence DESC) AS k FROM oplog) WHERE k <= 5', "oplog")
def oplog_latest_n(v: Views) -> DataFrame:
    """The newest five are the feature."""
    return oplog.latest(v.oplog(), 5).select("env", "sequence", "after")


@query('SELECT env, ref, arg_max("after", sequence) AS target, count(*) AS generation FROM oplog GROUP BY env, ref', "oplog")
def latest_refs(v: Views) -> DataFrame:
    """V20 K10 S13 J12."""
    return oplog.refs(v.oplog())


@query(""", q AS (SELECT DISTINCT env, ref, k * 10 AS at FROM oplog, (SELECT unnest(range(1, 7)) AS k))
SELECT q.env, q.ref, q.at, (SELECT arg_max("after", sequence) FROM oplog o WHERE o.env = q.env AND o.ref = q.ref AND o.sequence <= q.at) AS target FROM q""", "oplog")
def ref_as_of(v: Views) -> DataFrame:
    """V11."""
    log = v.oplog()
    asked = log.select("env", "ref").distinct().select("env", "ref", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).select("env", "ref", (F.col("k") * 10).cast("long").alias("at"))
    return oplog.as_of(log, asked)


@query("""SELECT env, sequence, ref, CASE WHEN "before" IS NULL THEN 'delete' ELSE 'update' END AS action, "before" AS target, CASE WHEN "before" IS NOT NULL THEN generation END AS expected_generation
FROM oplog JOIN (SELECT env, ref, count(*) AS generation FROM oplog GROUP BY env, ref) USING (env, ref)""", "oplog")
def undo_rows(v: Views) -> DataFrame:
    """V10."""
    log = v.oplog()
    return oplog.undo(log, oplog.refs(log))


@query("""WITH r AS (SELECT event_id AS seq, user_id AS env, event_type || event_id % 7 AS key, sha256(CAST(event_id % 3 AS VARCHAR)) AS fp, value FROM events),
f AS (SELECT env, key, min(seq) AS first, arg_min(fp, seq) AS fp0, arg_min(value, seq) AS v0 FROM r GROUP BY env, key)
SELECT seq, env, key, CASE WHEN seq = first THEN 'executed' WHEN fp = fp0 THEN 'replayed' ELSE 'mismatch' END AS verdict, CASE WHEN seq = first OR fp = fp0 THEN v0 END AS outcome FROM r JOIN f USING (env, key)""")
def idempotent_replay(v: Views) -> DataFrame:
    """V09 C19 T3."""
    e = v.table("events")
    rows = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("env"), F.concat("event_type", F.col("event_id") % 7).alias("key"), F.sha2((F.col("event_id") % 3).cast("string"), 256).alias("fingerprint"), F.col("value").alias("outcome"))
    return oplog.replay(rows)


@query("SELECT event_type AS change, array_to_string(list(event_id ORDER BY event_id DESC), ',') AS newest, count(*) AS n FROM events GROUP BY 1")
def change_list(v: Views) -> DataFrame:
    """Every change's commits, newest first."""
    e = v.table("events").select(F.col("event_type").alias("change"), F.col("event_id").alias("sequence"), F.col("event_id").alias("commit"))
    return oplog.changes(e).select("change", F.array_join(F.transform("commits", lambda x: x.cast("string")), ",").alias("newest"), F.size("commits").cast("long").alias("n"))


@query("SELECT user_id AS commit_id, event_type AS namespace, arg_max(props, event_id) AS body, max(event_id) AS seq FROM events GROUP BY ALL")
def newest_notes(v: Views) -> DataFrame:
    """V12."""
    e = v.table("events").select(F.col("user_id").alias("commit"), F.col("event_type").alias("namespace"), F.col("props").alias("body"), F.col("event_id").alias("seq"))
    return oplog.newest_notes(e).withColumnRenamed("commit", "commit_id")
