"""Relations of the engine, derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.naming import frame, name_of


class Views:
    """Spark side: one method for each relation."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def objects(self) -> DataFrame:
        d = self.table("documents")
        framed = frame(1, F.encode("text", "utf-8"))
        return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("env"), "lang", F.lit(1).alias("kind"), name_of(framed).alias("name"), F.octet_length(framed).cast("long").alias("size"), (F.col("doc_id") * 1000).alias("written_at_us"))

    def catalog(self) -> DataFrame:
        return self.objects().groupBy("name").agg(F.min("written_at_us").alias("written_at_us"), F.min("size").alias("size"), F.min("kind").alias("kind"))

    def labelled(self) -> DataFrame:
        return self.objects().join(self.table("labels").select(F.col("doc_id").alias("seq"), "quality", "toxic"), "seq")

    def keepset(self) -> DataFrame:
        return self.labelled().filter("quality = 1").select("env", "name").distinct()

    def tombstones(self) -> DataFrame:
        return self.labelled().filter("toxic = 1").groupBy("name").agg(F.min(F.col("seq") * 2000).alias("expires_at_us"))

    def sessions(self) -> DataFrame:
        return self.spark.range(10).select(F.col("id").alias("session"), (F.col("id") * 100_000).alias("expires_at_us"))

    def session_objects(self) -> DataFrame:
        return self.objects().filter("seq % 9 = 0").select((F.col("seq") % 10).alias("session"), "name")

    def paths(self, side: str) -> DataFrame:
        d = self.table("documents").filter("doc_id % 7 <> 0" if side == "a" else "doc_id % 5 <> 0")
        text = F.col("text") if side == "a" else F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        mode = F.when(F.col("doc_id") % 13 == 0, 493).otherwise(420)
        if side == "b":
            mode = F.when(F.col("doc_id") % 17 == 0, F.lit(913) - mode).otherwise(mode)
        kind = F.lit("file") if side == "a" else F.when(F.col("doc_id") % 29 == 0, "link").otherwise("file")
        return d.select(F.concat_ws("/", "lang", "source", "doc_id").alias("path"), kind.alias("kind"), F.sha2(text, 256).alias("target"), mode.cast("int").alias("mode"), F.octet_length(text).cast("long").alias("size"))

    def commits(self) -> DataFrame:
        return self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id", "turn", F.sha2("text", 256).alias("tree"), F.octet_length("text").cast("long").alias("size"))

    def parents(self) -> DataFrame:
        c = self.commits()
        first = c.filter("turn > 0").select(F.col("node").alias("child"), (F.col("node") - 1).alias("parent"), F.lit(0).alias("ordinal"))
        second = c.filter("turn > 1 and turn % 3 = 0").select(F.col("node").alias("child"), (F.col("node") - 2).alias("parent"), F.lit(1).alias("ordinal"))
        return first.unionAll(second)

    def oplog(self) -> DataFrame:
        e = self.table("events").select(F.col("user_id").alias("env"), F.col("event_type").alias("ref"), F.col("event_id").alias("after"), "ts", "value", "props")
        seq = F.row_number().over(Window.partitionBy("env").orderBy("ts", "after")).cast("long")
        rows = e.withColumn("sequence", seq)
        return rows.withColumn("before", F.lag("after").over(Window.partitionBy("env", "ref").orderBy("sequence")))

    def queue(self) -> DataFrame:
        o = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("running")
        return o.select(F.col("o_custkey").alias("env"), F.col("o_orderkey").alias("op_sequence"), F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("commit"), status.alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("enqueued_at"))

    def files(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
        return self.table("lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(order).alias("ordinal"), F.col("l_quantity").cast("long").alias("size"))

    def envs(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        name = F.replace(F.lower(F.concat_ws("/", "r_name", "n_name")), F.lit(" "), F.lit("_"))
        parity = F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd")
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("env"), name.alias("name"), F.create_map(F.lit("region"), F.lower("r_name"), F.lit("parity"), parity).alias("labels"), F.col("n_regionkey").alias("region"))


#: The same relations for DuckDB, as common table expressions by name.
SQL = {
    "objects": """objects AS (SELECT doc_id AS seq, source AS env, lang, 1 AS kind, sha256('\\x01\\x01'::BLOB || encode(text)) AS name, CAST(strlen(text) + 2 AS BIGINT) AS size, doc_id * 1000 AS written_at_us FROM documents)""",
    "catalog": """catalog AS (SELECT name, min(written_at_us) AS written_at_us, min(size) AS size, min(kind) AS kind FROM objects GROUP BY name)""",
    "labelled": """labelled AS (SELECT o.*, quality, toxic FROM objects o JOIN labels ON doc_id = seq)""",
    "keepset": """keepset AS (SELECT DISTINCT env, name FROM labelled WHERE quality = 1)""",
    "tombstones": """tombstones AS (SELECT name, min(seq * 2000) AS expires_at_us FROM labelled WHERE toxic = 1 GROUP BY name)""",
    "sessions": """sessions AS (SELECT range AS session, range * 100000 AS expires_at_us FROM range(10))""",
    "session_objects": """session_objects AS (SELECT seq % 10 AS session, name FROM objects WHERE seq % 9 = 0)""",
    "paths_a": """paths_a AS (SELECT lang || '/' || source || '/' || doc_id AS path, 'file' AS kind, sha256(text) AS target, CASE WHEN doc_id % 13 = 0 THEN 493 ELSE 420 END AS mode, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 7 <> 0)""",
    "paths_b": """paths_b AS (SELECT path, kind, sha256(t) AS target, CASE WHEN doc_id % 17 = 0 THEN 913 - m ELSE m END AS mode, CAST(strlen(t) AS BIGINT) AS size FROM (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, CASE WHEN doc_id % 29 = 0 THEN 'link' ELSE 'file' END AS kind, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS t, CASE WHEN doc_id % 13 = 0 THEN 493 ELSE 420 END AS m FROM documents WHERE doc_id % 5 <> 0))""",
    "commits": """commits AS (SELECT conv_id * 1000 + turn AS node, conv_id, turn, sha256(text) AS tree, CAST(strlen(text) AS BIGINT) AS size FROM conversations)""",
    "parents": """parents AS (SELECT node AS child, node - 1 AS parent, 0 AS ordinal FROM commits WHERE turn > 0 UNION ALL SELECT node, node - 2, 1 FROM commits WHERE turn > 1 AND turn % 3 = 0)""",
    "oplog": """oplog AS (SELECT *, lag("after") OVER (PARTITION BY env, ref ORDER BY sequence) AS "before" FROM (SELECT user_id AS env, event_type AS ref, event_id AS "after", ts, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events))""",
    "queue": """queue AS (SELECT o_custkey AS env, o_orderkey AS op_sequence, o_orderpriority || '-' || (o_custkey % 50) AS "commit", CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'running' END AS status, epoch_us(o_orderdate) AS enqueued_at FROM orders)""",
    "files": """files AS (SELECT l_orderkey AS file, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS INTEGER) AS ordinal, CAST(l_quantity AS BIGINT) AS size FROM lineitem)""",
    "envs": """envs AS (SELECT n_nationkey AS env, replace(lower(r_name || '/' || n_name), ' ', '_') AS name, lower(r_name) AS region_label, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, n_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey)""",
}
_NEEDS = {"catalog": ["objects"], "labelled": ["objects"], "keepset": ["labelled"], "tombstones": ["labelled"], "session_objects": ["objects"], "parents": ["commits"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """A query over named relations: their definitions before its body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    joiner = ", " if body.lstrip().startswith(",") else " "
    body = body.lstrip().removeprefix(",")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in order) + joiner + body
