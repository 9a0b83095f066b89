"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the session's ``spark.checkpoint.dir``; only a session without
one gets a folder chosen here (the warehouse on a cluster, a temporary folder
when driver and executors are one local process).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if master.startswith("local[") or master == "local":
            _own[app] = f"file://{tempfile.mkdtemp(prefix='lodestack-')}"
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Hadoop's names for file systems that pyarrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_file_system(uri: str):
    """pyarrow's file system and path of a URI of the shared store; a scheme
    that only Hadoop knows is an error."""
    from pyarrow.fs import FileSystem

    scheme, sep, rest = uri.partition(":")
    return FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{sep}{rest}")


class Scratch:
    """Tables of one operator call: written once, read many times.

    ``keep`` tables live until the session's process ends, since the returned
    DataFrame still reads them; others go as soon as ``drop`` is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(self._sweep)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the DataFrame that reads it back."""
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, back: DataFrame) -> None:
        if path := self._paths.pop(id(back), None):
            delete(self.spark, path)

    def _sweep(self) -> None:
        try:
            delete(self.spark, self.base)
        except Exception:  # the session has ended; the folder's owner clears it
            pass


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place in a total order, from 1, in ``name``: sorted
    into ranges, numbered in each, and moved by what the ranges before hold.
    No task sees more than its range."""
    scratch = Scratch(rows.sparkSession, "numbered")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = scratch.table(rows.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return cut.withColumn("_inside", inside).join(F.broadcast(sizes), "_b").withColumn(name, (F.col("_inside") + F.col("_skip")).cast("long")).drop("_b", "_inside", "_skip")
