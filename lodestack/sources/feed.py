"""The change feed as a Python data source, in batch and as a stream.

A feed is a folder of parquet, partitioned by shard. The stream's offset is the
last sequence of each shard; inside a shard events come in sequence order and
none is skipped, whatever their clock says.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestack.plans.storage import Scratch, arrow_file_system
from lodestack.streaming.feed import sharded

SCHEMA = "shard long, sequence long, env long, event_type string, ts timestamp_ntz, value double, props string"
_COLUMNS = ["sequence", "env", "event_type", "ts", "value", "props"]


def publish(events: DataFrame, shards: int) -> str:
    """Write events as a feed and return its folder; a file's rows are in sequence order."""
    rows = sharded(events, shards).select("shard", "sequence", F.col("user_id").alias("env"), "event_type", "ts", "value", "props")
    path = Scratch(events.sparkSession, "feed").path("events")
    rows.repartition("shard").sortWithinPartitions("shard", "sequence").write.partitionBy("shard").parquet(path)
    return path


class Span(InputPartition):
    """Sequences of one shard, after ``start`` and up to ``end``."""

    def __init__(self, shard: int, start: int, end: int | None):
        self.shard, self.start, self.end = shard, start, end


def _shard(path: str, shard: int) -> pads.Dataset:
    store, folder = arrow_file_system(path) if "://" in path or path.startswith("file:") else (None, path)
    return pads.dataset(f"{folder}/shard={shard}", filesystem=store, format="parquet", exclude_invalid_files=True)


def _bounds(fragment) -> list[tuple[int, int]]:
    """(least, most) sequence of each row group, from the file's footer."""
    place = fragment.metadata.schema.names.index("sequence")
    found = [fragment.metadata.row_group(g).column(place).statistics for g in range(fragment.metadata.num_row_groups)]
    return [(x.min, x.max) for x in found]


def _read(path: str, span: Span) -> Iterator[pa.RecordBatch]:
    """Rows in sequence order, by row groups: those that overlap are sorted
    together, so memory holds one row group where files follow each other."""
    want = pads.field("sequence") > span.start
    if span.end is not None:
        want &= pads.field("sequence") <= span.end
    groups = []
    for fragment in _shard(path, span.shard).get_fragments():
        for g, (least, most) in enumerate(_bounds(fragment)):
            if most > span.start and (span.end is None or least <= span.end):
                groups.append((least, most, fragment, g))
    groups.sort(key=lambda x: x[:2])
    kinds = pa.schema([("shard", pa.int64()), ("sequence", pa.int64()), ("env", pa.int64()), ("event_type", pa.string()), ("ts", pa.timestamp("us")), ("value", pa.float64()), ("props", pa.string())])
    while groups:
        last, n = groups[0][1], 1
        while n < len(groups) and groups[n][0] <= last:
            last, n = max(last, groups[n][1]), n + 1
        table = pa.concat_tables(f.subset(row_group_ids=[g]).to_table(columns=_COLUMNS, filter=want) for _, _, f, g in groups[:n]).sort_by("sequence")
        groups = groups[n:]
        yield from table.add_column(0, "shard", pa.array([span.shard] * len(table), pa.int64())).cast(kinds).to_batches()


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.shards = options["path"], int(options.get("shards", "8"))

    def partitions(self):
        return [Span(k, -1, None) for k in range(self.shards)]

    def read(self, partition):
        return _read(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.shards = options["path"], int(options.get("shards", "8"))
        self._newest: dict[str, int] = {}

    def initialOffset(self):
        return {str(k): -1 for k in range(self.shards)}

    def latestOffset(self):
        out = {}
        for k in range(self.shards):
            newest = -1
            for f in _shard(self.path, k).get_fragments():
                # Files never change: a footer is opened once, not in every batch.
                if f.path not in self._newest:
                    self._newest[f.path] = max((most for _, most in _bounds(f)), default=-1)
                newest = max(newest, self._newest[f.path])
            out[str(k)] = newest
        return out

    def partitions(self, start, end):
        return [Span(int(k), start.get(k, -1), e) for k, e in end.items() if e > start.get(k, -1)]

    def read(self, partition):
        return _read(self.path, partition)


class FeedSource(DataSource):
    """``spark.read`` or ``readStream`` with format lodestack_feed; options path and shards."""

    @classmethod
    def name(cls):
        return "lodestack_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
