"""Stored form of content: a codec byte, then zstandard where it pays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

RAW, ZSTD = 0, 1
LEVEL, LEAST = 3, 256


def compress(content: bytes, level: int = LEVEL) -> bytes:
    """Raw under 256 bytes or where compression does not make it smaller."""
    if len(content) >= LEAST:
        small = zstandard.ZstdCompressor(level=level).compress(content)
        if len(small) < len(content):
            return bytes([ZSTD]) + small
    return bytes([RAW]) + content


def decompress(stored: bytes) -> bytes:
    """The content; an empty or unknown form is an error."""
    if not stored or stored[0] not in (RAW, ZSTD):
        raise ValueError("unknown stored form")
    return stored[1:] if stored[0] == RAW else zstandard.ZstdDecompressor().decompress(stored[1:])


def stored_sizes(rows: DataFrame) -> DataFrame:
    """(key, size, stored_size, intact) of rows (key, content)."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [x or b"" for x in batch.column(1).to_pylist()]
            stored = [compress(x) for x in content]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, content), pa.int64()), pa.array(map(len, stored), pa.int64()), pa.array([decompress(s) == x for s, x in zip(stored, content)])], ["key", "size", "stored_size", "intact"])

    return rows.select("key", "content").mapInArrow(run, f"key {kind}, size long, stored_size long, intact boolean")
