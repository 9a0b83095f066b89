"""Content-defined chunking of byte strings with a gear hash.

The fingerprint of a position covers the 64 bytes up to it; a chunk ends where
its masked bits are zero, under a stricter mask before the average size and a
looser one after it. The numpy kernel sums whole windows by doubling and treats
the positions whose window would reach before the chunk's start one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GEAR_DOMAIN = b"lodestack.cdc.gear.v1"
_WINDOW = 64


@lru_cache(maxsize=4)
def gear_table(domain: bytes = GEAR_DOMAIN) -> np.ndarray:
    """256 numbers of 64 bits, from a digest of the domain and the byte."""
    return np.array([int.from_bytes(hashlib.sha256(domain + bytes([i])).digest()[:8], "big") for i in range(256)], np.uint64)


@dataclass(frozen=True)
class ChunkParams:
    """Sizes in bytes and the bits that must be zero before and after the average."""

    smallest: int
    average: int
    largest: int
    strict: int
    loose: int

    @classmethod
    def for_average(cls, average: int) -> ChunkParams:
        """A quarter to four times the average, a power of two of 8 or more."""
        bits = average.bit_length() - 1
        if average < 8 or 1 << bits != average:
            raise ValueError("the average must be a power of two, 8 at least")
        high = lambda n: ((1 << n) - 1) << (64 - n)
        return cls(average // 4, average, average * 4, high(bits + 2), high(bits - 2))


PRODUCTION = ChunkParams.for_average(1 << 20)


def windows(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each position's fingerprint over its whole window, by doubling."""
    h = table[data]
    k = 1
    while k < _WINDOW:
        h[k:] += h[:-k] << np.uint64(k)
        k *= 2
    return h


def cuts(data: bytes, params: ChunkParams, table: np.ndarray | None = None) -> list[int]:
    """Chunk ends of a byte string; none for an empty one.

    Positions that either mask accepts are found once for the whole string. Near
    a chunk's first possible end the window reaches back before the place where
    the hash begins anew: there the part before it is taken off again.
    """
    table = gear_table() if table is None else table
    raw, n = np.frombuffer(data, np.uint8), len(data)
    strict, loose, zero = np.uint64(params.strict), np.uint64(params.loose), np.uint64(0)
    full = windows(raw, table) if n > params.smallest else np.empty(0, np.uint64)
    at = {mask: np.flatnonzero((full & mask) == zero) for mask in (strict, loose)}
    shift = np.arange(1, _WINDOW, dtype=np.uint64)
    ends, start = [], 0
    while start < n:
        stop = min(start + params.largest, n)
        if stop - start > params.smallest:
            low = start + params.smallest
            normal, near = min(start + params.average, stop), min(low + _WINDOW - 1, stop)
            head = full[low:near] - (full[low - 1] << shift[: near - low])
            stop = _first(head, at, low, near, ((low, normal, strict), (normal, stop, loose)), stop)
        ends.append(stop)
        start = stop
    return ends


def _first(head, at, low, near, spans, stop) -> int:
    """The first accepted position of the spans (first, last, mask)."""
    for first, last, mask in spans:
        if first < min(last, near):
            found = np.flatnonzero((head[first - low : min(last, near) - low] & mask) == 0)
            if len(found):
                return first + int(found[0])
        k = int(np.searchsorted(at[mask], max(first, near)))
        if k < len(at[mask]) and at[mask][k] < last:
            return int(at[mask][k])
    return stop


def chunk_stream(read: Callable[[int], bytes], params: ChunkParams, read_size: int | None = None) -> Iterator[bytes]:
    """The chunks of a stream (``read`` of a size, empty at its end), the same
    as ``cuts`` makes of all its bytes (C03). An end never lies beyond the
    largest chunk, so no more than that and one read is held."""
    size = read_size or 4 * params.largest
    held, more = b"", True
    while held or more:
        while more and len(held) < params.largest:
            block = read(size)
            more, held = bool(block), held + block
        if held:
            end = cuts(held[: params.largest], params)[0]
            yield held[:end]
            held = held[end:]


def chunk(rows: DataFrame, key: str, content: str, params: ChunkParams = PRODUCTION) -> DataFrame:
    """(key, ordinal, offset, length, data) of the chunks of each row's bytes.

    Null or empty content has no chunk (S03); the chunks of a row follow each
    other and make up its content.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if not data:
                    continue
                ends = cuts(data, params)
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(ends), batch.column(0).type), pa.array(range(len(ends)), pa.int32()), pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends)], pa.int64()), pa.array([data[a:b] for a, b in zip(starts, ends)], pa.binary())], [key, "ordinal", "offset", "length", "data"])

    from pyspark.sql import functions as F

    return rows.select(key, F.col(content).cast("binary").alias(content)).mapInArrow(run, f"`{key}` {kind}, ordinal int, offset long, length long, data binary")
