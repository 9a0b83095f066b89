"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three are cut into two segments
of 32 bits; one of the two then differs in at most one bit. Each segment is
indexed 32 times with one bit wiped out, so the pair meets in an equality on
one such variant and is verified on the whole fingerprint.

That is the contract of ``query`` (``near_fingerprints``). ``near_duplicates``
and ``deduplicate``, which the pipeline uses, find links the same way over
five-word shingles, check them by the shingles' Jaccard similarity and go on to
pairs whose fingerprints lie further apart; they are in ``lodestack.llm.similar``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.llm.similar import deduplicate, near_duplicates  # noqa: F401
from lodestack.llm.rows import spread
from lodestack.plans.storage import Scratch

DISTANCE = 3
SEED = 42
_SEGMENT = 32
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15
#: Runs above this size are cut once more, by a byte of the other segment.
_LARGE_RUN = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit integer.

    A-Z are lower-cased; words are runs of anything but ASCII white space;
    shingles of ``width`` words count as often as they occur; a shorter text
    is one shingle; a text without words has fingerprint zero. A bit is set if
    more than half of the shingles' XXH64 have it.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(words) - width] + 1))
        flat = b" ".join(words)
        shingles = (flat[i:j] for i, j in zip(starts.tolist(), ends[width - 1 :].tolist()))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = np.ascontiguousarray(hashes[i : i + _BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, from whole texts; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fingerprint(x.as_py(), width) for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64(), size=batch.num_rows)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def signatures(classes: DataFrame) -> DataFrame:
    """(key, fp, rep): 64 one-wildcard variants of each fingerprint.

    ``key`` holds the wiped bit's number (0 to 63) over the segment's other bits.
    """
    segment = F.when(F.col("bit") < _SEGMENT, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", _SEGMENT))
    wiped = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit % 32)")))
    rows = classes.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return rows.select(F.expr("shiftleft(cast(bit as bigint), 32)").bitwiseOR(wiped).alias("key"), "fp", "rep")


def _own(differ: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
    """Whether a pair with these differing bits belongs to the variant ``bit``.

    A pair meets in many variants; it is linked in one: that of its only
    differing bit in the first segment that has at most one, or the segment's
    variant 0 if the segments are equal.
    """
    low, high = differ & np.uint64(0xFFFFFFFF), differ >> np.uint64(_SEGMENT)
    bit = np.asarray(bit, np.uint64)
    first, wiped = bit < _SEGMENT, bit % np.uint64(_SEGMENT)
    here = np.where(first, low, high)
    own = (here == np.uint64(1) << wiped) | ((here == 0) & (wiped == 0))
    return own & (first | (np.bitwise_count(low) > 1))


def link_run(fps: np.ndarray, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is connected in one run of fingerprints sharing a
    variant: index pairs, fewer than the run is long."""
    if len(fps) > _LARGE_RUN:
        return _link_large(fps, bit)
    out, stack, todo = [], [], np.arange(len(fps))
    while len(stack) or len(todo):
        if not stack:
            stack, todo = [int(todo[0])], todo[1:]
        u = stack.pop()
        differ = fps[todo] ^ fps[u]
        hit = (np.bitwise_count(differ) <= DISTANCE) & _own(differ, bit)
        found, todo = todo[hit], todo[~hit]
        if len(found):
            out.append((np.full(len(found), u), found))
            stack.extend(found.tolist())
        if not len(todo):
            break
    return out


def _link_large(fps: np.ndarray, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for a large run. The other segment differs in three bits at
    most, so one of its four bytes is equal: each byte groups the run anew."""
    other = (fps >> np.uint64(_SEGMENT)) if bit < _SEGMENT else fps & np.uint64(0xFFFFFFFF)
    out = []
    for shift in (0, 8, 16, 24):
        byte = (other >> np.uint64(shift)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
            if len(group) <= _LARGE_RUN or len(group) < len(fps):
                out += [(group[a], group[b]) for a, b in link_run(fps[group], bit)]
            else:
                out += [(group[a], group[b]) for a, b in _scan(fps[group], bit)]
    return out


def _scan(fps: np.ndarray, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every link of a run, one row of it at a time."""
    out = []
    for u in range(len(fps) - 1):
        differ = fps[u + 1 :] ^ fps[u]
        hit = np.flatnonzero((np.bitwise_count(differ) <= DISTANCE) & _own(differ, bit))
        if len(hit):
            out.append((np.full(len(hit), u), hit + u + 1))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by key; a run may span batches."""
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    for columns in chain(([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches), [None]):
        if columns is None:
            key, fp, rep = held
            cut = len(key)
        else:
            key, fp, rep = (np.concatenate(x) for x in zip(held, columns))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        held = [key[cut:], fp[cut:], rep[cut:]]
        key, fp, rep = key[:cut], fp[:cut].view(np.uint64), rep[:cut]
        if not cut:
            continue
        bit = key >> 32
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [cut])))
        two = starts[sizes == 2]
        differ = fp[two] ^ fp[two + 1]
        two = two[(np.bitwise_count(differ) <= DISTANCE) & _own(differ, bit[two])]
        a, b = [rep[two]], [rep[two + 1]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = rep[start : start + size]
            for i, j in link_run(fp[start : start + size], int(bit[start])):
                a.append(own[i])
                b.append(own[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def linked(classes: DataFrame) -> DataFrame:
    """(a, b): links that join the classes (fp, rep) whose fingerprints differ
    in three bits or fewer, through equal variants."""
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = signatures(classes).repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "a long, b long")


def near_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Needs doc_id and text. Equal fingerprints are one class from the start;
    classes link at three differing bits or fewer; component_id is the
    smallest doc_id reachable, the row's own included. Rows with a null doc_id
    keep a fingerprint and get no component. Repeated rows count as often as
    they stand; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.table(fingerprints(docs, width), "fingerprints")
    classes = scratch.table(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(linked(classes), scratch)
    named = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = near_fingerprints(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
