"""Near-duplicates by SimHash, checked by the shingles themselves.

Texts whose 64-bit fingerprints of five-word shingles differ in three bits or
fewer meet by deletion-variant signatures, as in ``simhash``. At a similarity of
0.8 fingerprints differ in ten bits or so, which no such index of useful size
reaches: pairs further apart meet in bands of minima and are filtered by
fingerprints of 128 bits. Whichever way a pair met, it is linked if the Jaccard
similarity of its shingle sets says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.llm.rows import packed, spread_join, unpacked
from lodestack.plans.storage import Scratch

WIDTH, SIMILARITY = 5, 0.8
SEED = 42
#: A pair at a similarity of 0.8 shares at least one band with probability 1 - (1 - 0.8^8)^32 = 0.997.
BANDS, ROWS = 32, 8
#: Differing bits of 128 up to which shingles are compared: at 0.8 the mean is 19 and the deviation 4.
FAR_BITS = 36
#: Rows of a band key that are compared as one block, and pairs verified at once.
BLOCK_ROWS, _AT_ONCE = 512, 64
#: Shingles hashed at once, and parts that the links of one document are dealt to.
_BLOCK, _SALTS = 1 << 12, 16
_A = np.random.default_rng(SEED).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_B = np.random.default_rng(SEED + 1).integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted; words and shingles are
    those of ``simhash.fingerprint``."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    flat = b" ".join(words)
    found = (flat[i:j] for i, j in zip(starts.tolist(), ends[len(words) - n :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, n))


def describe(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, fingerprint as two longs) of a shingle set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    counts = np.zeros(128, np.int64)
    more = hashes * np.uint64(0x9E3779B97F4A7C15)
    more = (more ^ (more >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    low = (more >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(hashes), _BLOCK):
        part = low[i : i + _BLOCK, None] * _A + _B
        part ^= part >> np.uint32(15)
        least = np.minimum(least, (part * np.uint32(0x2C1B3C6D)).min(axis=0))
        bits = np.unpackbits(np.stack([hashes[i : i + _BLOCK], more[i : i + _BLOCK]], axis=1).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64), np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)


def _described(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
                sets = [shingles(x.as_py(), width) for x in texts]
                keys, prints = zip(*map(describe, sets))
                nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
                grams = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
                columns = [ids, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([k.tolist() for k in keys], pa.list_(pa.int64())), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(grams, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "keys", "s0", "s1", "grams"])

    return run


def _apart(s0: np.ndarray, s1: np.ndarray, u: int) -> np.ndarray:
    return np.bitwise_count(s0 ^ s0[u]).astype(np.int64) + np.bitwise_count(s1 ^ s1[u])


def _first_pairs(node, s0, s1, part) -> list[tuple[np.ndarray, np.ndarray]]:
    """The run's first row with all others that are near it."""
    hit = np.flatnonzero(_apart(s0, s1, 0)[1:] <= FAR_BITS) + 1
    return [(np.zeros(len(hit), np.int64), hit)]


def _pairs(choose: Callable) -> Callable:
    """Candidate pairs among rows (key, node, s0, s1, part) sorted by key and
    node; a run may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        for columns in chain(([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches), [None]):
            rows = held if columns is None else [np.concatenate(x) for x in zip(held, columns)]
            key = rows[0]
            cut = len(key) if columns is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            held, rows = [x[cut:] for x in rows], [x[:cut] for x in rows]
            if not cut:
                continue
            key, node = rows[0], rows[1]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.concatenate((starts, [cut])))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for start, size in zip(starts[sizes > 1], sizes[sizes > 1]):
                here = [x[start : start + size] for x in rows[1:]]
                for i, j in choose(here[0], here[1].view(np.uint64), here[2].view(np.uint64), here[3]):
                    a.append(here[0][i])
                    b.append(here[0][j])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _alike(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _jaccard(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Similarities of one sorted set to others."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat(one[place] == flat, np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return both / (len(one) + sizes - both)


def block_links(rows: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links that join what is alike in one block, or in one pair of blocks.

    Rows of one part are joined already; a pair that shares several band keys
    is looked at under the first of them. A row's candidates are verified from
    the nearest on, and those of a part that it has joined are not verified.
    """
    column = lambda c: rows.column(c).to_numpy()
    node, s0, s1, side = column("node"), column("s0").view(np.uint64), column("s1").view(np.uint64), column("side")
    part = np.unique(column("part"), return_inverse=True)[1]
    if len(part) < 2 or part.max() == 0:
        return []
    band, within = rows.column("band")[0].as_py(), rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    keys = rows.column("keys").combine_chunks().values.to_numpy().reshape(-1, BANDS)
    grams = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("grams")]
    walked = part != np.bincount(part).argmax()
    done = np.zeros(len(part), bool)
    links = []
    for u in np.flatnonzero(walked):
        done[u] = True
        apart = _apart(s0, s1, u)
        hit = np.flatnonzero((part != part[u]) & (apart <= FAR_BITS) & ~done & (within | (side != side[u])))
        hit = hit[(keys[hit] == keys[u]).argmax(axis=1) == band]
        hit = hit[np.argsort(apart[hit], kind="stable")]
        while len(hit):
            some, hit = hit[:_AT_ONCE], hit[_AT_ONCE:]
            for v in some[_jaccard(grams[u], [grams[k] for k in some]) >= similarity - 1e-9]:
                if part[v] != part[u]:
                    links.append((int(node[u]), int(node[v])))
                    part[part == part[v]] = part[u]
            hit = hit[part[hit] != part[u]]
    return links


def _settled(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held) if held else None
            if rows is None or not rows.num_rows:
                continue
            group = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.flatnonzero(np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(axis=0))))
            ends = [*starts[1:], rows.num_rows]
            whole = len(starts) if batch is None else len(starts) - 1
            links = [x for i, j in zip(starts[:whole], ends[:whole]) for x in block_links(rows.slice(i, j - i), similarity)]
            held = [] if batch is None else rows.slice(starts[-1]).to_batches()
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def dealt_blocks(bands: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (key, node, part, ...) of band keys that hold more than one part,
    dealt to pairs of blocks (i, j) of ``block_rows`` rows: a key of one block
    goes there once, a larger one to as many pairs as every two of its rows
    need to meet in one."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("_n"), F.min("part").alias("_a"), F.max("part").alias("_z")).filter("_a <> _z")
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    rows = spread_join(bands, sizes.select("key", blocks.alias("_k")), ["key"], F.col("node"))
    b = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    up = F.transform(F.sequence(b, F.col("_k") - 1), lambda j: F.struct(b.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    down = F.when(b > 0, F.transform(F.sequence(F.lit(0), b - 1), lambda i: F.struct(i.alias("i"), b.alias("j"), F.lit(1).alias("side"))))
    pairs = F.concat(up, F.coalesce(down, F.array().cast("array<struct<i:int,j:int,side:int>>")))
    return rows.withColumn("_p", F.explode(pairs)).select("*", "_p.i", "_p.j", "_p.side").drop("_p", "_k")


def verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets in ``grams`` (node, grams) are alike.

    A document of a large group can stand in many pairs: those are dealt to
    several parts, each with its own copy of the document's shingles.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)))
    hubs = dealt.select("a", "salt").distinct().join(grams.withColumnsRenamed({"node": "a", "grams": "ga"}), "a")
    full = dealt.join(grams.withColumnsRenamed({"node": "b", "grams": "gb"}), "b").join(hubs, ["a", "salt"])
    return full.select("a", "b", "ga", "gb").mapInArrow(_alike(similarity), "a long, b long")


def near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes by their SimHash fingerprint s0 alone. Nodes of
    one fingerprint meet its smallest node, and these meet by variants."""
    from lodestack.llm import simhash  # which imports this module

    classes = nodes.groupBy("s0").agg(F.min("node").alias("rep"))
    equal = spread_join(nodes.select("s0", "node"), classes, ["s0"], F.col("node")).filter("node <> rep")
    pairs = equal.select(F.col("rep").alias("a"), F.col("node").alias("b")).unionAll(simhash.linked(classes.select(F.col("s0").alias("fp"), "rep")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, node, component_id) for every row of ``docs``; the component of
    a null doc_id is null.

    Rows of equal shingle sets are one node. Nodes link at a Jaccard similarity
    of ``similarity`` or more; component_id is the smallest doc_id reachable.
    Fingerprints within three bits meet by their variants; besides, every band
    joins its rows to its first one. Bands whose rows are then
    still apart are compared in blocks that hold the shingles: every pair that
    shares a band is looked at, but only links that join come out, so the rows
    of a large group grow with its size and not with its pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    rows = scratch.table(texts.mapInArrow(_described(width), "doc_id long, node long, keys array<long>, s0 long, s1 long, grams binary"), "described")
    nodes = scratch.table(rows.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("keys").alias("keys")), "nodes")

    def shingled(ends: DataFrame) -> DataFrame:
        """(node, grams) of some nodes, from the row with the smallest doc_id."""
        one = rows.select("node", "doc_id", "grams").join(nodes.select("node", F.col("least").alias("doc_id")).join(ends, "node", "left_semi"), ["node", "doc_id"]).dropDuplicates(["node"])
        return scratch.table(one.select("node", "grams"), "grams")

    bands = nodes.select("node", "s0", "s1", F.explode("keys").alias("key"))
    met = bands.withColumn("part", F.col("node")).select("key", "node", "s0", "s1", "part").repartition(parts, "key").sortWithinPartitions("key", "node")
    first = scratch.table(near_prints(nodes).unionAll(met.mapInArrow(_pairs(_first_pairs), "a long, b long")).distinct(), "pairs")
    ends = first.select(F.col("a").alias("node")).unionAll(first.select(F.col("b").alias("node"))).distinct()
    links = scratch.table(verified(first, shingled(ends), similarity), "links")
    found = scratch.table(connected_components(links, scratch), "components")
    parted = nodes.join(found, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component", "least")
    split = scratch.table(dealt_blocks(parted.select("node", "s0", "s1", "part", F.posexplode("keys").alias("band", "key")), block_rows), "split")
    if not split.isEmpty():
        grams = shingled(split.select("node").distinct()).join(nodes.select("node", "keys"), "node")
        blocks = split.join(grams, "node").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = blocks.select("key", "i", "j", "side", "band", "node", "s0", "s1", "part", "keys", "grams").mapInArrow(_settled(similarity), "a long, b long")
        links = links.unionAll(scratch.table(more.distinct(), "links"))
        found = scratch.table(connected_components(links, scratch), "components")
    named = scratch.table(nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.select("doc_id", "node").join(named.join(least, "component").select("node", "component_id"), "node", "left")
    return out.select("doc_id", "node", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents of ``docs`` without near-duplicates: of each component the
    document with the smallest doc_id, once. Rows with a null doc_id belong to
    no component and stay."""
    kept = near_duplicates(docs, width, similarity).filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    one = packed(docs, F.col("doc_id").alias("_did")).join(kept, F.col("_did") == F.col("_id")).dropDuplicates(["_did"])
    return unpacked(one, docs.columns).unionAll(docs.filter("doc_id is null"))
