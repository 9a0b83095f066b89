"""Byte-level BPE encoding and decoding with a two-tier lookup.

Spark's own regular expressions cut texts into pre-tokens; Arrow hands them
over in columns. Tier one is a minimal perfect hash over the vocabulary, which
resolves the different pre-tokens of a chunk at once; tier two merges the rest
with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.rows import spread

#: Pre-tokens resolved at once; bounds what one chunk holds.
CHUNK = 400_000
#: Merged pre-tokens that a worker remembers; more are merged anew.
REMEMBERED = 600_000
_EMPTY = hashlib.sha256(b"").hexdigest()


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: keys fall
    into buckets, and each bucket gets the first displacement that puts all of
    its keys on free slots; buckets of one key name their slot."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        hashes = self.hashes(keys)
        bucket = self._bucket(hashes)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        free = np.ones(self.n, bool)
        for group in sorted(groups, key=len, reverse=True):
            if len(group) == 1:
                break
            for d in range(1, 1 << 20, 128):
                slots = np.sort(self._place(hashes[group], np.arange(d, d + 128)[:, None]))
                good = np.flatnonzero(free[slots].all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1))
                if len(good):
                    shift = d + good[0]
                    self.shift[bucket[group[0]]] = shift
                    slots = self._place(hashes[group], np.full(1, shift))
                    free[slots] = False
                    self.key_at[slots] = group
                    break
            else:
                raise ValueError("keys are not different")
        left = np.flatnonzero(free)
        ones = [g[0] for g in groups if len(g) == 1]
        for slot, key in zip(left, ones):
            self.shift[bucket[key]] = -1 - slot
            self.key_at[slot] = key

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _place(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Each hash's slot under a displacement, by a multiplicative mix."""
        mixed = (hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shift[self._bucket(hashes)]
        return np.where(shift < 0, -1 - shift, self._place(hashes, np.maximum(shift, 0)))


class ByteBPE:
    """Tables of one vocabulary; small, and sent to each worker once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = np.array([ranks[t] for t in self.tokens], np.int64)
        self.text_of = {ranks[t]: t for t in self.tokens}
        self.hash = PerfectHash(self.tokens)
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.memory: dict[bytes, bytes] = {}

    @classmethod
    def from_rank_lines(cls, lines: Iterable[bytes], pattern: str) -> ByteBPE:
        """From lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always merge the pair of lowest rank, the
        leftmost of equals, until no pair is in the vocabulary."""
        pairs = self.pairs
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != top >> 32:
                continue  # one side has been merged since
            ids[i], ids[j] = top >> 32, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(ids[i] << 32 | ids[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | ids[i])) is not None:
                heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def resolve(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each different pre-token."""
        slots = self.hash.slots(PerfectHash.hashes(words))
        keys = self.hash.key_at[slots]
        packed = self.ids[keys].astype("<u4").tobytes()
        tokens, memory = self.tokens, self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        out = []
        for i, (word, key) in enumerate(zip(words, keys.tolist())):
            if tokens[key] == word:
                out.append(packed[4 * i : 4 * i + 4])
            elif (ids := memory.get(word)) is not None:
                out.append(ids)
            else:
                memory[word] = ids = np.array(self.merge(word), "<u4").tobytes()
                out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.tolist()))

    def cut(self, text: str) -> list[str]:
        """Pre-tokens by the Python library, where Spark's older Unicode tables may differ."""
        return regex.findall(self.pattern, text)

    def encode_lists(self, column: pa.ListArray, text: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row, from its pre-tokens; chunk by chunk."""
        offsets = column.offsets.to_numpy()
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
            flat = column.values.slice(offsets[row], offsets[stop] - offsets[row]).dictionary_encode()
            words = flat.dictionary.cast(pa.binary()).to_pylist()
            index = flat.indices.to_numpy()
            bounds = offsets[row : stop + 1] - offsets[row]
            again = self._newer(flat.dictionary, index, bounds)
            packed = self.resolve(words)
            pool = np.frombuffer(b"".join(packed), "<u4")
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            starts = np.cumsum(sizes) - sizes
            own = sizes[index]
            ends = np.cumsum(own)
            ids = pool[np.repeat(starts[index] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
            cuts = np.concatenate(([0], ends))[bounds]
            for k in range(stop - row):
                if k in again:
                    yield np.frombuffer(b"".join(self.resolve([w.encode() for w in self.cut(text[row + k].as_py())])), "<u4")
                else:
                    yield ids[cuts[k] : cuts[k + 1]]
            row = stop

    def _newer(self, words: pa.Array, index: np.ndarray, bounds: np.ndarray) -> set[int]:
        """Rows with a pre-token that takes a letter or digit of a newer Unicode for a symbol."""
        wide = pc.filter(words, pc.invert(pc.string_is_ascii(words)))
        mixed = [w for w in wide.to_pylist() if not w.lstrip(" ").isalpha() and len(self.cut(w)) != 1]
        if not mixed:
            return set()
        bad = np.flatnonzero(np.isin(index, pc.index_in(pa.array(mixed), words).to_numpy()))
        return set((np.searchsorted(bounds, bad, side="right") - 1).tolist())


def load(spark: SparkSession, path: str, pattern: str):
    """The vocabulary of a rank file, as a broadcast; about 50,000 tokens, read on the driver."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(ByteBPE.from_rank_lines(file, pattern))


def pretokens(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, text, words) of every row; white space and classes are Unicode's."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)).alias("words"))


def encode(docs: DataFrame, vocabulary, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text).

    A null text is empty and has no ids; an empty table gives an empty result;
    repeated rows are encoded as often as they stand; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [pa.array(x.astype(np.int32)) for x in vocabulary.value.encode_lists(batch.column(2), batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    return pretokens(docs, pattern).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, content) of rows (doc_id, ids): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [vocabulary.value.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, vocabulary, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one
    pass over whole texts, so that ids need not be written in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe, n, a, b = vocabulary.value, [], [], []
            for ids in bpe.encode_lists(batch.column(2), batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pretokens(docs, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    vocabulary = load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(docs, vocabulary, public_tokenizers.PATTERN)
