"""Toxicity by compression distance.

Two zstandard dictionaries hold running text, one of toxic documents and one of
ordinary ones. Windows of two neighbouring words are compressed with
either; where the toxic dictionary saves bytes over the ordinary one, the
window reads like toxic text. Thresholds over these savings are calibrated by
logistic regression on documents that the dictionaries in use did not hold.
Every text is compressed at every word.

Most of a toxic document is ordinary prose. The toxic dictionary therefore
keeps only passages that the toxic documents of other folds compress better
than ordinary text does, chosen in rounds by the same compression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rows import spread

#: Bounds of the fit: labelled rows of each class, characters of one of them, bytes of either dictionary.
FIT_ROWS = 3000
FIT_CHARS = 8192
TOXIC_BYTES, ORDINARY_BYTES = 1 << 18, 1 << 22
#: Words of a window.
WINDOW = 2
#: Bytes that a toxic passage must save to stay in the dictionary, round by round.
ROUNDS = (3, 4)
#: Words in a row that several documents hold are copies and teach nothing.
SHARED = 3
_FOLDS = 4
_STEPS = (1, 2, 3, 4, 5, 7)
#: Three blanks before each word, so that a match at its beginning is longer than one inside another word.
_GAP = b"   "
#: Ends each window, so that zstandard never finds it not worth compressing.
_RUN = b"\x02" * 64
_PARAMETERS = dict(window_log=23, hash_log=18, chain_log=20, search_log=5, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
#: ASCII that is no letter and no digit becomes a blank.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: What a worker remembers: 2 ** _SLOT_BITS savings of windows in 64 bits each, _VALUE_BITS of them the saving. A fit, whose models see few
#: texts, remembers 2 ** _FIT_SLOT_BITS.
_SLOT_BITS, _FIT_SLOT_BITS, _VALUE_BITS = 25, 20, 17
#: Words of neighbouring texts looked up together, as far as texts end there, and words looked up at once.
_WORDS = 1 << 17
_PIECE = 1 << 18


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_PLAIN).split()


class Windows(Sequence):
    """Every WINDOW neighbouring words as running text; at least one window."""

    def __init__(self, of: list[bytes]):
        self.words = of

    def __len__(self) -> int:
        return max(1, len(self.words) - WINDOW + 1)

    def __getitem__(self, i: int) -> bytes:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return _GAP + _GAP.join(self.words[i : i + WINDOW]) + _GAP


def windows(of: list[bytes]) -> Windows:
    return Windows(of)


class _Known:
    """Savings of windows already compressed, in bounded memory.

    A window's key is made of the 64-bit hashes of its two words. Its upper bits
    name a slot and the slot holds the other bits beside the saving, so that a
    window is taken for another only if all 64 bits agree. A window takes the
    slot from the one before it.
    """

    def __init__(self, bits: int = _SLOT_BITS):
        self.bits = bits
        self.slots = np.zeros(1 << bits, np.uint64)

    def saved(self, of: list[bytes], asked: np.ndarray, pair: tuple[zstandard.ZstdCompressor, ...]) -> np.ndarray:
        """Savings of the windows that begin at the words ``asked``."""
        word = np.fromiter(map(hash, of), np.int64, len(of)).view(np.uint64)
        key = word[asked] * 0x9E3779B97F4A7C15 + word[asked + 1]
        key, first, which = np.unique(key * 0xC2B2AE3D27D4EB4F, return_index=True, return_inverse=True)
        slot, rest = key >> 64 - self.bits, key & ((1 << 64 - self.bits) - 1)
        held = self.slots[slot]
        value, half = held & ((1 << _VALUE_BITS) - 1), 1 << _VALUE_BITS - 1
        out = value.astype(np.int64) - half
        new = np.flatnonzero((value == 0) | (held >> _VALUE_BITS != rest))  # 0: an empty slot
        if len(new):
            ended, order = _pairs(of, asked[first[new]])
            found = np.empty(len(new), np.int64)
            found[order] = _sizes(ended, pair[1]) - _sizes(ended, pair[0])
            out[new] = found
            fits = np.abs(found) < half
            new, found = new[fits], found[fits]
            self.slots[slot[new]] = rest[new] << _VALUE_BITS | (found + half).astype(np.uint64)
        return out[which]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=raw)


def _ended(data: bytes, sizes: np.ndarray) -> zstandard.BufferWithSegments:
    """Windows that lie one behind the other in ``data``, as zstandard takes them at once."""
    return zstandard.BufferWithSegments(data, np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype(np.uint64).tobytes())


def _pairs(of: list[bytes], begin: np.ndarray) -> tuple[zstandard.BufferWithSegments, np.ndarray]:
    """The windows that begin at some words, and their order: that of their
    first 16 bytes, since windows that begin alike meet the same places of the
    dictionaries, which are then in the processor's cache."""
    text = _GAP + _GAP.join(of) + _GAP
    sizes = np.fromiter(map(len, of), np.int64, len(of)) + len(_GAP)
    ends = np.cumsum(sizes) + len(_GAP)  # of each word with the blanks on both sides
    start, end = (ends - sizes)[begin] - len(_GAP), ends[begin + 1]
    at = np.frombuffer(text + bytes(16), np.uint8)
    head = at[(start + len(_GAP))[:, None] + np.arange(16)].view(">u8")
    order = np.lexsort((head[:, 1], head[:, 0]))
    start, end = start[order], end[order]
    data = _RUN.join([text[i:k] for i, k in zip(start.tolist(), end.tolist())]) + _RUN
    return _ended(data, end - start + len(_RUN)), order


def lengths(of: list[bytes], by: zstandard.ZstdCompressor) -> np.ndarray:
    """Compressed bytes of each window; equal ones are compressed once."""
    if not of:
        return np.zeros(0, np.int64)
    place = {w: i for i, w in enumerate(sorted(set(of)))}
    sizes = np.fromiter(map(len, place), np.int64, len(place)) + len(_RUN)
    return _sizes(_ended(_RUN.join(place) + _RUN, sizes), by)[[place[w] for w in of]]


def _sizes(ended: zstandard.BufferWithSegments, by: zstandard.ZstdCompressor) -> np.ndarray:
    if len(ended) < 8:
        return np.fromiter((len(by.compress(w)) for w in ended), np.int64, len(ended))
    return np.fromiter(map(len, by.multi_compress_to_buffer(ended, threads=1)), np.int64, len(ended))


def features(saved: np.ndarray) -> list[float]:
    """What the windows of a whole text save: their number's logarithm, how
    many save each step's bytes or more, as a count and as a share, the most
    and the mean."""
    n = len(saved)
    at = np.bincount(np.clip(saved, 0, _STEPS[-1]), minlength=_STEPS[-1] + 1)
    counts = np.cumsum(at[::-1])[::-1][list(_STEPS)]
    return [1.0, np.log(n), *np.log1p(counts), *np.sqrt(counts / n), max(int(saved.max()), 0), saved.mean()]


_WIDTH = 4 + 2 * len(_STEPS)
_NONE_CLEAR = np.array([30.0] + [0.0] * (_WIDTH - 1))


@dataclass
class ToxicityModel:
    """Both dictionaries (at most TOXIC_BYTES and ORDINARY_BYTES) and the
    calibration: the second row of weights, over all windows of a text. The
    first row once cleared texts by half of their windows; it clears none."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def __post_init__(self):
        self._pair = self._known = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def saved(self, of: Windows) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        return self.saved_together([of.words])[0]

    def saved_together(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The same of several texts: what they share is compressed once, and
        what is new is handed over at once."""
        if self._pair is None:
            self._pair, self._known = (compressor(self.toxic), compressor(self.ordinary)), self._known or _Known()
        out = [None if len(of) >= WINDOW else lengths(list(windows(of)), self._pair[1]) - lengths(list(windows(of)), self._pair[0]) for of in texts]
        long = [i for i, x in enumerate(out) if x is None]
        if long:
            of = list(chain.from_iterable(texts[i] for i in long))
            ends = np.cumsum([len(texts[i]) for i in long])
            asked = np.delete(np.arange(len(of)), ends - 1)  # no window begins at the last word of a text
            pieces = [asked[i : i + _PIECE] for i in range(0, len(asked), _PIECE)]
            found = np.concatenate([self._known.saved(of[b[0] : b[-1] + 2], b - b[0], self._pair) for b in pieces])
            for i, x in zip(long, np.split(found, (ends - np.arange(1, len(ends) + 1))[:-1])):
                out[i] = x
        return out

    def score(self, text: bytes | None) -> float:
        return self._chance(self.saved(windows(words(text))))

    def scores(self, texts: Iterator[bytes | None]) -> list[float]:
        """The scores of texts in order; some _WORDS words are held at once, fewer if they are long."""
        out, held, n = [], [], 0
        for text in texts:
            held.append(words(text))
            n += max(len(held[-1]), len(text or b"") >> 3)
            if n >= _WORDS:
                out += map(self._chance, self.saved_together(held))
                held, n = [], 0
        return [*out, *map(self._chance, self.saved_together(held))]

    def _chance(self, saved: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[1], features(saved)), -30, 30))))


def _fresh(texts: list[list[bytes]]) -> list[int]:
    """Texts that are no near copies of an earlier one, by four min-hashes of
    3-word shingles: a group of copies would be learnt many times over."""
    seen: set[tuple[int, int]] = set()
    rows = []
    for i, of in enumerate(texts):
        hashes = np.fromiter((zlib.crc32(b" ".join(of[k : k + 3])) for k in range(max(1, len(of) - 2))), np.uint64)
        keys = {(n, int((hashes * np.uint64(m) % np.uint64(4294967291)).min())) for n, m in enumerate((1, 40503, 2654435761, 2246822519))}
        if not keys & seen:
            rows.append(i)
        seen |= keys
    return rows


def _own(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Texts without the words of passages that several of them hold."""
    holder: dict[bytes, int] = {}
    for i, of in enumerate(texts):
        for k in range(len(of) - SHARED + 1):
            key = b" ".join(of[k : k + SHARED])
            if holder.setdefault(key, i) != i:
                holder[key] = -1
    out = []
    for of in texts:
        shared = np.zeros(len(of), bool)
        for k in range(len(of) - SHARED + 1):
            if holder[b" ".join(of[k : k + SHARED])] < 0:
                shared[k : k + SHARED] = True
        out.append([w for w, gone in zip(of, shared) if not gone])
    return out


def train(texts: list[bytes], toxic: list[int], sizes: tuple[int, int] | None = None) -> ToxicityModel:
    """Dictionaries and calibration from texts and their labels.

    sizes: documents of the ordinary and the toxic class where the texts were
        drawn; rows are weighed by them, so that a score of 0.5 means the same
        whatever share of a class was drawn.

    Dictionaries of the other folds' texts judge a fold's windows, both when
    passages are chosen and for the features that the regression sees.
    """
    split = [words(t) for t in texts]
    rows = _fresh(split)
    split, labels = [split[i] for i in rows], np.array([toxic[i] for i in rows])
    own = _own(split)
    fold = np.zeros(len(rows), np.int64)
    for label in (0, 1):
        fold[labels == label] = np.arange((labels == label).sum()) % _FOLDS
    parts = [*range(_FOLDS), None]

    def ordinary(k: int | None) -> bytes:
        """Texts of the other folds, as much as fits."""
        return b"\n".join(_GAP.join(own[i]) for i in np.flatnonzero(labels == 0) if fold[i] != k)[:ORDINARY_BYTES]

    plain = {k: ordinary(k) for k in parts}
    against = {k: compressor(plain[k]) for k in parts}
    found = [(fold[i], w) for i in np.flatnonzero(labels == 1) for w in windows(own[i])]
    place = np.array([k for k, _ in found])
    usual = np.zeros(len(found), np.int64)
    for k in range(_FOLDS):
        mine = np.flatnonzero(place == k)
        usual[mine] = lengths([found[i][1] for i in mine], against[k])
    chosen = np.random.default_rng(7).permutation(len(found))
    for least in ROUNDS:
        saved = np.zeros(len(found), np.int64)
        for k in range(_FOLDS):
            mine = np.flatnonzero(place == k)
            by = compressor(_passages(found, chosen, k))
            saved[mine] = usual[mine] - lengths([found[i][1] for i in mine], by)
        chosen = np.flatnonzero(saved >= least)
        chosen = chosen[np.argsort(saved[chosen], kind="stable")]
    x = np.zeros((len(rows), _WIDTH))
    for k in range(_FOLDS):
        model = ToxicityModel(_passages(found, chosen, k), plain[k], np.zeros((2, _WIDTH)))
        model._known = _Known(_FIT_SLOT_BITS)
        mine = np.flatnonzero(fold == k)
        for some in np.array_split(mine, len(mine) // 200 + 1):
            x[some] = [features(saved) for saved in model.saved_together([split[i] for i in some])] or 0
    drawn = [max(int(sum(1 for y in toxic if y == c)), 1) for c in (0, 1)]
    weight = np.array([sizes[c] / drawn[c] if sizes else 1.0 for c in (0, 1)])[labels]
    return ToxicityModel(_passages(found, chosen, None), plain[None], np.stack([_NONE_CLEAR, _logistic(x, labels, weight / weight.mean())]))


def _passages(found: list[tuple[int, bytes]], chosen: np.ndarray, fold: int | None) -> bytes:
    """The chosen windows of other folds as one text, the best last."""
    return b"".join(found[i][1] for i in chosen if found[i][0] != fold)[-TOXIC_BYTES:].rjust(16, b"\x01")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression on standardised columns, the first constant."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[0] = 0, 1
    used = spread > 1e-9
    z = np.where(used, (x - mean) / np.where(used, spread, 1), 0)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    out = np.where(used, w / np.where(used, spread, 1), 0)
    out[0] -= (out * mean).sum()
    return out


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[tuple[bytes, int]], tuple[int, int]]:
    """Texts and labels to learn from, and the learnable documents of each class.

    Of each class the ``rows`` labels whose ids have the smallest MD5 are
    drawn, each with FIT_CHARS characters at most from a place that the id's
    hash picks. Of rows that share a doc_id one teaches, the smallest by that
    text, so that no more rows reach the driver than were drawn.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.md5(F.col("doc_id").cast("string")).alias("_o")).distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    picked = known.filter("toxic = 1").orderBy("_o").limit(rows).unionAll(known.filter("toxic = 0").orderBy("_o").limit(rows))
    length = F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1
    piece = F.substring("text", (1 + F.pmod(F.xxhash64("_d"), length)).cast("int"), F.lit(FIT_CHARS))
    texts = docs.filter("text is not null").select(F.col("doc_id").alias("_d"), "text")
    found = texts.join(F.broadcast(picked), F.col("_d") == F.col("doc_id")).groupBy("_o", "toxic").agg(F.min(piece.cast("binary")).alias("text")).orderBy("_o", "toxic")
    return [(bytes(r["text"]), r["toxic"]) for r in found.collect()], (counts.get(0, 0), counts.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """A model from labelled documents; ``labels`` holds the rows one may learn
    from (doc_id, toxic). Null labels and texts teach nothing. Without both
    classes there is nothing to tell apart, and every score is about zero."""
    found, sizes = training_rows(docs, labels, rows)
    if len({y for _, y in found}) < 2:
        return ToxicityModel(b"\x01" * 16, b"\x01" * 16, np.array([[-30.0] + [0.0] * (_WIDTH - 1)] * 2))
    return train([t for t, _ in found], [y for _, y in found], sizes)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row: whole texts, window by window; a null text
    is an empty one; repeated rows are scored as often as they stand; other
    columns are not read; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = fit(docs, labels.filter(~held_out))
    out = score(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
