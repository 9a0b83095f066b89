"""Language identification by compression.

A text is compressed block by block with each language's zstandard raw-content
dictionary; the language whose dictionary gives the fewest bytes is the answer,
and a narrow margin is reported as a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rows import spread

UNKNOWN = "und"
#: Bounds of the fit: texts of each language, characters of one, bytes of a dictionary.
FIT_ROWS = 400
FIT_CHARS = 600
DICTIONARY_BYTES = 112_640
BLOCK = 2048
#: The fast strategy with a target length stores literals as they are: what a
#: dictionary saves is then what it matches.
_PARAMETERS = dict(window_log=17, hash_log=17, chain_log=16, search_log=1, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0)
#: Ends each block, so that zstandard never finds it not worth compressing.
_RUN = b"\x02" * 64
#: A letter is any code point of Unicode's category L.
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    """One raw-content dictionary for each language.

    margin: an answer is rejected if the runner-up needs less than this share
        of bytes more, and less than ``margin_bytes`` more.
    """

    dictionaries: dict[str, bytes]
    margin: float = 0.01
    margin_bytes: int = 4

    def __post_init__(self):
        self._compressors: list[zstandard.ZstdCompressor] | None = None
        self.languages = sorted(self.dictionaries)

    def __getstate__(self):
        return self.dictionaries, self.margin, self.margin_bytes

    def __setstate__(self, state):
        self.__init__(*state)

    def lengths(self, text: str) -> np.ndarray:
        """Bytes of the whole text under each dictionary, in language order."""
        if self._compressors is None:
            self._compressors = []
            parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
            for name in self.languages:
                own = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=parameters)
                self._compressors.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=own))
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] + _RUN for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self._compressors])

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow to trust.

        Null texts and texts without a letter are ``und`` with score 0; ties go
        to the language that sorts first. The score is the winner's share when
        each byte saved doubles a language's odds.
        """
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.lengths(text)
        best = int(sizes.argmin())
        share = float(1 / np.exp2(-np.minimum(sizes - sizes[best], 60)).sum())
        gap = int(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else self.margin_bytes
        return self.languages[best], share, gap < self.margin_bytes and gap < self.margin * sizes[best] or gap == 0


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
    """Dictionaries from rows (doc_id, text, lang) that one may learn from.

    Rows with a null doc_id, text or language teach nothing; other columns are
    not read; without any row the model has no language and answers UNKNOWN.
    A dictionary holds at most DICTIONARY_BYTES, that is some 190 pieces of full length. Of each language about ``rows``
    documents, those whose hash is smallest, give FIT_CHARS characters from a
    place that the hash picks; counts come first, so that a language of many
    documents is thinned before anything is gathered.
    """
    known = docs.filter("doc_id is not null and text is not null and lang is not null").select("doc_id", "lang", "text")
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 12)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel({})
    limit = F.element_at(F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, min(1.0, 1.3 * rows / c) * 2.0**52)]), F.col("lang"))
    length = F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1
    piece = F.substring("text", (1 + F.pmod(F.xxhash64("doc_id", "lang"), length)).cast("int"), F.lit(FIT_CHARS))
    texts: dict[str, list[bytes]] = {}
    for r in known.filter(order <= limit).select("lang", order.alias("o"), piece.alias("text")).orderBy("lang", "o", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"].lower().encode("utf-8", "surrogatepass"))
    return LanguageModel({name: b"\n".join(found[: 2 * rows])[-DICTIONARY_BYTES:] for name, found in texts.items()})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, from whole texts; only
    the text is read, so columns of any other name cannot clash. Repeated rows
    are classified as often as they stand; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.classify(x.as_py()) for x in batch.column(1)]
            name, share, narrow = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(narrow, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = fit(docs.filter(~held_out))  # a null doc_id teaches nothing
    return identify(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
