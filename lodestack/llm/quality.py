"""Quality rules: word statistics of each text and cross-document line frequency.

Built from DataFrame functions only. Texts are not shuffled: line hashes go
out, and the verdict comes back by the document's key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rows import ROW, packed, spread, spread_join, unpacked
from lodestack.plans.storage import Scratch

SYMBOLS = r"[#*$%&|<>]"
_BLANKS = " \t\n\x0b\f\r"
#: A packed window is 40 bits of hash over 24 bits of position.
_POSITION_BITS = 24
_POSITION_MASK = (1 << _POSITION_BITS) - 1
#: Two documents that differ in a ninth of what they hold have a similarity of 0.8.
OWN_PART = 9


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the rules.

    max_docs: a line that more than this many distinct documents of one host
        hold is boilerplate.
    min_line_chars: shorter lines are never boilerplate; by default every line counts.
    max_removed_percent: a document that loses a larger share of its lines'
        characters with its boilerplate lines is depleted.
    min_words, max_repeat_percent: the base rules.
    """

    max_docs: int = 20
    min_line_chars: int = 1
    max_removed_percent: int = 50
    min_words: int = 50
    max_repeat_percent: int = 50


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _long_hash(text: Column) -> Column:
    """60 bits of a text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def normalised(line: Column) -> Column:
    """A line trimmed of white space and lower-cased."""
    return F.lower(F.trim(line, F.lit(_BLANKS)))


def document_key() -> list[Column]:
    """A document is its id and its text; rows equal in both are one document."""
    return [F.col("doc_id").alias("_id"), F.xxhash64("text", "source").alias("_tx")]


def document_stats(docs: DataFrame, limits: QualityLimits = QualityLimits(), without: tuple[str, ...] = ()) -> DataFrame:
    """(_row, _id, _tx, _host, STATS, _lines) of every row: the row itself less
    ``without``, its key and host, its statistics, and (h, chars) of its
    non-blank lines in order.

    A null text has no word and no line, so every count is 0 and it fails.
    Columns named like a statistic are replaced.

    Words inside repeated 3-word windows: each window becomes a hash packed
    with its position, one sort of longs brings equal hashes together, and
    neighbours of equal hash are compared word by word. Texts of more than
    2^24 words skip the hash and sort the windows themselves.
    """
    out = packed(docs, F.col("text"), *document_key(), F.coalesce("source", F.lit("")).alias("_host"), without=(*STATS, *without))
    # Every array used twice is a column of its own: Catalyst then computes it once.
    out = out.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    flat = F.col("_text")
    for blank in _BLANKS[1:]:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    out = out.withColumn("_flat", flat)
    # Single blanks between words, the usual case, need no regular expression.
    plain = ~F.contains("_flat", F.lit("  ")) & ~F.startswith("_flat", F.lit(" ")) & ~F.endswith("_flat", F.lit(" ")) & (F.col("_flat") != "")
    out = out.withColumn("_w", F.when(plain, F.split("_flat", " ")).otherwise(F.filter(F.split("_flat", " +"), lambda w: w != "")))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("_raw", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windowed = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)).bitwiseAND(F.lit(~_POSITION_MASK)).bitwiseOR(i.cast("long")))
    out = out.withColumn("_p", F.when(F.col("n_words") <= _POSITION_MASK, F.sort_array(windowed)).otherwise(F.array().cast("array<bigint>")))
    word = lambda p, k: F.get(F.col("_w"), (p.bitwiseAND(F.lit(_POSITION_MASK)) + k).cast("int"))
    same = lambda a, b: (F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)) & (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))
    # An `or` with a null side is null unless the other side holds, and filter takes null as false.
    twice = F.filter("_p", lambda x, i: same(x, F.get(F.col("_p"), i + 1)) | same(x, F.when(i > 0, F.get(F.col("_p"), i - 1))))
    found = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.lit(_POSITION_MASK))))
    windows = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)).alias("s"), i.cast("long").alias("p")))
    out = out.withColumn("_s", F.when(F.col("n_words") > _POSITION_MASK, F.sort_array(windows)))
    said = lambda i: F.get(F.col("_s"), i)["s"]
    long = F.filter("_s", lambda x, i: (x["s"] == said(i + 1)) | (x["s"] == F.when(i > 0, said(i - 1))))
    out = out.withColumn("_at", F.when(F.col("_s").isNull(), found).otherwise(F.sort_array(F.transform(long, lambda x: x["p"]))))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.size(F.split("_text", SYMBOLS, -1)) - 1).cast("long"),
            "n_dup_lines": (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long"),
            "n_repeat_words": F.when(F.size("_at") > 0, covered).otherwise(F.lit(0).cast("long")),
            "_lines": F.transform(F.transform("_raw", normalised), lambda x: F.struct(_long_hash(x).alias("h"), F.length(x).cast("long").alias("chars"))),
        }
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(ROW, "_id", "_tx", "_host", *STATS, "_lines")


def frequent_lines(stats: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Boilerplate lines: (_host, h, n_docs, n_distinct).

    A line goes if more than ``max_docs`` distinct documents of a host hold it,
    however many copies stand beside them. Documents are told apart by all their
    lines, so exact copies count once, and pages that share a template of many
    lines count each. Near copies (documents of which under 1 / OWN_PART of the
    lines and of the characters belong to lines much rarer than the line in
    question, a similarity above 0.8) count as one: they are near-duplicate
    detection's business, and their text is not boilerplate.

    Only lines that many rows hold are looked at again. They are counted with
    partial sums and dealt to several parts when joined, so a line that a third
    of all documents hold stays in no single task.
    """
    per = stats.select("_host", F.array_distinct("_lines").alias("_ls")).withColumns({"_d": F.xxhash64(F.sort_array("_ls.h")), "_n": F.size("_ls"), "_all": _chars(F.col("_ls"))})
    each = per.select("_host", "_d", "_n", "_all", F.explode("_ls").alias("l")).select("_host", "_d", "_n", "_all", "l.h", "l.chars").filter(F.col("chars") >= limits.min_line_chars)
    held = each.groupBy("_host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > limits.max_docs)
    one = spread_join(each, held, ["_host", "h"], F.col("_d")).groupBy("_host", "_d", "_n", "_all").agg(F.collect_set(F.struct("h", "chars", "n")).alias("_f"))
    near = lambda x: F.filter("_f", lambda y: 2 * y["n"] >= x["n"])
    own = lambda x: (OWN_PART * (F.col("_n") - F.size(near(x))) >= F.col("_n")) | (OWN_PART * (F.col("_all") - _chars(near(x))) >= F.col("_all"))
    told = F.transform("_f", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"), own(x).cast("long").alias("own")))
    lines = one.select("_host", F.explode(told).alias("l")).groupBy("_host", "l.h").agg(F.max("l.n").alias("n_docs"), (F.sum("l.own") + F.max(1 - F.col("l.own"))).alias("n_distinct"))
    return lines.filter(F.col("n_distinct") > limits.max_docs)


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["chars"])


def line_verdicts(stats: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row per document with a boilerplate line: its key, ``_gone`` (the
    lines' hashes) and ``_depleted``, by the share of characters over the
    document's different lines."""
    lines = stats.withColumn("_total", _chars(F.array_distinct("_lines")))
    each = lines.select("_id", "_tx", "_host", "_total", F.explode(F.array_distinct(F.filter("_lines", lambda x: x["chars"] >= limits.min_line_chars))).alias("l")).select("_id", "_tx", "_host", "_total", "l.h", "l.chars")
    hit = spread_join(each, frequent_lines(stats, limits).select("_host", "h"), ["_host", "h"], F.col("_tx"))
    per = hit.groupBy("_id", "_tx").agg(F.collect_set(F.struct("h", "chars")).alias("_set"), F.max("_total").alias("_total"))
    return per.select("_id", "_tx", F.col("_set.h").alias("_gone"), (100 * _chars(F.col("_set")) > limits.max_removed_percent * F.col("_total")).alias("_depleted"))


def _judged(docs: DataFrame, limits: QualityLimits, without: tuple[str, ...]) -> DataFrame:
    """Every row (_row, less ``without``) with its statistics, key and verdict.

    Texts are parsed once: statistics and line hashes go to a scratch table,
    which the two passes over lines then read.
    """
    rows = Scratch(docs.sparkSession, "quality").table(document_stats(docs, limits, without), "stats")
    found = line_verdicts(rows, limits).withColumnsRenamed({"_id": "_vid", "_tx": "_vtx"})
    on = F.col("_id").eqNullSafe(F.col("_vid")) & (F.col("_tx") == F.col("_vtx"))
    out = rows.drop("_host", "_lines").join(found, on, "left").drop("_vid", "_vtx")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("_depleted", F.lit(False)))


def judge(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Every row of ``docs`` but its text, with its statistics and ``kept``:
    false if the base rules fail or boilerplate lines deplete the document.

    Needs doc_id, text and source, each of which may be null. An empty table
    gives an empty result; rows equal in doc_id and text are one document and
    get the same verdict; other columns pass through, and those named like a
    result are replaced.
    """
    names = [c for c in docs.columns if c not in ("text", *STATS, "kept")]
    return unpacked(_judged(docs, limits, ("text", "kept")), names, **{c: F.col(c) for c in (*STATS, "kept")})


def clean(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The kept documents without their boilerplate lines, in the columns of
    ``docs``; ``n_chars`` follows the text where it exists. Documents without
    such a line keep their text byte for byte."""
    found = _judged(docs, limits, tuple(docs.columns)).filter(~F.col("kept") | F.col("_gone").isNotNull()).select("_id", "_tx", "_gone", "kept").dropDuplicates(["_id", "_tx"])
    keyed = packed(docs, F.col("text"), *[c.alias(n) for c, n in zip(document_key(), ("_did", "_dtx"))])
    out = keyed.join(found, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dtx") == F.col("_tx")), "left")
    out = out.filter(F.coalesce("kept", F.lit(True)))
    stays = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_gone", _long_hash(normalised(x)))), "\n")
    changed = {"text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(stays)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_gone").isNull(), F.col(f"{ROW}.n_chars")).otherwise(F.length(stays).cast("long"))
    return unpacked(out, docs.columns, **changed)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return judge(docs).select("doc_id", *STATS, "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
trip AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM trip) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - p, 3))) AS n
        FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM twice) GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                   - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
         FROM d LEFT JOIN rep USING (doc_id)),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS r FROM d),
hs AS (SELECT DISTINCT doc_id, host, CAST('0x' || substr(md5(n), 1, 15) AS BIGINT) AS h, length(n) AS chars
       FROM (SELECT doc_id, host, lower(trim(r, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) AS n FROM raw) WHERE n <> ''),
total AS (SELECT doc_id, sum(chars) AS total, list(h ORDER BY h) AS d, count(*) AS k FROM hs GROUP BY doc_id),
held AS (SELECT host, h, count(*) AS n FROM hs GROUP BY host, h HAVING count(*) > 20),
one AS (SELECT DISTINCT host, d, k, total, h, chars, n FROM hs JOIN total USING (doc_id) JOIN held USING (host, h)),
told AS (SELECT x.host, x.h, x.d, 9 * (any_value(x.total) - sum(y.chars)) >= any_value(x.total) OR 9 * (any_value(x.k) - count(*)) >= any_value(x.k) AS own
         FROM one x JOIN one y ON x.host = y.host AND x.d = y.d AND 2 * y.n >= x.n GROUP BY x.host, x.h, x.d),
freq AS (SELECT host, h FROM told GROUP BY host, h HAVING count(*) FILTER (own) + CASE WHEN bool_and(own) THEN 0 ELSE 1 END > 20),
lost AS (SELECT doc_id, sum(chars) AS lost FROM hs JOIN freq USING (host, h) GROUP BY doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(100 * lost > 50 * total, false) AS kept
FROM f LEFT JOIN lost USING (doc_id) LEFT JOIN total USING (doc_id)
"""
