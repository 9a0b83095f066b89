"""Whole rows carried as one struct, so that no column of theirs can clash with
an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"
#: Parts that rows of one key are dealt to where a key may hold a third of a table.
SALTS = 16


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(rows: DataFrame, *columns: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as the struct ROW, less some columns, beside ``columns``."""
    names = [c for c in rows.columns if c not in without]
    return rows.select(F.struct(*[F.col(quoted(c)).alias(c) for c in names]).alias(ROW) if names else F.lit(None).alias(ROW), *columns)


def unpacked(rows: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """The columns of ROW under ``names``, in order; those given replace theirs or follow."""
    own = [columns[c].alias(c) if c in columns else F.col(f"{ROW}.{quoted(c)}").alias(c) for c in names]
    return rows.select(*own, *[v.alias(k) for k, v in columns.items() if k not in names])


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each ``on`` and is
    much smaller, when one key may hold a third of ``left``.

    Each row of ``right`` stands in ``salts`` copies and ``left`` is dealt to
    them by the hash of ``by``, so no task gets a whole key. Where ``right``
    turns out small, Spark broadcasts it by its size at run time instead.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def spread(rows: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores if it is small and lies in fewer
    files than there are cores: one file of one row group is read by one task,
    which would then do all the work. Larger tables stay as their files are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores << 27 and len(rows.inputFiles()) < cores else rows
