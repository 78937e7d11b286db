"""Helpers that several operators of this package use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.scratch import saved as written

__all__ = ["WORD", "copies", "discard", "word_list", "written"]

#: Words are the longest runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for table in tables:
        session = table.sparkSession
        folders = {path.rpartition("/")[0] for path in table.inputFiles()}
        for folder in folders:
            at = session._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def word_list(text: Column) -> Column:
    """The words of text as array<string>; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def copies(counted: DataFrame, times: str, number: str) -> DataFrame:
    """Each row of counted so often as its column `times` says, with the copy's number from 0 on instead of it.

    Numbers come from two sequences, so no row makes a long array.
    """
    wide = 1 << 12
    out = counted.withColumn("c_high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({times} - 1) div {wide}"))))
    last = F.least(F.lit(wide - 1).cast("bigint"), F.col(times) - 1 - wide * F.col("c_high"))
    out = out.withColumn("c_low", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return out.withColumn(number, wide * F.col("c_high") + F.col("c_low")).drop(times, "c_high", "c_low")
