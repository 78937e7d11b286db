"""Trading calendars as tables: holding times, look-backs and gaps in bars are differences of ordinals.

`by` names the columns that tell runs apart, if several runs share a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ordinals(bars: DataFrame, by: Sequence[str] = (), name: str = "bar") -> DataFrame:
    """bars with the number of each bar among its security's, from 1."""
    return bars.withColumn(name, F.row_number().over(Window.partitionBy(*by, "htsc_code").orderBy("time")))


def market_days(bars: DataFrame) -> DataFrame:
    """time and day_number of every day on which any security has a bar: one row per day, numbered from 1."""
    return bars.select("time").distinct().withColumn("day_number", F.row_number().over(Window.orderBy("time")))


def holding_bars(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """trades (code, date_open, date_close and more) with barlen: the security's bars after the opening day, to the closing one.

    Bars and trades are one stream per security, which is dealt once and sorted by opening and then by closing days; the
    first bar of each day counts, so repeated bars need no grouping.
    """
    names = [c for c in trades.columns if c != "barlen"]
    days = bars.select(F.col("htsc_code").alias("code"), F.col("time").alias("date_open"), F.col("time").alias("date_close"), F.lit(1).alias("_bar"))
    both = trades.select(*names, F.lit(0).alias("_bar")).unionByName(days, allowMissingColumns=True)
    ordered = lambda day: Window.partitionBy("code").orderBy(day, F.desc("_bar"))
    so_far = lambda day: F.sum("_new").over(ordered(day).rowsBetween(Window.unboundedPreceding, 0))
    w = ordered("date_open")
    repeated = F.lag("_bar").over(w).isNotNull() & F.lag("date_open").over(w).eqNullSafe(F.col("date_open"))
    both = both.withColumn("_new", F.when((F.col("_bar") == 1) & ~repeated, 1).otherwise(0))
    both = both.withColumn("_opened", so_far("date_open")).withColumn("_closed", so_far("date_close"))
    return both.where("_bar = 0").select(*names, (F.col("_closed") - F.col("_opened")).cast("int").alias("barlen"))


def look_back(bars: DataFrame, start: object, count: int, by: Sequence[str] = ()) -> DataFrame:
    """Bars from start on, and of each security the `count` bars before it."""
    w = Window.partitionBy(*by, "htsc_code")
    numbered = with_ordinals(bars, by, "_bar").withColumn("_before", F.count(F.when(F.col("time") < F.lit(start), 1)).over(w))
    return numbered.where(F.col("_bar") > F.col("_before") - count).drop("_bar", "_before")


def gaps(bars: DataFrame) -> DataFrame:
    """htsc_code, time, bar and missed: the market's days between the bar and the security's bar before it (null at its first)."""
    days = bars.select("htsc_code", "time").join(market_days(bars), "time")
    w = Window.partitionBy("htsc_code").orderBy("time")
    return days.select("htsc_code", "time", F.row_number().over(w).alias("bar"), (F.col("day_number") - F.lag("day_number").over(w) - 1).alias("missed"))
