"""Equity curves as rows of a daily price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import ratio

#: Codes of the synthetic curves (fixed values).
CURVES = {"portfolio_curve": "000000.YKRS", "cash_ratio_curve": "0000000.YKRS", "buy_hold_curve": "000001.YKRS"}


def all_curves(daily: DataFrame, name: str | Column, cash: float) -> DataFrame:
    """Normalised portfolio and benchmark curves and the share of cash of replay.days(), as one table: open, high, low and
    close all equal the value. Each day's row gives its curves' rows, so the days are read once."""
    values = {"portfolio_curve": F.col("portfolio_value") / cash, "cash_ratio_curve": ratio(F.col("cash_value"), F.col("portfolio_value")), "buy_hold_curve": F.col("benchmark_value") / cash}
    drawn = F.array(*(F.struct(F.lit(CURVES[kind]).alias("htsc_code"), v.cast("double").alias("v"), F.lit(kind).alias("kind")) for kind, v in values.items()))
    rows = daily.select(F.col("date").alias("time"), F.lit(name).alias("name"), F.inline(drawn)).where("v IS NOT NULL")
    return rows.select(
        "htsc_code", "time", *(F.col("v").alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"), "name", F.col("kind").alias("security_type"),
        F.date_format("time", "yyyy").alias("year"), F.date_format("time", "MM").alias("month"),
    )
