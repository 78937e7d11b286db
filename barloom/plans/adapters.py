"""Views of order tables as market data, so that every operator runs on tables that grow.

A supplier is a security and a ship date a bar; the price of a line is its extended price per unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.calendar import holding_bars


def security() -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(".SZ"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a task, at first and where TASKS such tasks don't take all of them: a shuffle into so few keeps no rows in memory.
LINES, MOST_LINES, TASKS = 500_000, 2_000_000, 200


def lines(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """htsc_code, time and more columns of every line, dealt by security and day.

    Nearly every line has a day of its own, so partial aggregates before the shuffle would hold a group for each line of a
    file's split. Groups of these keys need no further shuffle, and a task's share stays as it is when the table grows.
    """
    all_lines = table(spark, sf_dir, "lineitem")
    n, usual = all_lines.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(usual, -(-n // (LINES // 10))), min(TASKS, -(-n // LINES)), -(-n // MOST_LINES))
    return all_lines.select(security().alias("htsc_code"), F.to_date("l_shipdate").alias("time"), *columns).repartition(tasks, "htsc_code", "time")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """htsc_code, time, open, high, low, close, volume."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines(spark, sf_dir, px.alias("px"), order.alias("o"), "l_quantity").groupBy("htsc_code", "time").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"), F.sum("l_quantity").alias("volume"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """htsc_code, time, factor, value: lines by return flag and by line status."""
    flags = lines(spark, sf_dir, "l_returnflag", "l_linestatus").select("htsc_code", "time", F.explode(F.array("l_returnflag", "l_linestatus")).alias("factor"))
    return flags.groupBy("htsc_code", "time", "factor").agg(F.count("*").cast("double").alias("value"))


FACTORS = ["A", "N", "R", "F", "O"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """htsc_code, begin_date, end_date, xdy: a segment per supplier and year."""
    years = table(spark, sf_dir, "lineitem").select(security().alias("htsc_code"), "l_suppkey", F.year("l_shipdate").alias("y")).distinct()
    xdy = 1 + (F.col("y") + F.col("l_suppkey")) % 5 / F.lit(100.0)
    return years.select("htsc_code", F.make_date("y", F.lit(1), F.lit(1)).alias("begin_date"), F.make_date("y", F.lit(12), F.lit(31)).alias("end_date"), xdy.alias("xdy"))


def odd_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that no bar may use: of suppliers without bars in most years, of synthetic curves, and with a missing end."""
    years = segments(spark, sf_dir)
    early = years.where(F.year("begin_date") == 1998).select(F.concat(F.lit("X"), "htsc_code").alias("htsc_code"), "begin_date", "end_date", "xdy")
    curves = years.select(F.regexp_replace("htsc_code", "SZ$", "YKRS").alias("htsc_code"), "begin_date", "end_date", "xdy")
    ends = years.where(F.year("begin_date") == 1997).select("htsc_code", F.lit(None).cast("date").alias("begin_date"), "end_date", "xdy")
    return early.unionByName(curves).unionByName(ends)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, side, status, executed_value, commission of every line."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        security().alias("code"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.when(F.col("o_orderstatus") == "P", "Margin").otherwise("Completed").alias("status"),
        F.col("l_extendedprice").alias("executed_value"), (F.col("l_extendedprice") * 0.0003).alias("commission"),
    )


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date_open, date_close, pnl, pnlcomm of every line, and barlen, the security's bars from the one day to the other."""
    shipped, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    opened, closed = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    trades = joined.select(security().alias("code"), opened.alias("date_open"), closed.alias("date_close"), (F.lit(0.05) * F.col("l_extendedprice")).alias("pnl"), ((0.05 - F.col("l_discount")) * F.col("l_extendedprice")).alias("pnlcomm"))
    return holding_bars(trades, shipped.select(security().alias("htsc_code"), closed.alias("time")))


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, value: per supplier the money shipped so far on top of a start value, rounded to cents."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(security().alias("code"), F.to_date("l_shipdate").alias("date"))
    sign = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    days = shipped.agg(F.sum(F.round(sign * 100).cast("long")).alias("cents"))
    run = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("code", "date", (F.lit(1e7) + F.sum("cents").over(run) / 100).alias("value"))
