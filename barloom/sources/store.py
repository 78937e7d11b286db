"""Readers and writers of the partitioned tables: prices, factors, segments, pools, logs and curves."""

from __future__ import annotations

import calendar
import json
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import code, directory_name
from barloom.operators.replay import ORDER_COLUMNS
from barloom.sources import snapshots
from barloom.sources.catalog import Catalog, folders, groups, read
from barloom.sources.snapshots import Folder


#: Name of the file that holds all segments (fixed value).
SEGMENT_FILE = "adj_factor_segments.parquet"


def day(value: object) -> date:
    """A date given as such or as text; ValueError otherwise."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    text = str(value or "").strip()
    if not text:
        raise ValueError("a date is empty")
    try:
        return datetime.fromisoformat(text).date()
    except ValueError:
        raise ValueError(f"{text!r} is not a date") from None


def codes_of(values: object) -> list[str]:
    """Codes without blanks and repeats, in order; ValueError if none are left."""
    if not isinstance(values, (list, tuple)):
        raise ValueError("codes must be a list")
    found = list(dict.fromkeys(str(v).strip().upper() for v in values if str(v or "").strip()))
    if not found:
        raise ValueError("no codes are given")
    return found


def months(start: date, end: date) -> F.Column:
    """Partition predicate: year and month lie in the months of [start, end); read from directory names only."""
    at = F.col("year").cast("int") * 100 + F.col("month").cast("int")
    return (at >= start.year * 100 + start.month) & (at <= end.year * 100 + end.month)


def of_codes(rows: DataFrame, codes: list[str] | DataFrame) -> DataFrame:
    """The rows of the codes, given as a list or, for pools of any size, as a table with htsc_code."""
    rows = rows.withColumn("htsc_code", code(F.col("htsc_code")))
    if isinstance(codes, DataFrame):
        return rows.join(codes.select(code(F.col("htsc_code")).alias("htsc_code")).distinct(), "htsc_code", "left_semi")
    return rows.where(F.col("htsc_code").isin(codes_of(codes)))


def prices(spark: SparkSession, base: str, codes: list[str] | DataFrame, start: object, end: object, look_back: int = 0, look_ahead: int = 0, known: Catalog | None = None) -> DataFrame:
    """Bars of the codes in [start - look_back days, end + look_ahead months); ValueError if there are none.

    Only folders of these months are opened. With a catalogue no footers are read, and the codes reach the scan as the files
    spell them; without one they are compared after trimming. Months may differ in columns and types.
    """
    a, b = extended(start, end, look_back, look_ahead)
    base = base.rstrip("/")
    found = known.within(a, b) if known else groups(spark, base, folders(spark, base, a, b))
    if not found:
        raise ValueError("there are no bars of these codes in these days")
    bars = read(spark, base, found).drop("file").where(months(a, b))
    if known and not isinstance(codes, DataFrame):
        bars = bars.where(F.col("htsc_code").isin(known.spelt(codes_of(codes))))
    bars = bars.withColumn("time", F.to_date("time"))
    bars = of_codes(bars.where((F.col("time") >= F.lit(a)) & (F.col("time") < F.lit(b))), codes)
    if bars.isEmpty():  # stops at the first row
        raise ValueError("there are no bars of these codes in these days")
    return bars


def extended(start: object, end: object, look_back: int = 0, look_ahead: int = 0) -> tuple[date, date]:
    """start moved back by days and end moved on by months (to the month's last day where it has no such day)."""
    a, b = day(start) - timedelta(days=look_back), day(end)
    at = b.year * 12 + b.month - 1 + look_ahead
    year, month = divmod(at, 12)
    return a, date(year, month + 1, min(b.day, calendar.monthrange(year, month + 1)[1]))


def segments(spark: SparkSession, base: str, codes: list[str] | DataFrame | None = None) -> DataFrame:
    """Adjustment segments (htsc_code, begin_date, end_date, xdy): of one file below base, or else of its year and month folders."""
    base = base.rstrip("/")
    if SEGMENT_FILE in Folder(spark, base).names(""):
        rows = spark.read.parquet(f"{base}/{SEGMENT_FILE}")
    else:
        paths = folders(spark, base)
        rows = read(spark, base, groups(spark, base, paths)) if paths else spark.read.parquet(base)
    rows = rows.select("htsc_code", F.to_date("begin_date").alias("begin_date"), F.to_date("end_date").alias("end_date"), F.col("xdy").try_cast("double").alias("xdy"))
    return rows.withColumn("htsc_code", code(F.col("htsc_code"))) if codes is None else of_codes(rows, codes)


def factors(spark: SparkSession, base: str, names: list[str], start: object, end: object) -> DataFrame:
    """Long factor rows (htsc_code, time, factor, value) of [start, end), by the factors' names.

    Only the months' folders of these factors are opened, by the names that folders can have; a factor that isn't stored has
    no rows. Of repeated keys the last counts: files named part after merged.parquet, in order, then the larger value.
    """
    a, b = day(start), day(end)
    base, kept = base.rstrip("/"), {}
    for name in names:
        kept.setdefault(directory_name(name), []).append(name)
    paths = folders(spark, base, a, b, [f"factor={d}" for d in kept])
    if not paths:
        return spark.createDataFrame([], "htsc_code string, time date, factor string, value double")
    rows = read(spark, base, groups(spark, base, paths)).where(months(a, b))
    called = F.create_map(*(x for d, own in kept.items() for x in (F.lit(d), F.array(*map(F.lit, own)))))
    rows = rows.select(code(F.col("htsc_code")).alias("htsc_code"), F.to_date("time").alias("time"), F.col("factor").cast("string").alias("_folder"), F.col("value").try_cast("double").alias("value"), F.when(F.col("file") == "merged.parquet", "").otherwise(F.col("file")).alias("_file"))
    w = Window.partitionBy("htsc_code", "time", "_folder").orderBy(F.desc("_file"), F.desc("value"))
    rows = rows.where((F.col("time") >= F.lit(a)) & (F.col("time") < F.lit(b)))
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    # names that share a folder are each given its rows
    return rows.select("htsc_code", "time", F.explode(called[F.col("_folder")]).alias("factor"), "value")


def pool(spark: SparkSession, path: str) -> DataFrame:
    """Codes of a CSV: its column 证券代码, else its first one."""
    table = spark.read.csv(path, header=True)
    name = "证券代码" if "证券代码" in table.columns else table.columns[0]
    return table.select(code(F.col(f"`{name}`")).alias("htsc_code")).where("htsc_code <> ''").distinct()


def write_orders(log: DataFrame, path: str) -> None:
    """The order log with its fixed columns; those it lacks are null."""
    log.select(*(F.col(c) if c in log.columns else F.lit(None).cast("double").alias(c) for c in ORDER_COLUMNS)).orderBy("date", "code").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_positions(log: DataFrame, path: str) -> None:
    """The position log, one row per day and code, largest positions of a day first."""
    w = Window.partitionBy("date", "code").orderBy(F.desc("market_value"), F.desc("position_size"))
    out = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out.orderBy("date", F.desc("market_value"), "code").write.mode("overwrite").option("compression", "zstd").parquet(path)


def merged_curves(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """old and new rows by name; new ones win on (htsc_code, time)."""
    both = new.withColumn("_batch", F.lit(1))
    if old is not None:
        both = old.withColumn("_batch", F.lit(0)).unionByName(both, allowMissingColumns=True)
    w = Window.partitionBy("htsc_code", "time").orderBy(F.desc("_batch"), F.desc("close"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def upsert_curves(rows: DataFrame, base: str) -> int:
    """Merge rows into the table by year and month and publish the result as its next version, whose number is given.

    Readers (snapshots.read) see the version before or after, never a mixture; writers that meet merge one after the other.
    """
    return snapshots.upsert(rows, base, merged_curves)


def summary_json(summary: DataFrame) -> str:
    """The one row of a summary as JSON text; null for what is undefined, other scripts as they are."""
    return json.dumps(json.loads(summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), ensure_ascii=False, indent=2)
