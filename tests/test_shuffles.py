"""How often rows are dealt and sorted anew, by plans, and the results of the steps that save it."""

from __future__ import annotations

import time
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from barloom.operators import calendar, frames, replay
from barloom.plans import adapters, queries
from barloom.sources.scratch import saved

DATA = "/root/testdata/sf0.001"
DAY = date(2020, 1, 1)


def steps(df) -> Counter:
    """Operators of the physical plan, before it is adapted."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return Counter(line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0] for line in lines)


def test_factors_and_bars_are_dealt_once(spark):
    for made, deals in ((queries.factor_wide(spark, DATA), 1), (adapters.bars(spark, DATA), 1), (queries.legacy_frame(spark, DATA), 2)):
        assert steps(made)["Exchange"] == deals


def test_halving_mask_joins_nothing(spark):
    rows = [("A", date(y, 1, 1) + timedelta(k), c) for y, c in ((2018, 8.0), (2019, 4.0), (2021, 1.0), (2022, 0.4)) for k in range(7)]
    made = frames.halving_mask(spark.createDataFrame([(*r, 1) for r in rows], "htsc_code string, time date, close double, own int"))
    assert steps(made)["Exchange"] == 1 and not any("Join" in s for s in steps(made))
    found = {r.time: r.block_halving_future_buy for r in made.collect()}
    blocked = {date(y, 1, 1) + timedelta(k) for y, ks in ((2018, (5, 6)), (2019, range(5)), (2021, (5, 6)), (2022, range(5))) for k in ks}
    assert {d for d, b in found.items() if b} == blocked and len(found) == 28  # 2020 has no bars, so 2019 and 2021 aren't compared


def test_holding_bars_deals_once(spark):
    bars = spark.createDataFrame([("A", DAY + timedelta(k)) for k in (0, 2, 2, 2, 5, 9)] + [("B", DAY)], "htsc_code string, time date")
    own = [("A", 0, 9, 3), ("A", 1, 5, 2), ("A", 2, 2, 0), ("A", 3, 4, 0), ("A", 0, 2, 1), ("A", 0, 2, 1), ("C", 0, 9, 0)]
    trades = spark.createDataFrame([(c, DAY + timedelta(a), DAY + timedelta(b), n) for c, a, b, n in own], "code string, date_open date, date_close date, n int")
    made = calendar.holding_bars(trades, bars)
    assert steps(made)["Exchange"] == 1
    assert len(made.where("barlen = n").collect()) == len(own) == made.count() and dict(made.dtypes)["barlen"] == "int"


def test_positions_know_the_day_before(spark):
    at = lambda *ks: [DAY + timedelta(k) for k in ks]
    rows = [("A", d, c) for d, c in zip(at(0, 3, 4), (10.0, None, 12.0))] + [("B", d, 5.0 + k) for k, d in enumerate(at(1, 2, 5))]
    bars = spark.createDataFrame(rows, "htsc_code string, time date, close double")
    log = spark.createDataFrame([("A", DAY, "BUY", 7, 10.0), ("A", DAY + timedelta(4), "SELL", 0, 12.0), ("B", DAY + timedelta(2), "BUY", 3, 6.0)], "code string, date date, side string, position_after bigint, executed_price double")
    own = saved(replay.held(log, bars, replay.hold_from(bars)), "held")
    table = replay.positions(replay.on_days(own))
    daily = table.groupBy("date").agg(F.lit(1.0).alias("cash_value"), F.sum("market_value").alias("portfolio_value"))
    known, lagged = frames.position_log(table, daily, "r"), frames.position_log(table.drop("before_close", "before_value"), daily, "r")
    assert steps(known)["Window"] == 0 < steps(lagged)["Window"]
    rows = sorted(map(tuple, known.collect()), key=str)
    assert rows == sorted(map(tuple, lagged.collect()), key=str) and len(rows) == 8 and known.columns == lagged.columns


def test_saved_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, manager = spark.conf.get(key, "false"), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    old = shuffles()
    made = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # files go in the background
        if not shuffles() - old:
            break
        time.sleep(0.1)
    assert not shuffles() - old and made.count() == 7 and spark.conf.get(key, "false") == before
