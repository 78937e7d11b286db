"""Summaries of paths: merged in any grouping they equal windows over the whole series."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, summaries

CUTS = {"month": "date_format(date, 'yyyy-MM')", "week": "lpad(cast(datediff(date, DATE'2020-01-01') div 7 as string), 5, '0')", "day": "cast(date as string)", "whole": "'x'"}


def series(seed: int, days: int, holes: float, start_b: int) -> list[tuple]:
    rng, v, b, out = random.Random(seed), 100.0, 50.0, []
    for k in range(days):
        v, b = v * rng.uniform(0.9, 1.12), b * rng.uniform(0.95, 1.05)
        pick = lambda x: None if rng.random() < holes else x
        out.append((seed, date(2020, 1, 1) + timedelta(k), pick(v), pick(b) if k >= start_b else None))
    return out


def by_hand(rows: list[tuple]) -> dict:
    """From plain lists: returns of each series over its own days, active ones on days that have both."""
    r, rb, prev, prev_b, peak, falls = {}, {}, None, None, None, []
    for _, d, v, b in rows:
        if v is not None:
            if prev is not None:
                r[d] = v / prev - 1
            prev, peak = v, max(v, peak or v)
            falls.append(((peak - v) / peak * 100, peak - v))
        if b is not None:
            if prev_b is not None:
                rb[d] = b / prev_b - 1
            prev_b = b
    active = [r[d] - rb[d] for d in r if d in rb]
    mean = lambda x: sum(x) / len(x)
    sd = lambda x: math.sqrt(sum((y - mean(x)) ** 2 for y in x) / (len(x) - 1)) if len(x) > 1 else None
    down = lambda x: mean([min(y, 0) ** 2 for y in x])
    over = lambda n, d: n / d * 15 if d and d > 1e-12 else None
    x = list(r.values())
    return {
        "first_value": next((v for *_, v, _ in rows if v is not None), None), "final_value": prev, "benchmark_value": prev_b, "periods": len(x), "active_days": len(active),
        "sharpe": over(mean(x), sd(x)) if x else None, "sortino": over(mean(x), math.sqrt(down(x))) if x else None, "information_ratio": over(mean(active), sd(active)) if active else None,
        "downside": down(active) if active else None, "max_drawdown_pct": max(falls)[0] if falls else None, "max_drawdown_money": max(falls)[1] if falls else None,
    }


@pytest.mark.parametrize("cut", CUTS)
def test_merged_equals_whole(spark, cut):
    cases = [series(1, 200, 0, 0), series(2, 200, 0.3, 0), series(3, 150, 0.6, 40), series(4, 100, 0.1, 90), series(5, 1, 0, 0), series(6, 2, 0, 1), series(7, 40, 0.95, 0), series(8, 60, 0, 1000)]
    cases += [[(9, date(2020, 1, 1) + timedelta(k), 7.0, 7.0) for k in range(80)], [(10, date(2020, 1, 1) + timedelta(k), 0.0 if k % 5 == 2 else 3.0 + k, None) for k in range(50)][:2]]
    table = spark.createDataFrame([r for c in cases for r in c], "g int, date date, value double, bench double").repartition(3)
    chunks = summaries.chunked(table, ["g"], benchmark="bench", chunk=F.expr(CUTS[cut]))
    found = summaries.folded(chunks, ["g"]).select("g", *(c.alias(n) for n, c in summaries.figures(F.col("s"), 15.0).items()))
    got = {r.g: r.asDict() for r in found.collect()}
    assert len(got) == len(cases)
    for rows in cases:
        expect, mine = by_hand(rows), got[rows[0][0]]
        for name, want in expect.items():
            assert (mine[name] is None) == (want is None) and (want is None or mine[name] == pytest.approx(want, rel=1e-9, abs=1e-12)), (rows[0][0], name, mine[name], want)


def test_run_metrics_scans_days_without_a_window_over_all(spark, tmp_path):
    """The plan has no window in one partition, and reads the days twice at most (path and means)."""
    rows = [(d, 1e6, v, b) for _, d, v, b in series(1, 90, 0, 5)]
    spark.createDataFrame(rows, "date date, cash_value double, portfolio_value double, benchmark_value double").write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    orders = spark.createDataFrame([], "date date, code string, executed_value double, commission double")
    trades = spark.createDataFrame([], "code string, barlen int, pnlcomm double")
    out = metrics.run_metrics(days, orders, trades, 100.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
    row = out.first()
    assert row.n_trades == 0 and row.total_commission == 0 and row.win_rate is None and row.turnover is None
    assert row.benchmark_value == pytest.approx(rows[-1][3])
