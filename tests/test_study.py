"""Studies that fail in part, are cancelled, and go on where they stopped; models of one's own."""

from __future__ import annotations

import json
import threading
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import api
from barloom.operators import replay, study, sweep
from barloom.operators.frames import Rule

CLOSES = [10.0, 10.5, 11.0, 10.4, 10.9, 11.4, 12.8, 12.9, 12.0, 12.5]
BUY, SELL = [Rule("p"), Rule("q"), Rule("r")], [Rule("s"), Rule("t")]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(code, date(2022, 1, 3) + timedelta(i), c) for code, closes in (("A", CLOSES), ("B", CLOSES[::-1])) for i, c in enumerate(closes)]
    f = spark.createDataFrame(rows, "htsc_code string, time date, close double")
    hit = lambda c: F.when(c, 1.0).otherwise(0.0)
    return f.withColumns({"p": hit(F.col("close") < 10.6), "q": hit(F.col("close") < 12.1), "r": hit(F.col("close") < 11), "s": hit(F.col("close") > 12.4), "t": hit(F.col("close") > 12.85)})


def rows_of(df):
    return sorted((r.trial, r.buy_mask, r.sell_mask, r.n_trades, round(r.profit, 6)) for r in df.collect())


@pytest.mark.parametrize("block", [1000, 4, 1])
def test_study_equals_sweep(frame, tmp_path, block):
    seen = []
    s = study.Study(frame, BUY, SELL if block > 1 else SELL[:1], 1000.0, str(tmp_path / "s"), block=block, progress=lambda a, b: seen.append((a, b)))
    found = s.run()
    assert rows_of(found) == rows_of(sweep.sweep(frame, BUY, s.sell, 1000.0))
    assert seen[-1] == (s.trials, s.trials) and len(seen) == -(-s.trials // block)
    assert s.state() == {study.COMPLETE: s.trials} and not (tmp_path / "s/_parts").exists()
    best = sweep.best(found).first()
    told = json.loads(s.result())
    assert told["best"]["trial"] == told["best_trial"] == best.trial and (told["n_trials"], told["completed_trials"], told["failed_trials"], told["cancelled"]) == (s.trials, s.trials, 0, False)
    assert told["best_value"] == best.profit and len(told["trials"]) == told["buy_subset_count"] * told["sell_subset_count"] == s.trials
    assert told["direction"] == "maximize" and told["best"]["buy_rules"][0]["factor"] in "pqr"


def test_failures_stand_alone(frame, tmp_path):
    """A rule that can't be read, and one that fails in a task, are errors of their own trials only."""
    broken = frame.withColumn("q", F.when(F.col("close") > 0, F.raise_error(F.lit("a broken factor")).cast("double")))
    for name, table, rules in (("missing", frame, [BUY[0], Rule("z"), BUY[2]]), ("broken", broken, BUY)):
        s = study.Study(table, rules, SELL, 1000.0, str(tmp_path / name), block=7)
        rows = {r.trial: r for r in s.run().collect()}
        assert len(rows) == 21 and s.state() == {study.FAILED: 12, study.COMPLETE: 9}
        whole = {r[0]: r for r in rows_of(sweep.sweep(frame, BUY, SELL, 1000.0))}
        for k, r in rows.items():
            assert (r.state == study.FAILED) == bool(r.buy_mask & 2)
            assert ("factor" in r.error and r.n_trades is None) if r.state == study.FAILED else (r.error is None and (k, r.buy_mask, r.sell_mask, r.n_trades, round(r.profit, 6)) == whole[k])
        assert not s.best().first().buy_mask & 2
    with pytest.raises(RuntimeError, match="all 3 trials failed"):
        study.Study(frame, [Rule("z")], SELL, 1.0, str(tmp_path / "none")).run()


def test_cancel_and_resume(frame, tmp_path):
    folder, seen = str(tmp_path / "s"), []

    def progress(done, total):
        seen.append(done)
        if done == 8:
            first.cancel()

    first = study.Study(frame, BUY, SELL, 1000.0, folder, block=4, progress=progress)
    assert first.run().count() == 8 and seen == [4, 8]
    assert first.state() == {study.COMPLETE: 8, study.CANCELLED: 13}
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    second = study.Study(frame, BUY, SELL, 1000.0, folder, block=4)
    assert rows_of(second.run()) == rows_of(sweep.sweep(frame, BUY, SELL, 1000.0))
    assert times and all(p.stat().st_mtime_ns == t for p, t in times.items())  # whole blocks are not run again


def test_cancel_inside_a_block(spark, frame, tmp_path):
    """The running jobs end at once, and the block's rows are not kept."""
    slow = frame.withColumn("p", F.when(F.expr("java_method('java.lang.Thread', 'sleep', 3000L)").isNull(), 1.0).otherwise(1.0))
    s = study.Study(slow, BUY[:1], SELL, 1000.0, str(tmp_path / "s"))
    timer = threading.Timer(2.0, s.cancel)
    began = time.time()
    timer.start()
    assert s.run().count() == 0 and time.time() - began < 30
    assert s.state() == {study.CANCELLED: 3} and s.best().first() is None
    assert spark.range(3).count() == 3  # the tag is gone


def test_objectives(frame, tmp_path):
    s = study.Study(frame, BUY, SELL, 1000.0, str(tmp_path / "s"), objective=lambda rows: F.col("profit") / F.nullif(F.col("n_trades"), F.lit(0)), maximise=False)
    s.run()
    rows = [r for r in s.scored().collect() if r["value"] is not None]
    assert s.best().first().trial == min(rows, key=lambda r: (r["value"], r.trial)).trial


def test_bad_studies(frame, tmp_path):
    for wrong in ({"buy": []}, {"sell": [Rule(str(k)) for k in range(11)]}, {"block": 0}):
        with pytest.raises(ValueError):
            study.Study(**{"frame": frame, "buy": BUY, "sell": SELL, "budget": 1.0, "folder": str(tmp_path), **wrong})


def test_own_model(spark, frame, tmp_path):
    """A registered model prepares the frame and trades by its own rules; what breaks the contract is refused."""
    bars = frame.select("htsc_code", "time", "close")
    long = frame.select("htsc_code", "time", F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("value")) for c in "pqrst"))).alias("x")).select("htsc_code", "time", "x.*")
    only_a = api.Model("only_a", "Rules on one security", prepare=lambda f: f.withColumn("tradable", F.col("htsc_code") == "A"))
    late = api.Model("late", "Orders of the second half", strategy=lambda f, buy, sell, budget, by: replay.orders(f, buy & (F.col("time") > date(2022, 1, 7)), sell, budget, by))
    lost = api.Model("lost", "Loses a column", prepare=lambda f: f.drop("close"))
    odd = api.Model("odd", "No orders at all", strategy=lambda f, buy, sell, budget, by: f.select("time"))
    try:
        for m in (only_a, late, lost, odd):
            api.register(m)
        with pytest.raises(ValueError):
            api.register(only_a)
        assert {r.code for r in api.backtest(bars, long, BUY[:1], SELL, only_a)["orders"].collect()} == {"A"}
        assert {r.date >= date(2022, 1, 8) for r in api.backtest(bars, long, BUY[:1], SELL, late)["orders"].where("side = 'BUY'").collect()} == {True}
        for m in (lost, odd):
            with pytest.raises(ValueError, match=m.id):
                api.backtest(bars, long, BUY[:1], SELL, m)
        trials, best = api.run_sweep(bars, long, BUY, SELL, only_a)
        assert rows_of(trials) == rows_of(sweep.sweep(frame.where("htsc_code = 'A'"), BUY, SELL, replay.CASH / 2))
        s = api.run_study(bars, long, BUY, SELL, only_a, str(tmp_path / "own"), block=5)
        assert rows_of(s.run()) == rows_of(trials) and s.best().first().trial == best.first().trial
    finally:
        for m in (only_a, late, lost, odd):
            api.MODELS.pop(m.id, None)


def by_hand(closes, buy, sell, budget, days):
    """The path-dependent exits, bar by bar."""
    size, paid, first, first_paid, blocked, out = 0, 0.0, None, 0.0, False, []
    for d, c, b, s in zip(days, closes, buy, sell):
        if size and (d - first).days >= 365 and c <= first_paid * 0.5:
            blocked = True
        gain = c / paid - 1 if size else 0.0
        if size and s and gain > 0.5:
            out.append((d, "SELL", size, 0))
            size = 0
        elif size and s and gain > 0.3:
            if size // 2:
                out.append((d, "SELL", size // 2, size - size // 2))
                size -= size // 2
        elif not size and b and not blocked and int(budget / (c * 1.0003)):
            size, paid = int(budget / (c * 1.0003)), c
            first, first_paid = first or d, first_paid or c
            out.append((d, "BUY", size, size))
    return out


def test_exits(spark):
    import random

    rng, rows, expect = random.Random(4), [], {}
    for code in "ABCDEFGH":
        c, days, closes, buy, sell = 10.0, [], [], [], []
        for k in range(120):
            c = max(0.5, c * rng.choice([0.6, 0.8, 0.95, 1.05, 1.2, 1.5]))
            days.append(date(2020, 1, 1) + timedelta(k * 9))
            closes.append(round(c, 2))
            buy.append(rng.random() < 0.3)
            sell.append(rng.random() < 0.3)
        rows += [(code, *r) for r in zip(days, closes, buy, sell)]
        expect[code] = by_hand(closes, buy, sell, 1000.0, days)
    f = spark.createDataFrame(rows, "htsc_code string, time date, close double, b boolean, s boolean")
    got = {}
    for r in replay.exits(f, F.col("b"), F.col("s"), 1000.0).orderBy("code", "date").collect():
        got.setdefault(r.code, []).append((r.date, r.side, r.executed_size, r.position_after))
    assert got == {k: v for k, v in expect.items() if v} and any(x[3] and x[1] == "SELL" for v in got.values() for x in v)
