"""Hand-made cases for the operators, readers, writers and entry points."""

from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle
from barloom import api
from barloom.functions import scalar as S
from barloom.operators import curves, frames, metrics, replay, sweep
from barloom.operators.frames import Rule
from barloom.plans import oracles, queries
from barloom.sources import snapshots, store
from barloom.streaming.bars import hourly

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, name):
    assert oracle.compare(spark, DATA, queries.QUERIES[name], oracles.ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def bars(spark, closes, code="A", start=date(2022, 1, 3)):
    return spark.createDataFrame([(code, start + timedelta(i), c, c, c, c, 1.0) for i, c in enumerate(closes)], "htsc_code string, time date, open double, high double, low double, close double, volume double")


def test_adjust(spark):
    seg = spark.createDataFrame([("A", date(2022, 1, 3), date(2022, 1, 3), 1.0), ("A", date(2022, 1, 4), date(2022, 1, 4), 1.2), ("A", date(2022, 1, 5), date(2022, 1, 8), 1.5)], "htsc_code string, begin_date date, end_date date, xdy double")
    back = [round(r.close, 9) for r in frames.adjusted(bars(spark, [10.0] * 7), seg, "backward").orderBy("time").collect()]
    assert back == [10, 12, 18, 18, 18, 10, 10]  # Saturday and Sunday stay
    forward = [round(r.close, 9) for r in frames.adjusted(bars(spark, [18.0] * 3), seg, "forward").orderBy("time").collect()]
    assert forward == [10, 12, 18]
    spoilt = seg.withColumn("xdy", F.when(F.col("begin_date") != date(2022, 1, 4), F.col("xdy")))
    got = [(r["cum"], r["suffix"]) for r in frames.segment_factors(spoilt).orderBy("begin_date").collect()]
    assert got == [(1.0, 1.0), (1.0, 1.5), (1.0, 1.0)]
    with pytest.raises(ValueError):
        frames.adjusted(bars(spark, [1.0]), seg, "sideways")


def test_rules(spark):
    df = spark.createDataFrame([(1.0, "1"), (0.5, "abc"), (None, None), (float("nan"), "2"), (float("inf"), "0")], "a double, b string")
    both = [Rule("a"), Rule("b")]
    got = df.select(frames.rules_hit([Rule("a")]).alias("a"), frames.rules_hit(both).alias("x"), frames.rules_hit(both, "or").alias("y"), frames.rules_hit([]).alias("z"))
    assert list(map(tuple, got.collect())) == [(True, True, True, False), (False,) * 4, (False,) * 4, (False, False, True, False), (True, False, True, False)]


def test_strong_signals(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (0.0, 1.0, 0.0)], "a double, b double, total_buy_signal double")
    got = frames.with_strong_signals(df, [Rule("a")], [Rule("b")]).select("total_buy_signal", "strong_buy_signal", "strong_sell_signal").collect()
    assert list(map(tuple, got)) == [(1.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    none = frames.with_strong_signals(df, [], []).select("total_buy_signal", "strong_buy_signal", "strong_sell_signal").collect()
    assert list(map(tuple, none)) == [(2.0, 2.0, 0.0), (0.0, 0.0, 0.0)]
    columns, buy, sell = frames.rule_columns([Rule("a"), Rule("MAC总", 3)], [Rule("a", 2), Rule("b", 2)])
    assert columns == {**frames.AUXILIARY_NAMES, "a": "buy_factor_0", "b": "sell_factor_1"}
    assert buy == [Rule("buy_factor_0"), Rule("mac_total", 3)] and sell == [Rule("buy_factor_0", 2), Rule("sell_factor_1", 2)]
    assert frames.active_rules([Rule("a"), Rule("b", 2), Rule("c")], {"a": False, "b": True}) == [Rule("b", 2)]
    assert api.rules_of(None) == []


def test_halving(spark):
    first, second = bars(spark, [10.0] * 8, start=date(2021, 6, 1)), bars(spark, [5.0] * 6, start=date(2022, 6, 1))
    got = [r[0] for r in frames.halving_mask(first.union(second)).orderBy("time").select("block_halving_future_buy").collect()]
    assert got == [0] * 5 + [1] * 8 + [0]
    assert frames.halving_mask(first.union(bars(spark, [5.01] * 6, start=date(2022, 6, 1)))).agg(F.sum("block_halving_future_buy")).first()[0] == 0


def test_backscan(spark):
    rows = [("A", 3, 1, 0), ("A", 3, 0, 1), ("B", 3, 0, 1), ("B", 4, 1, 0), ("C", 3, 1, 0), ("C", 5, 0, 1), ("D", 9, 1, 0)]
    df = spark.createDataFrame([(c, date(2022, 1, d), float(b), float(s)) for c, d, b, s in rows], "htsc_code string, time date, buy double, sell double")
    got = frames.backscan(df, F.lit(date(2022, 1, 8)), "buy", "sell").collect()
    assert [(r.htsc_code, r.weight) for r in got] == [("B", 0.05)]


def test_metrics(spark):
    r = spark.createDataFrame([(0.01, 0.0), (-0.02, -0.01), (0.03, 0.01)], "r double, b double")
    a = F.col("r") - F.col("b")
    got = r.agg(metrics.sharpe(F.col("r")), metrics.sortino(F.col("r")), metrics.information_ratio(a), metrics.excess_score(F.lit(0.0194), F.avg(F.pow(F.least(a, F.lit(0.0)), 2)))).first()
    assert [round(x, 6) for x in got] == [4.20526, 9.165151, 6.928203, 6.368187]
    dd = spark.createDataFrame([(1, d, float(v)) for d, v in enumerate([100, 110, 99, 120, 90])], "g int, date int, value double")
    assert tuple(metrics.drawdown(dd, ["g"]).first())[1:] == (25.0, 30.0)
    one = r.limit(1).agg(metrics.sharpe(F.col("r")), metrics.win_rate(F.col("r")), metrics.profit_loss_ratio(F.col("r"))).first()
    assert one[0] is None and one[1] == 1.0 and math.isinf(one[2])


def test_benchmark(spark):
    b = bars(spark, [10.0, 10.0], "A").union(bars(spark, [20.0, 20.0], "B"))
    assert [round(r["value"], 2) for r in replay.buy_and_hold(b).orderBy("date").collect()] == [round(1e7 - (499850 * 10 + 249925 * 20) * 0.0003, 2)] * 2


def test_replay(spark):
    f = bars(spark, [10.0, 11.0, 12.0, 9.0, 8.0]).withColumns({"b": F.when(F.col("close").isin(10.0, 11.0, 8.0), 1.0).otherwise(0.0), "s": F.when(F.col("close") == 12.0, 1.0).otherwise(0.0)})
    log = replay.orders(f, F.col("b") >= 1, F.col("s") >= 1, 1000.0)
    assert [(r.side, r.executed_size, r.executed_price) for r in log.orderBy("date").collect()] == [("BUY", 99, 10.0), ("SELL", 99, 12.0), ("BUY", 124, 8.0)]
    t = replay.trades(log).collect()
    assert len(t) == 1 and t[0].barlen == 2 and round(t[0].pnl, 6) == 198 and round(t[0].pnlcomm, 4) == round(198 - 99 * 22 * 0.0003, 4)
    daily = replay.days(replay.valued(log, f), log, cash=1000.0).orderBy("date").collect()
    assert round(daily[1].portfolio_value, 4) == round(1000 - 990 * 1.0003 + 99 * 11, 4)


def test_move_gate(spark):
    assert [r.tradable for r in frames.move_gate(bars(spark, [10.0, 10.99, 12.05])).orderBy("time").collect()] == [True, False, True]


def test_sweep(spark):
    f = bars(spark, [10.0, 12.0]).withColumns({"a": F.when(F.col("close") == 10, 1.0), "b": F.lit(0.0), "c": F.lit(1.0), "s": F.when(F.col("close") == 12, 1.0), "t": F.lit(0.0)})
    rows = sweep.sweep(f, [Rule("a"), Rule("b"), Rule("c")], [Rule("s"), Rule("t")], 1000.0)
    assert rows.count() == 21
    best = sweep.best(rows).first()
    assert (best.buy_mask, best.sell_mask, best.n_trades) == (1, 1, 1)
    with pytest.raises(ValueError):
        sweep.sweep(f, [Rule(str(i)) for i in range(7)], [Rule(str(i)) for i in range(6)], 1.0)
    odd = spark.createDataFrame([(0, "12.3%"), (1, None), (2, "1.5"), (3, "1.5")], "trial int, profit string")
    assert sweep.best(odd).first().trial == 2


def test_names(spark):
    days = [("2024-01-01", "2024-06-30"), ("2024-01-01", "2026-01-01"), ("2024-11-01", "2025-02-01"), ("2025-02-01", "2024-11-01"), (None, "2024-01-01"), ("2024-02-29", "2024-03-01")]
    df = spark.createDataFrame(days, "a string, b string").select(S.period_name(F.to_date("a"), F.to_date("b")))
    assert [r[0] for r in df.collect()] == ["202401_to_06", "2024_to_2026", "202411_to_202502", "202411_to_202502", "", "202402_to_03"]
    texts = spark.createDataFrame([("a/b. ",), ("  ",), ("x  y:z_._",), (None,)], "t string").select(S.path_name(F.col("t")), S.token_name(F.col("t")))
    assert list(map(tuple, texts.collect())) == [("a_b", "a_b"), ("未命名因子", "因子"), ("x  y_z_._", "x_y_z"), ("未命名因子", "因子")]
    shown = spark.createDataFrame([(0.05,), (0.12345,), (float("nan"),), (None,)], "v double").select(S.percent(F.col("v")), S.shown(F.col("v")))
    assert list(map(tuple, shown.collect())) == [("5.0%", 0.05), ("12.35%", 0.12), (None, None), (None, None)]
    names = spark.createDataFrame([("202401_to_06__run",), ("run",), (None,)], "n string").select(S.without_period(F.col("n"), F.lit(date(2024, 1, 1)), F.lit(date(2024, 6, 30))))
    assert [r[0] for r in names.collect()] == ["run", "run", ""]


def test_errors():
    for bad in ("A", [], ["", " "]):
        with pytest.raises(ValueError):
            store.codes_of(bad)
    assert store.codes_of([" a", "A", "b "]) == ["A", "B"]
    for bad in (None, "", "2024-13-01", "x"):
        with pytest.raises(ValueError):
            store.day(bad)
    for bad in ("x", ["x"], [{}], [{"factor": "a", "threshold": "x"}], [{"factor": "a", "threshold": float("inf")}]):
        with pytest.raises(ValueError):
            api.rules_of(bad)
    assert api.rules_of([{"factor": "a"}, {"factor": "a", "threshold": 3}]) == [Rule("a", 1.0)]
    assert api.operator_of("OR", "and") == "or" and api.operator_of("xor", "or") == "and" and api.operator_of(None, "or") == "or"


def test_configured_run(spark, tmp_path):
    b = bars(spark, [10.0, 11.0, 12.0, 12.0], " a ").withColumns({"year": F.date_format("time", "yyyy"), "month": F.date_format("time", "MM")})
    b.write.partitionBy("year", "month").parquet(str(tmp_path / "prices"))
    long = b.select("htsc_code", "time", "year", "month", F.explode(F.array(F.lit("buy"), F.lit("sell"))).alias("factor"), "close").withColumn("value", F.when((F.col("factor") == "buy") == (F.col("close") < 11), "1").otherwise("x"))
    long.drop("close").write.partitionBy("factor", "year", "month").parquet(str(tmp_path / "factors"))
    config = {"codes": ["a"], "start_date": "2022-01-01", "end_date": "2022-02-01", "buy_rules": [{"factor": "buy"}], "sell_rules": [{"factor": "sell"}]}
    seen = []
    run = lambda **x: api.run_configured(spark, {**config, **x}, str(tmp_path / "prices"), str(tmp_path / "factors"), str(tmp_path / "out"), seen.append)
    found = run()
    assert found["trades"].count() == 1 and seen == [5, 25, 95] and found["summary"].first().n_trades == 1
    before = snapshots.read(spark, str(tmp_path / "out/curves"))
    run()
    assert sorted(map(str, snapshots.read(spark, str(tmp_path / "out/curves")).collect())) == sorted(map(str, before.collect()))  # idempotent
    assert snapshots.manifest(spark, str(tmp_path / "out/curves"))[0] == 2
    assert spark.read.parquet(str(tmp_path / "out/orders")).columns == replay.ORDER_COLUMNS
    text = store.summary_json(found["summary"])
    assert '"n_trades": 1' in text and '"closed": [' in text
    row = found["summary"].first()
    assert (row.start_date, row.end_date, row.initial_cash) == ("2022-01-01", "2022-02-01", 1e7) and row.held == [] and [x.code for x in row.closed] == ["A"]
    size = int(1e7 / (10 * 1.0003))
    assert row.total_commission == round(size * 21 * 0.0003, 2) and row.final_value == round(1e7 + size * 1 - size * 21 * 0.0003, 2) and row.gross_final_value == round(row.final_value + row.total_commission, 2)
    log = spark.read.parquet(str(tmp_path / "out/orders")).orderBy("date").collect()
    assert [round(r.portfolio_value_after) for r in log] == [round(1e7 - size * 10 * 0.0003), round(row.final_value)]
    assert {r.position_size for r in spark.read.parquet(str(tmp_path / "out/positions")).collect()} == {float(size)}
    for bad in ({"start_date": "2022-03-01"}, {"adopt_model": "no"}, {"codes": ["zz"]}, {"buy_rules": []}):
        with pytest.raises(ValueError):
            run(**bad)
    assert api.models(spark).count() == len(api.MODELS)


def test_range_frame(spark, tmp_path):
    """Prices reach back and ahead, only near segments enter the factor, the mask sees the year behind the end, and the frame ends before it."""
    days = bars(spark, [8.0] * 8, start=date(2020, 12, 20)).union(bars(spark, [10.0] * 8, start=date(2021, 6, 1))).union(bars(spark, [5.0] * 6, start=date(2022, 1, 3)))
    days = days.union(days.withColumn("htsc_code", F.lit("B")))
    parts = lambda df: df.withColumns({"year": F.date_format("time", "yyyy"), "month": F.date_format("time", "MM")})
    parts(days).write.partitionBy("year", "month").parquet(str(tmp_path / "prices"))
    long = parts(days.select("htsc_code", "time", F.lit("x").alias("factor"), F.lit("2").alias("value")))
    long.write.partitionBy("factor", "year", "month").parquet(str(tmp_path / "factors"))
    seg = spark.createDataFrame([("a", date(2010, 1, 1), date(2010, 2, 1), 7.0), ("A", date(2020, 12, 1), date(2020, 12, 31), 2.0), ("A", date(2021, 1, 1), date(2022, 12, 31), 1.5)], "htsc_code string, begin_date date, end_date date, xdy double")
    (tmp_path / "seg").mkdir()
    seg.write.parquet(str(tmp_path / "seg" / store.SEGMENT_FILE))
    found = api.range_frame(spark, ["A", "b"], "2021-05-01", "2022-01-01", ["x"], str(tmp_path / "prices"), str(tmp_path / "factors"), str(tmp_path / "seg"), look_back=140)
    rows = found.orderBy("htsc_code", "time").collect()
    assert [r.time for r in rows[:13]] == [date(2020, 12, 20) + timedelta(k) for k in range(8)] + [date(2021, 6, 1) + timedelta(k) for k in range(5)]
    assert max(r.time for r in rows) == date(2021, 6, 8) and {r.x for r in rows} == {2.0}
    a = {r.time: r.close for r in rows if r.htsc_code == "A"}
    assert (a[date(2020, 12, 21)], a[date(2021, 6, 1)], a[date(2021, 6, 5)]) == (16.0, 30.0, 10.0)  # the fifth is a Saturday
    blocked = {(r.htsc_code, r.time) for r in rows if r.block_halving_future_buy}
    assert blocked == {("B", date(2021, 6, k)) for k in (6, 7, 8)}  # A's fifth closes are 10 and, adjusted, 7.5
    plain = api.range_frame(spark, spark.createDataFrame([(" b",)], "htsc_code string"), "2021-05-01", "2022-01-01", ["x"], str(tmp_path / "prices"), str(tmp_path / "factors"), None, mask=False)
    assert plain.agg(F.sum("close"), F.sum("block_halving_future_buy"), F.count("*")).first()[:] == (80.0, 0.0, 8)


def test_sweep_confirms_runs(spark):
    """The best trial's profit is that of a run with its rules, under the mask and the gate of the model."""
    closes = [10.0, 10.5, 11.0, 10.4, 10.9, 11.4, 12.8, 12.9, 12.0, 12.5]
    b = bars(spark, closes).union(bars(spark, closes[::-1], "B"))
    long = b.select("htsc_code", "time", F.explode(F.array(*map(F.lit, "pqs"))).alias("factor"), "close")
    value = F.when(F.col("factor") == "p", (F.col("close") < 10.6).cast("int")).when(F.col("factor") == "q", (F.col("close") < 12.1).cast("int")).otherwise((F.col("close") > 12.4).cast("int"))
    long = long.withColumn("value", value.cast("double")).drop("close")
    rules = {"p": Rule("p"), "q": Rule("q")}
    for model in [m for m in api.MODELS.values() if m.sweeps]:
        trials, best = api.run_sweep(b, long, list(rules.values()), [Rule("s")], model)
        best = best.first()
        buy = [r for k, r in enumerate(rules.values()) if best.buy_mask >> k & 1]
        trades = api.backtest(b, long, buy, [Rule("s")], model)["trades"].agg(F.count("*").alias("n"), F.sum("pnlcomm").alias("p")).first()
        assert (best.n_trades, round(best.profit, 4)) == (trades.n, round(trades.p or 0.0, 4)) and trials.count() == 3


def test_pool(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,证券代码\nx, a.sz\ny,A.SZ\n")
    assert [r[0] for r in store.pool(spark, str(tmp_path / "p.csv")).collect()] == ["A.SZ"]


def test_upsert_last_wins(spark):
    days = spark.createDataFrame([(date(2022, 1, 3), 1.0)], "date date, portfolio_value double").withColumns({"cash_value": F.lit(None).cast("double"), "benchmark_value": F.lit(None).cast("double")})
    old = curves.all_curves(days, "r", 1.0)
    new = old.withColumn("close", F.lit(2.0))
    assert [r.close for r in store.merged_curves(old, new).collect()] == [2.0]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = hourly(stream).writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r)[:3] for r in spark.table("bars").collect()} == {tuple(r)[:3] for r in hourly(events).collect()}
