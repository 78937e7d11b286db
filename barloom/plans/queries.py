"""The registered queries: each operator over whole tables, through the adapters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.operators import calendar, curves, frames, metrics, replay, study, sweep
from barloom.operators.frames import Rule
from barloom.plans import adapters as A
from barloom.sources.scratch import removed, saved, shared_folder
from barloom.sources.store import day, extended, merged_curves

Spark, Dir = SparkSession, str
BUY, SELL = [Rule("R", 2), Rule("F", 3), Rule("N", 2)], [Rule("A", 3), Rule("O", 4)]


def _round(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _frame(spark: Spark, d: Dir) -> DataFrame:
    return frames.with_factors(A.bars(spark, d), frames.wide_factors(A.factors(spark, d), A.FACTORS), A.FACTORS)


def price_scan(spark: Spark, d: Dir) -> DataFrame:
    """Bars of a half-open range, codes matched after normalising."""
    bars = A.bars(spark, d).withColumn("htsc_code", S.code(F.lower(F.concat(F.lit(" "), "htsc_code"))))
    return _round(bars.where((F.col("time") >= F.lit("1996-01-01").cast("date")) & (F.col("time") < F.lit("2000-01-01").cast("date"))))


def factor_wide(spark: Spark, d: Dir) -> DataFrame:
    """Long factors as columns."""
    return frames.wide_factors(A.factors(spark, d), A.FACTORS)


def signal_frame(spark: Spark, d: Dir) -> DataFrame:
    """Bars with factors, mask and combined signals."""
    frame = frames.halving_mask(_frame(spark, d))
    frame = frame.withColumns({"strong_buy_signal": frames.rules_hit(BUY, "and").cast("double"), "strong_sell_signal": frames.rules_hit(SELL, "or").cast("double")})
    return _round(frame.select("htsc_code", "time", "close", *A.FACTORS, "block_halving_future_buy", "strong_buy_signal", "strong_sell_signal"))


def segment_products(spark: Spark, d: Dir) -> DataFrame:
    """Running and later products of the segments that overlap a window, of codes with bars in it."""
    a, b = F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")
    traded = A.bars(spark, d).where(F.col("time").between(a, b)).select("htsc_code").distinct()
    near = frames.overlapping(A.segments(spark, d).unionByName(A.odd_segments(spark, d)), a, b).join(traded, "htsc_code", "left_semi")
    return _round(frames.segment_factors(near))


def adjusted_backward(spark: Spark, d: Dir) -> DataFrame:
    """J9, D3, J2, C19."""
    return _round(frames.adjusted(A.bars(spark, d), A.segments(spark, d), "backward"))


def adjusted_forward(spark: Spark, d: Dir) -> DataFrame:
    """J9, D3, J2, C19."""
    return _round(frames.adjusted(A.bars(spark, d), A.segments(spark, d), "forward"))


def halving_mask(spark: Spark, d: Dir) -> DataFrame:
    """F5, F6."""
    return frames.halving_mask(A.bars(spark, d)).select("htsc_code", "time", "block_halving_future_buy")


def initial_backscan(spark: Spark, d: Dir) -> DataFrame:
    """At most 50 codes, as the operator defines."""
    return _round(frames.backscan(_frame(spark, d), F.lit("2000-01-01").cast("date"), "R", "O"))


def move_gate(spark: Spark, d: Dir) -> DataFrame:
    """C22, F7."""
    return frames.move_gate(A.bars(spark, d)).select("htsc_code", "time", "tradable")


def last_known_close(spark: Spark, d: Dir) -> DataFrame:
    """the last close on every day of the table."""
    bars = saved(A.bars(spark, d), "bars")
    return _round(frames.last_known(bars, bars.select("time").distinct()))


def daily_returns(spark: Spark, d: Dir) -> DataFrame:
    """F2, J10."""
    return _round(metrics.returns(A.daily_values(spark, d), ["code"]).select("code", "date", "ret"), 9)


def risk_metrics(spark: Spark, d: Dir) -> DataFrame:
    """Per security, against the mean of all as benchmark."""
    values = A.daily_values(spark, d)
    r = metrics.returns(values, ["code"])
    bench = r.groupBy("date").agg(F.avg("ret").alias("bench"))
    joined = r.join(bench, "date").withColumn("active", F.col("ret") - F.col("bench"))
    stats = joined.groupBy("code").agg(
        metrics.sharpe(F.col("ret")).alias("sharpe"), metrics.sortino(F.col("ret")).alias("sortino"), metrics.information_ratio(F.col("active")).alias("information_ratio"),
        F.avg(F.pow(F.least(F.col("active"), F.lit(0.0)), 2)).alias("downside"), F.product(1 + F.col("bench")).alias("bench_growth"), F.count("*").alias("n"),
    )
    ends = values.groupBy("code").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"))
    out = stats.join(ends, "code").join(metrics.drawdown(values, ["code"]), "code")
    out = out.withColumn("annual_pct", metrics.annualised(F.col("first"), F.col("last"), F.col("n")))
    total = F.col("last") / F.col("first") - 1
    score = metrics.excess_score(total - (F.col("bench_growth") - 1), F.col("downside"))
    out = out.withColumns({"calmar": metrics.calmar(F.col("annual_pct"), F.col("max_drawdown_pct")), "total_return": total, "excess_score": score})
    out = out.withColumn("score", metrics.weighted_score(F.col("calmar"), F.col("sortino"), F.col("sharpe")))
    keep = ["sharpe", "sortino", "information_ratio", "max_drawdown_pct", "max_drawdown_money", "annual_pct", "calmar", "total_return", "excess_score", "score"]
    return _round(out.select("code", *keep), 5)


def trade_metrics(spark: Spark, d: Dir) -> DataFrame:
    """E2, E12, E13, E16, E23 per security."""
    t = A.trade_log(spark, d)
    return _round(t.groupBy("code").agg(
        metrics.win_rate(F.col("pnlcomm")).alias("win_rate"), metrics.profit_loss_ratio(F.round("pnlcomm", 4)).alias("profit_loss_ratio"),
        F.avg("barlen").alias("mean_bars"), F.median("barlen").alias("median_bars"), F.count("*").alias("n_trades"), F.sum("pnlcomm").alias("realised_pnl"),
    ), 4)


def buy_costs(spark: Spark, d: Dir) -> DataFrame:
    """E1, C9."""
    return _round(metrics.buy_costs(A.order_log(spark, d)), 2)


def closed_trades(spark: Spark, d: Dir) -> DataFrame:
    """Securities count as still held if they were bought oftener, less sales, than the mean security."""
    log = A.order_log(spark, d)
    balance = log.groupBy("code").agg(F.sum(F.when(F.col("side") == "buy", 1).otherwise(-1)).alias("n"))
    mean = balance.agg(F.avg("n").alias("mean"))
    held = balance.join(F.broadcast(mean), F.col("n") > F.col("mean"))  # one row
    return _round(metrics.closed_trades(A.trade_log(spark, d), log, held, F.lit(1e6)), 4)


def turnover(spark: Spark, d: Dir) -> DataFrame:
    """Yearly turnover, and the mean share of a sum in a value, per security."""
    log = A.order_log(spark, d).groupBy("code").agg(F.sum(F.abs("executed_value")).alias("moved"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    value = A.daily_values(spark, d).groupBy("code").agg(F.avg("value").alias("mean_value"), F.avg(S.ratio(F.lit(1e6), F.col("value"))).alias("cash_ratio"))
    rate = F.col("moved") / F.col("mean_value") / (F.greatest("days", F.lit(1)) / 365.25)
    return _round(log.join(value, "code").select("code", rate.alias("turnover"), "cash_ratio"), 6)


def _replayed(spark: Spark, d: Dir) -> dict[str, DataFrame]:
    """A rule strategy's order log, positions and days. Bars with factors, log, what is held on bars (a row per security and
    bar) and days (a row each) are written once for all that read them."""
    frame = saved(frames.with_factors(A.bars(spark, d).select("htsc_code", "time", "close"), frames.wide_factors(A.factors(spark, d), [BUY[0].factor, SELL[0].factor]), [BUY[0].factor, SELL[0].factor]), "frame")
    log = saved(replay.orders(frame, frames.rules_hit(BUY[:1]), frames.rules_hit(SELL[:1]), 1e6), "orders")
    own = saved(replay.held(log, frame, replay.hold_from(frame)), "held")
    values = replay.on_days(own)
    daily = saved(replay.days(values, log), "days")
    removed(frame)
    return {"log": log, "positions": replay.positions(values), "daily": daily}


def signal_orders(spark: Spark, d: Dir) -> DataFrame:
    """K9 as windows, M8: the order log of a rule strategy."""
    log = replay.orders(_frame(spark, d), frames.rules_hit(BUY[:1]), frames.rules_hit(SELL[:1]), 1e6)
    return _round(log.select("date", "code", "side", "executed_size", "executed_price", "executed_value", "commission", "position_after"))


def signal_trades(spark: Spark, d: Dir) -> DataFrame:
    """Its closed trades."""
    return _round(replay.trades(replay.orders(_frame(spark, d), frames.rules_hit(BUY[:1]), frames.rules_hit(SELL[:1]), 1e6)))


def daily_log(spark: Spark, d: Dir) -> DataFrame:
    """Its daily cash and values."""
    return _round(_replayed(spark, d)["daily"].drop("benchmark_value"), 2)


def order_account(spark: Spark, d: Dir) -> DataFrame:
    """G1, M8: the order log with the account at the end of each order's day."""
    run = _replayed(spark, d)
    return _round(replay.with_account(run["log"], run["daily"]).select("date", "code", "side", "executed_value", "cash_after", "portfolio_value_after"), 2)


def position_log(spark: Spark, d: Dir) -> DataFrame:
    """Its positions with derived columns."""
    run = _replayed(spark, d)
    out = frames.position_log(run["positions"], run["daily"], "run")
    return _round(out.withColumns({c: F.round(c, 2) for c in ("cash_value", "portfolio_value")}))


def open_positions(spark: Spark, d: Dir) -> DataFrame:
    """What is held on the last day, with weight, return and contribution."""
    run = _replayed(spark, d)
    last = run["daily"].agg(F.max("date").alias("date"), F.max_by("portfolio_value", "date").alias("final"))
    held = frames.position_log(run["positions"], run["daily"], "run").join(F.broadcast(last), "date")  # one row
    out = metrics.held_positions(held, _round(replay.trades(run["log"])), F.col("final"), F.col("final") - replay.CASH)
    shares = {c: F.round(c, 8) for c in ("weight", "return", "contribution")}
    return _round(out.select("code", "date", "position_size", "close", "market_value", "unrealized_pnl", "realised_pnl", "total_pnl", *shares).withColumns({c: F.round(c, 2) for c in ("close", "market_value", "unrealized_pnl", "realised_pnl", "total_pnl")} | shares))


def run_summary(spark: Spark, d: Dir) -> DataFrame:
    """All figures of the strategy's run against buy and hold."""
    run = _replayed(spark, d)
    m = metrics.run_metrics(run["daily"], run["log"], replay.trades(run["log"]), replay.CASH)
    return _round(m.withColumns({c: F.round(c, 2) for c in MONEY}), 6)


MONEY = ["final_value", "gross_final_value", "total_commission", "benchmark_value", "max_drawdown_money"]
YEARS = [1996, 1997, 1998, 1999, 2000]


def yearly_runs(spark: Spark, d: Dir) -> DataFrame:
    """The figures of a run of each year, all in one plan: adjusted by the year's own segments, masked, with 60 days before."""
    spans = [frames.Span(str(y), day(f"{y}-01-01"), day(f"{y + 1}-01-01"), *extended(f"{y}-01-01", f"{y + 1}-01-01", 60, 13)) for y in YEARS]
    by = ["run"]
    bars = saved(A.bars(spark, d).select("htsc_code", "time", "close"), "bars")
    frame = saved(frames.frame_of_runs(bars, A.segments(spark, d), A.factors(spark, d), ["R", "A"], spans), "years").where("started")
    removed(bars)
    log = saved(replay.orders(frame, frames.rules_hit(BUY[:1]) & (F.col("block_halving_future_buy") == 0), frames.rules_hit(SELL[:1]), 1e5, by), "orders")
    values = replay.valued(log, frame, replay.hold_from(frame, by), by)
    m = metrics.run_metrics(saved(replay.days(values, log, by), "days"), log, replay.trades(log, by), replay.CASH, by)
    return _round(m.withColumns({c: F.round(c, 2) for c in MONEY}), 6)


def path_exits(spark: Spark, d: Dir) -> DataFrame:
    """K9: orders whose exits depend on what was paid."""
    log = replay.exits(_frame(spark, d), frames.rules_hit(BUY[:1]), F.col("A") >= 1, 1e6)
    return _round(log.select("date", "code", "signal", "side", "executed_size", "executed_price", "position_after", "bar"))


def bar_gaps(spark: Spark, d: Dir) -> DataFrame:
    """bars' ordinals, and the market's days that a security missed before each."""
    return calendar.gaps(A.bars(spark, d))


def bar_look_back(spark: Spark, d: Dir) -> DataFrame:
    """A3 in bars: bars of 1997 on, and of each security the 20 before."""
    return _round(calendar.look_back(A.bars(spark, d), day("1997-01-01"), 20))


def range_frame(spark: Spark, d: Dir) -> DataFrame:
    """A run's bars with 1100 days before and, for the mask, 14 months behind, adjusted, masked and clipped."""
    start, last = extended("1996-01-01", "1998-01-01", 1100, 14)
    out = frames.range_frame(A.bars(spark, d), A.segments(spark, d), A.factors(spark, d), A.FACTORS, start, day("1998-01-01"), last)
    return _round(out, 6)


def _stored(spark: Spark, d: Dir, names: dict[str, str]) -> DataFrame:
    """The long factors under the names that storage gives them."""
    return frames.named_factors(A.factors(spark, d), dict(zip(A.FACTORS, names)))


def legacy_frame(spark: Spark, d: Dir) -> DataFrame:
    """Bars with the older frame's factors, found by their stored names."""
    return _round(frames.legacy_frame(A.bars(spark, d), _stored(spark, d, frames.LEGACY_NAMES)))


def seven_factor_frame(spark: Spark, d: Dir) -> DataFrame:
    """Bars with the factors of the rule models, found by their stored names; two of them are stored nowhere."""
    return _round(frames.seven_factor_frame(A.bars(spark, d), _stored(spark, d, frames.FACTOR_NAMES)))


def strong_signals(spark: Spark, d: Dir) -> DataFrame:
    """Strong signals of rules, which also become the total buy signal."""
    frame = _frame(spark, d).withColumnsRenamed({"N": "total_buy_signal", "O": "total_sell_signal"})
    out = frames.with_strong_signals(frame, BUY[:2], SELL[:1], "or", "or")
    return out.select("htsc_code", "time", "total_buy_signal", "strong_buy_signal", "total_sell_signal", "strong_sell_signal")


def buy_and_hold(spark: Spark, d: Dir) -> DataFrame:
    """K10, K11."""
    bars = saved(A.bars(spark, d), "bars")
    return _round(replay.buy_and_hold(bars), 2)


def equity_curves(spark: Spark, d: Dir) -> DataFrame:
    """J10, J11, H1, C21, M12."""
    run = _replayed(spark, d)
    return _round(curves.all_curves(run["daily"], "run", replay.CASH), 6)


def curve_upsert(spark: Spark, d: Dir) -> DataFrame:
    """Adjusted bars merged over raw ones, keyed by code and day; new rows win."""
    bars = A.bars(spark, d)
    return _round(merged_curves(bars, frames.adjusted(bars.where(F.year("time") >= 1998), A.segments(spark, d), "backward")))


def rule_sweep(spark: Spark, d: Dir) -> DataFrame:
    """Every subset of buy rules with every subset of sell rules."""
    return _round(sweep.sweep(_frame(spark, d), BUY, SELL, 1e6), 2)


def study_states(spark: Spark, d: Dir) -> DataFrame:
    """L1: a study in blocks, with a rule whose factor no frame has: its trials fail, alone, and the others' scores stand."""
    folder = f"{shared_folder(spark)}/study-{uuid.uuid4().hex}"
    found = study.Study(saved(_frame(spark, d), "frame"), [*BUY[:2], Rule("Z")], SELL, 1e6, folder, block=8).run()
    return _round(found.select("trial", "buy_mask", "sell_mask", "state", "n_trades", "profit"), 2)


def best_trial(spark: Spark, d: Dir) -> DataFrame:
    """The best of the sweep."""
    return _round(sweep.best(sweep.sweep(_frame(spark, d), BUY, SELL, 1e6)), 2)


def rule_subsets(spark: Spark, d: Dir) -> DataFrame:
    """H5: non-empty subsets of the factors that each security has, smaller ones first."""
    names = A.factors(spark, d).groupBy("htsc_code").agg(F.sort_array(F.collect_set("factor")).alias("names"))
    out = names.select("htsc_code", F.posexplode(sweep.subsets(F.col("names"))).alias("at", "s"))
    return out.select("htsc_code", "at", F.col("s.size").cast("int").alias("size"), F.array_join("s.names", "+").alias("names"))


def run_names(spark: Spark, d: Dir) -> DataFrame:
    """Names of runs from each customer's order dates and priorities."""
    o = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"), F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    name = F.concat(S.period_name(F.col("a"), F.col("b")), S.run_suffix(F.slice("p", 1, 2), F.slice("p", 3, 1)))
    stripped = S.without_period(F.concat(S.period_name(F.col("a"), F.col("b")), F.lit("_"), F.element_at("p", 1)), F.col("a"), F.col("b"))
    return o.select("o_custkey", name.alias("name"), stripped.alias("stripped"), S.path_name(F.concat(F.lit("a/b:"), F.element_at("p", 1), F.lit(" ."))).alias("path"))


def month_partitions(spark: Spark, d: Dir) -> DataFrame:
    """The months of each security's span."""
    span = A.bars(spark, d).groupBy("htsc_code").agg(F.min("time").alias("a"), F.max("time").alias("b"))
    out = span.select("htsc_code", F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m"))
    return out.select("htsc_code", F.date_format("m", "yyyy").alias("year"), F.date_format("m", "MM").alias("month"))


def profit_json(spark: Spark, d: Dir) -> DataFrame:
    """Profit per security, as one JSON text each."""
    t = A.trade_log(spark, d).groupBy("code").agg(F.sum(F.round(F.col("pnlcomm") * 10000).cast("long")).alias("p"))
    return t.select("code", F.to_json(F.struct(F.col("code"), F.col("p").alias("pnl"))).alias("json"))


def top_trades(spark: Spark, d: Dir) -> DataFrame:
    """The ten most profitable trades of each security, ties by dates."""
    t = A.trade_log(spark, d).withColumn("pnlcomm", F.round("pnlcomm", 4))
    w = Window.partitionBy("code").orderBy(F.desc("pnlcomm"), "date_open", "date_close")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("code", "rank", "pnlcomm", "date_open", "date_close")


def top_trades_json(spark: Spark, d: Dir) -> DataFrame:
    """The three most profitable trades of each security as one JSON text, profits in hundredths of a cent."""
    t = A.trade_log(spark, d).select("code", F.round(F.col("pnlcomm") * 10000).cast("long").alias("pnl"), "date_open", "date_close")
    w = Window.partitionBy("code").orderBy(F.desc("pnl"), "date_open", "date_close")
    best = t.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    listed = best.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("rank", "pnl", "date_open", "date_close"))).alias("top"))
    return listed.select("code", F.to_json("top").alias("json"))


def summary_format(spark: Spark, d: Dir) -> DataFrame:
    """Shares of returned lines as percent texts."""
    by = A.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"), F.count("*").alias("n"))
    v = F.col("r") / F.col("n")
    return by.select("l_suppkey", S.percent(v).alias("share"), S.shown(F.col("n") / S.ratio(F.lit(7.0), F.lit(2.0))).alias("scaled"))


def user_bars(spark: Spark, d: Dir) -> DataFrame:
    """An addition to the reference: hourly bars of the event stream, in batch."""
    from barloom.streaming.bars import hourly

    return _round(hourly(A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total"), 4)


QUERIES = {f.__name__: f for f in (
    price_scan, factor_wide, signal_frame, segment_products, adjusted_backward, adjusted_forward, halving_mask, initial_backscan,
    move_gate, last_known_close, daily_returns, risk_metrics, trade_metrics, buy_costs, closed_trades, turnover, signal_orders,
    signal_trades, daily_log, order_account, position_log, open_positions, run_summary, yearly_runs, path_exits, bar_gaps, bar_look_back, range_frame, legacy_frame, seven_factor_frame, strong_signals, buy_and_hold, equity_curves, curve_upsert, rule_sweep, study_states, best_trial,
    rule_subsets, run_names, month_partitions, profit_json, top_trades, top_trades_json, summary_format, user_bars,
)}
