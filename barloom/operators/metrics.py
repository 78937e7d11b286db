"""Risk and trade metrics as aggregations; undefined ones are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import TRADING_DAYS, number, ratio
from barloom.operators import summaries

YEAR = TRADING_DAYS**0.5


def returns(values: DataFrame, group: list[str], day: str = "date", value: str = "value") -> DataFrame:
    """Day-on-day returns of positive running values, the first of a group left out."""
    prev = F.lag(value).over(Window.partitionBy(*group).orderBy(day))
    return values.where(F.col(value).isNotNull()).withColumn("ret", ratio(F.col(value), prev) - 1).where("ret IS NOT NULL")


def sharpe(r: Column) -> Column:
    return ratio(F.avg(r), F.stddev_samp(r)) * YEAR


def sortino(r: Column) -> Column:
    return ratio(F.avg(r), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))) * YEAR


def information_ratio(active: Column) -> Column:
    return ratio(F.avg(active), F.stddev_samp(active)) * YEAR


def excess_score(excess: Column, downside_variance: Column) -> Column:
    """sign(x) log(1 + |x|) of the excess cumulative return over the downside variance of active returns."""
    x = F.when(downside_variance > 0, excess / downside_variance)
    return F.signum(x) * F.log1p(F.abs(x))


def annualised(first: Column, last: Column, periods: Column) -> Column:
    """Per cent a year, by continuous compounding over the number of periods."""
    return 100 * (F.exp(F.log(F.when(first > 0, last / first)) / periods * TRADING_DAYS) - 1)


def drawdown(values: DataFrame, group: list[str], day: str = "date", value: str = "value") -> DataFrame:
    """Largest fall from a running peak, in per cent, and the money at that place."""
    peak = F.max(value).over(Window.partitionBy(*group).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    falls = values.withColumn("_peak", peak).withColumns({"_money": F.col("_peak") - F.col(value)}).withColumn("_pct", ratio(F.col("_money"), F.col("_peak")) * 100)
    return falls.groupBy(*group).agg(F.max("_pct").alias("max_drawdown_pct"), F.max(F.struct("_pct", "_money"))["_money"].alias("max_drawdown_money"))


def calmar(annual_pct: Column, drawdown_pct: Column) -> Column:
    return ratio(annual_pct / 100, F.abs(drawdown_pct) / 100)


def weighted_score(calmar_: Column, sortino_: Column, sharpe_: Column) -> Column:
    return 0.45 * calmar_ + 0.4 * sortino_ + 0.15 * sharpe_


def win_rate(pnl: Column) -> Column:
    return F.avg(F.when(pnl > 0, 1.0).when(pnl.isNotNull(), 0.0))


def profit_loss_ratio(pnl: Column) -> Column:
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.abs(F.sum(F.when(pnl < 0, pnl).otherwise(0.0)))
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf")))


def buy_costs(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Money spent on completed buys, with commissions, by code."""
    done = orders.where((F.upper("status") == "COMPLETED") & (F.upper("side") == "BUY"))
    return done.groupBy(*by, "code").agg(F.sum(F.abs(number(F.col("executed_value"))) + number(F.col("commission"))).alias("buy_cost"))


def closed_trades(trades: DataFrame, orders: DataFrame, still_open: DataFrame, profit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per code that is no longer held: profit, trades, dates, bars held, return on cost, share of the total profit."""
    keys = [*by, "code"]
    closed = trades.join(still_open.select(*keys).distinct(), keys, "left_anti")
    out = closed.groupBy(*keys).agg(
        F.sum(number(F.col("pnlcomm"))).alias("pnl"), F.count("*").alias("trades"), F.min("date_open").alias("first_open"),
        F.max("date_close").alias("last_close"), F.sum("barlen").alias("bars"),
    )
    out = out.join(buy_costs(orders, by), keys, "left")
    return out.withColumns({"return_pct": ratio(F.col("pnl"), F.coalesce("buy_cost", F.lit(0.0))), "contribution": ratio(F.col("pnl"), profit)})


def open_positions(positions: DataFrame, trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positions of the last logged day, with realised and total profit."""
    last = F.broadcast(positions.groupBy(*by).agg(F.max("date").alias("date")))  # one row, or one a run
    gains = trades.groupBy(*by, "code").agg(F.sum(number(F.col("pnlcomm"))).alias("realised_pnl"))
    out = positions.join(last, [*by, "date"]).join(gains, [*by, "code"], "left")
    out = out.withColumn("realised_pnl", F.coalesce("realised_pnl", F.lit(0.0)))
    return out.withColumn("total_pnl", F.col("realised_pnl") + number(F.col("unrealized_pnl")))


def held_positions(positions: DataFrame, trades: DataFrame, final_value: Column, profit: Column, by: Sequence[str] = ()) -> DataFrame:
    """open_positions() with weight, return and contribution; what a log lacks or leaves null follows from the rest.

    final_value and profit may read columns of positions. Weights fall back to market value over the final value, returns to
    profit over cost, unrealised profit to market value less cost.
    """
    have = lambda c: F.col(c).cast("double") if c in positions.columns else F.lit(None).cast("double")
    cost = number(have("position_size")) * number(have("position_price"))
    filled = positions.withColumn("unrealized_pnl", F.coalesce(have("unrealized_pnl"), number(F.col("market_value")) - cost))
    filled = filled.withColumns({
        "weight": F.coalesce(have("weight_pct"), ratio(number(F.col("market_value")), final_value)),
        "return": F.coalesce(have("unrealized_return_pct"), ratio(number(F.col("unrealized_pnl")), cost)),
    })
    return open_positions(filled, trades, by).withColumn("contribution", ratio(F.col("total_pnl"), profit))


def run_metrics(daily: DataFrame, orders: DataFrame, trades: DataFrame, cash: float, by: Sequence[str] = ()) -> DataFrame:
    """One row of all figures of a run, or one for each of several runs, by the columns that tell them apart.

    daily: (date, cash_value, portfolio_value, benchmark_value); values start from `cash`, and the benchmark may begin later.
    Figures that need two days, a loss or a trade are null without; the active ones are over days that both series have.
    daily is read once: the path's figures are merged from those of its months.
    """
    keys = list(by) or ["g"]
    keyed = lambda df: df if by else df.withColumn("g", F.lit(1))
    daily = keyed(daily)
    month = F.date_format("date", summaries.MONTH)
    path = summaries.folded(summaries.chunked(daily, keys, "date", "portfolio_value", "benchmark_value", month), keys)
    ends = daily.groupBy(*keys).agg(
        F.avg(ratio(F.col("cash_value"), F.col("portfolio_value"))).alias("average_cash_ratio"), F.avg("portfolio_value").alias("mean_value"), F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)).alias("days"),
    )
    spent = keyed(orders).groupBy(*keys).agg(F.sum(number(F.col("commission"))).alias("total_commission"), F.sum(F.abs("executed_value")).alias("moved"))
    done = keyed(trades).groupBy(*keys).agg(
        win_rate(F.col("pnlcomm")).alias("win_rate"), profit_loss_ratio(F.col("pnlcomm")).alias("profit_loss_ratio"), F.count("*").alias("n_trades"),
        F.avg("barlen").alias("mean_bars"), F.median("barlen").alias("median_bars"),
    )
    out = path.select(*keys, *(c.alias(n) for n, c in summaries.figures(F.col("s"), YEAR).items()))
    for more in (ends, spent, done):  # of one row a run each
        out = out.join(more, keys, "left")
    out = out.fillna({"total_commission": 0.0, "n_trades": 0})
    annual = annualised(F.col("first_value"), F.col("final_value"), F.col("periods"))
    out = out.withColumns({
        "gross_final_value": F.col("final_value") + F.col("total_commission"), "net_return": F.col("final_value") / cash - 1,
        "gross_return": (F.col("final_value") + F.col("total_commission")) / cash - 1, "benchmark_return": F.col("benchmark_value") / cash - 1,
        "annual_pct": annual, "calmar": calmar(annual, F.col("max_drawdown_pct")), "turnover": F.when(F.col("moved") > 0, ratio(F.col("moved"), F.col("mean_value")) / (F.col("days") / 365.25)),
    })
    out = out.withColumns({"excess_score": excess_score(F.col("net_return") - F.col("benchmark_return"), F.when(F.col("active_days") > 1, F.col("downside"))), "score": weighted_score(F.col("calmar"), F.col("sortino"), F.col("sharpe"))})
    return out.drop("g", "downside", "active_days", "periods", "mean_value", "days", "moved", "first_value")
