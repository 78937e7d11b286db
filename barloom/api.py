"""Entry points: model registry, configured runs, sweeps, and the command line.

A model is a choice of mask and gate over the same plan: bars, adjustment, factors, rules, orders as windows, metrics.
"""

from __future__ import annotations

import argparse
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import percent, ratio, shown
from barloom.operators import curves, frames, metrics, replay, study, sweep
from barloom.operators.frames import Rule
from barloom.sources import store
from barloom.sources.scratch import removed, saved


#: An order log as models give it, besides the columns that tell runs apart.
ORDER_TYPES = {"date": "date", "code": "string", "signal": "string", "status": "string", "side": "string", "created_size": "bigint", "executed_size": "bigint", "executed_price": "double", "executed_value": "double", "commission": "double", "position_after": "bigint", "bar": "int"}


@dataclass(frozen=True)
class Model:
    """id and title, whether buys are masked after halvings, and whether days of large moves don't trade.

    prepare turns a frame into one that also has what the model needs, of the same bars. strategy turns a frame, its buy and
    sell conditions, the budget of a security and the names of the columns that tell runs apart into an order log.
    """

    id: str
    title: str
    mask: bool = False
    gate: bool = False
    runnable: bool = True
    prepare: Callable[[DataFrame], DataFrame] | None = None
    strategy: Callable[[DataFrame, Column, Column, Column, Sequence[str]], DataFrame] = replay.orders
    sweeps: bool = True


MODELS = {m.id: m for m in (
    Model("signal_rules", "Buy and sell rules on factors"),
    Model("signal_rules_masked", "Rules, with no buys after a halving (looks ahead by design)", mask=True),
    Model("signal_rules_gated", "Rules, with no orders on days of large moves", gate=True),
    Model("configurable_exits", "Rules, with exits by the gain on the entry price", strategy=replay.exits, sweeps=False),
)}


def register(model: Model) -> Model:
    """Add a model, for configured runs and sweeps; ValueError if its id is taken or is none."""
    if not model.id.strip() or model.id in MODELS:
        raise ValueError(f"model {model.id!r} is registered already, or has no name")
    MODELS[model.id] = model
    return model


def prepared(frame: DataFrame, model: Model) -> DataFrame:
    """model.prepare(frame); ValueError if it loses or retypes columns. Only the plan is looked at."""
    if model.prepare is None:
        return frame
    out = model.prepare(frame)
    types = dict(out.dtypes)
    wrong = [c for c, t in frame.dtypes if types.get(c) != t]
    if wrong:
        raise ValueError(f"model {model.id} loses or retypes {', '.join(wrong)}")
    return out


def ordered(frame: DataFrame, buy: Column, sell: Column, budget: Column, model: Model, by: Sequence[str] = ()) -> DataFrame:
    """The order log of a model's strategy; ValueError if a column is missing or of another type."""
    out = model.strategy(frame, buy, sell, budget, by)
    types = dict(out.dtypes)
    wrong = [c for c, t in ORDER_TYPES.items() if types.get(c) != t] + [c for c in by if c not in types]
    if wrong:
        raise ValueError(f"the orders of model {model.id} lack {', '.join(wrong)}, or have other types there")
    return out


def models(spark: SparkSession) -> DataFrame:
    """The registry as a table, in its order."""
    return spark.createDataFrame([(i, m.id, m.title, m.mask, m.gate, m.runnable) for i, m in enumerate(MODELS.values())], "rank int, id string, title string, mask boolean, gate boolean, runnable boolean")


def rules_of(items: object) -> list[Rule]:
    """Rules from a request: the first of each factor, thresholds finite numbers, 1 by default; null is none."""
    if items is None:
        return []
    if not isinstance(items, list):
        raise ValueError("rules must be a list")
    found: dict[str, Rule] = {}
    for item in items:
        if not isinstance(item, dict):
            raise ValueError("a rule must be an object")
        factor = str(item.get("factor") or "").strip()
        if not factor:
            raise ValueError("a rule needs a factor")
        try:
            threshold = float(item.get("threshold", 1))
        except (TypeError, ValueError):
            raise ValueError(f"the threshold of {factor} is not a number") from None
        if not math.isfinite(threshold):
            raise ValueError(f"the threshold of {factor} is not finite")
        found.setdefault(factor, Rule(factor, threshold))
    return list(found.values())


def operator_of(value: object, default: str) -> str:
    return "or" if str(value or default).strip().lower() == "or" else "and"


def frame(bars: DataFrame, long_factors: DataFrame, names: list[str], model: Model) -> DataFrame:
    """Bars with factors and the columns that the model needs; bars that have a mask keep theirs."""
    out = frames.with_factors(bars, frames.wide_factors(long_factors, names), names)
    return gated(out, model)


def gated(out: DataFrame, model: Model, by: Sequence[str] = ()) -> DataFrame:
    if "block_halving_future_buy" not in out.columns:
        out = frames.halving_mask(out, by) if model.mask else out.withColumn("block_halving_future_buy", F.lit(0.0))
    out = frames.move_gate(out, by=by) if model.gate else out.withColumn("tradable", F.lit(True))
    return prepared(out, model)


def may_buy() -> Column:
    return (F.col("block_halving_future_buy") == 0) & F.col("tradable")


def may_sell() -> Column:
    return F.col("tradable")


def budgets(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """budget, the cash for each security: one row, or one a run."""
    return bars.groupBy(*by).agg((F.lit(replay.CASH) / F.count_distinct("htsc_code")).alias("budget"))


def budget_of(bars: DataFrame) -> float:
    """The cash for each security."""
    found = budgets(bars).first()[0]
    if found is None:
        raise ValueError("there are no bars")
    return found


def signal_names(rules: Sequence[Rule], names: dict[str, str] | None = None) -> Column:
    """The factors of the rules that hit, joined by `+`."""
    return F.concat_ws("+", *(F.when(frames.signal_at_least(F.col(r.factor), r.threshold), F.lit((names or {}).get(r.factor, r.factor))) for r in rules))


def replayed(f: DataFrame, buy: list[Rule], sell: list[Rule], buy_operator: str = "and", sell_operator: str = "or", run_tag: str | Column = "run", model: Model = MODELS["signal_rules"], by: Sequence[str] = (), names: dict[str, str] | None = None, lot: int = 1, **said: object) -> dict[str, DataFrame]:
    """Orders, trades, positions, daily values, curves and the summary of a frame with signals, of one run or several.

    by names the columns that tell runs apart. Bars that the frame doesn't call `started` were only there for the mask and the gate. The frame,
    the order log, the table of what is held on bars and the days are written once and read by all the others;
    discard(found) deletes them when the results are stored. names are the factors' names by column, for the signals.
    """
    if not buy or not sell:
        raise ValueError("a run needs buy and sell rules")
    f = saved(f, "run-frame")
    now = f.where("started") if "started" in f.columns else f
    cash = F.broadcast(budgets(now, by))  # one row, or one a run
    acting = now.join(cash, list(by)) if by else now.join(cash)
    strategy = replay.orders if model.strategy is replay.orders else None
    buys, sells = frames.rules_hit(buy, buy_operator) & may_buy(), frames.rules_hit(sell, sell_operator) & may_sell()
    if strategy:
        log = replay.orders(acting, buys, sells, F.col("budget"), by, lot, (signal_names(buy, names), signal_names(sell, names)))
    else:
        log = ordered(acting, buys, sells, F.col("budget"), model, by)
    log = saved(log, "run-orders")
    own = saved(replay.held(log, now, replay.hold_from(now, by), by), "run-values")
    table = replay.on_days(own, by)
    daily = saved(replay.days(table, log, by), "run-days")
    trades, held = replay.trades(log, by), frames.position_log(replay.positions(table, by), daily, run_tag, by)
    return {
        "orders": replay.with_account(log, daily, by), "trades": trades, "daily": daily, "positions": held,
        "curves": curves.all_curves(daily, run_tag, replay.CASH), "summary": summary(daily, log, trades, held, run_tag, by, **said),
        "_frame": f, "_log": log, "_values": own,
    }


def discard(found: dict[str, DataFrame]) -> None:
    """Delete the tables behind the results of replayed(); they can't be read afterwards."""
    for name in ("_frame", "_log", "_values", "daily"):
        removed(found[name])


def backtest(bars: DataFrame, long_factors: DataFrame, buy: list[Rule], sell: list[Rule], model: Model, buy_operator: str = "and", sell_operator: str = "or", run_tag: str = "run", lot: int = 1) -> dict[str, DataFrame]:
    """replayed() of bars as they are."""
    if not buy or not sell:
        raise ValueError("a run needs buy and sell rules")
    return replayed(frame(bars, long_factors, list(dict.fromkeys(r.factor for r in [*buy, *sell])), model), buy, sell, buy_operator, sell_operator, run_tag, model, lot=lot)


def summary(daily: DataFrame, orders: DataFrame, trades: DataFrame, positions: DataFrame, run_tag: str | Column, by: Sequence[str] = (), title: str | Column = "", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """A row per run: numbers rounded, shares as percent texts, null where undefined; securities held on the last day, and those sold, as arrays.

    The arrays have an entry for each security of a run, and so are bounded by their number.
    """
    keys = list(by) or ["g"]
    keyed = lambda df: df if by else df.withColumn("g", F.lit(1))
    m = keyed(metrics.run_metrics(daily, orders, trades, replay.CASH, by))
    last = positions.join(F.broadcast(daily.groupBy(*by).agg(F.max("date").alias("date"))), [*by, "date"])  # one row, or one a run
    finals = F.broadcast(daily.groupBy(*by).agg(F.max_by("portfolio_value", "date").alias("_final")))
    last = last.join(finals, list(by)) if by else last.join(finals)
    still = metrics.held_positions(last, trades, F.col("_final"), F.col("_final") - replay.CASH, by)
    gone = metrics.closed_trades(trades, orders, still, F.lit(None).cast("double"), by).drop("contribution")
    order = ["code", "pnl", "trades", "first_open", "last_close", "bars", "buy_cost", "return_pct"]
    gone = keyed(gone).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("closed"))
    rounded = [shown(F.col(c)).alias(c) for c in ("realised_pnl", "unrealized_pnl", "total_pnl", "market_value", "position_size", "close")]
    largest = F.array_sort(F.collect_list(F.struct(F.negative(F.coalesce("weight", F.lit(0.0))).alias("_rank"), "code", *rounded, *(percent(F.col(c)).alias(c) for c in ("weight", "return", "contribution")))))
    open_ = keyed(still).groupBy(*keys).agg(F.transform(largest, lambda x: x.dropFields("_rank")).alias("held"))
    dated = lambda d: (F.lit(None) if d is None else d).cast("string")
    already = {"annual_return": "annual_pct", "max_drawdown": "max_drawdown_pct"}
    shares = {"win_rate": "win_rate", "turnover": "turnover", "average_cash_ratio": "average_cash_ratio", "net_return": "net_return", "gross_return": "gross_return", "benchmark_return": "benchmark_return"}
    numbers = ["final_value", "gross_final_value", "total_commission", "benchmark_value", "max_drawdown_money", "sharpe", "sortino", "calmar", "information_ratio", "excess_score", "score", "profit_loss_ratio", "mean_bars", "median_bars"]
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType)).alias(c)
    profit = F.col("_final_value") - replay.CASH
    out = m.withColumn("_final_value", F.col("final_value")).join(gone, keys, "left").join(open_, keys, "left")  # a row a run
    out = out.withColumns({"closed": none("closed", gone), "held": none("held", open_)})
    return out.select(
        *by, F.lit(run_tag).alias("run_tag"), F.trim(F.lit(title)).alias("title"), dated(start).alias("start_date"), dated(end).alias("end_date"), F.lit(False).alias("end_inclusive"), F.lit(replay.CASH).alias("initial_cash"),
        *(shown(F.col(c)).alias(c) for c in numbers), *(percent(F.col(c), already=True).alias(n) for n, c in already.items()), *(percent(F.col(c)).alias(n) for n, c in shares.items()), "n_trades",
        F.transform("closed", lambda x: x.withField("contribution", ratio(x["pnl"], profit))).alias("closed"), "held",
    )


#: Months that the halving mask looks ahead: of one run, and of a batch of years (fixed values).
LOOK_AHEAD, YEARLY_LOOK_AHEAD = 14, 13


def range_frame(spark: SparkSession, codes: list[str] | DataFrame, start: object, end: object, names: list[str], price_base: str, factor_base: str, segment_base: str | None, look_back: int = 0, adjust: str = "backward", mask: bool = True) -> DataFrame:
    """frames.range_frame() of stored tables: prices reach back by look_back days and, for the mask, ahead by LOOK_AHEAD months."""
    a, b = store.extended(start, end, look_back, LOOK_AHEAD if mask else 0)
    bars = store.prices(spark, price_base, codes, start, end, look_back, LOOK_AHEAD if mask else 0)
    adjust = adjust if segment_base else "none"
    segments = store.segments(spark, segment_base, codes) if segment_base else None
    return frames.range_frame(bars, segments, store.factors(spark, factor_base, names, a, end), names, a, store.day(end), b, adjust, mask)


def run_many(spark: SparkSession, config: dict, spans: Sequence[tuple[str, object, object]], price_base: str, factor_base: str, segment_base: str | None = None, look_ahead: int = YEARLY_LOOK_AHEAD) -> dict[str, DataFrame]:
    """replayed() of many runs (name, start, end) in one plan: each table is scanned once, results have a column run.

    config as for run_configured(), whose dates and name count for nothing here.
    """
    model, codes, buy, sell, columns, said = _request(config)
    back, mask = int(config.get("look_back_days") or 0), model.mask
    spans = [(name, store.day(a), store.day(b)) for name, a, b in spans]
    if not spans or any(a >= b for _, a, b in spans) or len({name for name, _, _ in spans}) < len(spans):
        raise ValueError("runs need names of their own, and to start before they end")
    reach = [frames.Span(name, a, b, *store.extended(a, b, back, look_ahead if mask else 0)) for name, a, b in spans]
    first, last = min(s.reach_from for s in reach), max(s.reach_to for s in reach)
    bars = store.prices(spark, price_base, codes, first, last)
    segments = store.segments(spark, segment_base, codes) if segment_base else None
    long = frames.named_factors(store.factors(spark, factor_base, list(columns), first, max(s.end for s in reach)), columns)
    adjust = str(config.get("adjust_mode") or "backward") if segment_base else "none"
    f = gated(frames.frame_of_runs(bars, segments, long, list(dict.fromkeys(columns.values())), reach, adjust, mask), model, ["run"])
    dates = lambda at: F.create_map(*(F.lit(x) for s in reach for x in (s.run, getattr(s, at))))[F.col("run")]
    return replayed(f, buy, sell, run_tag=F.col("run"), model=model, by=["run"], title=F.col("run"), start=dates("start"), end=dates("end"), **said)


def _request(config: dict) -> tuple[Model, list[str] | DataFrame, list[Rule], list[Rule], dict[str, str], dict]:
    """A request's model, codes, rules on columns, the columns of stored factors, and what replayed() is told besides."""
    codes = config.get("codes")
    codes = codes if isinstance(codes, DataFrame) else store.codes_of(codes)
    model = MODELS.get(config.get("adopt_model") or "signal_rules")
    if model is None or not model.runnable:
        raise ValueError(f"model {config.get('adopt_model')!r} can't be run")
    columns, buy, sell = frames.rule_columns(rules_of(config.get("buy_rules")), rules_of(config.get("sell_rules")))
    if not buy or not sell:
        raise ValueError("a run needs buy and sell rules")
    said = {
        "buy_operator": operator_of(config.get("buy_operator"), "and"), "sell_operator": operator_of(config.get("sell_operator"), "or"), "lot": max(1, int(config.get("lot_size") or 1)),
        "names": {column: factor for factor, column in columns.items()},
    }
    return model, codes, buy, sell, columns, said


def run_configured(spark: SparkSession, config: dict, price_base: str, factor_base: str, out: str | None = None, progress: Callable[[int], None] = lambda _: None, segment_base: str | None = None) -> dict[str, DataFrame]:
    """A run from a request: codes, start_date, end_date, rules, operators, run_name and adopt_model; logs are written below out.

    codes may also be a table. Factors are named as stored; those of AUXILIARY_NAMES are in every frame. With segment_base
    prices are adjusted (adjust_mode: backward, forward or none); lot_size rounds orders down.
    """
    start, end = store.day(config.get("start_date")), store.day(config.get("end_date"))
    if start >= end:
        raise ValueError("the start must lie before the end")
    model, codes, buy, sell, columns, said = _request(config)
    progress(5)
    back, ahead = int(config.get("look_back_days") or 0), LOOK_AHEAD if model.mask else 0
    a, b = store.extended(start, end, back, ahead)
    bars = store.prices(spark, price_base, codes, start, end, back, ahead)
    segments = store.segments(spark, segment_base, codes) if segment_base else None
    long = frames.named_factors(store.factors(spark, factor_base, list(columns), a, end), columns)
    adjust = str(config.get("adjust_mode") or "backward") if segment_base else "none"
    f = frames.range_frame(bars, segments, long, list(dict.fromkeys(columns.values())), a, end, b, adjust, model.mask)
    f = gated(f, model).withColumn("started", F.col("time") >= F.lit(start))
    title = str(config.get("run_name") or "")
    found = replayed(f, buy, sell, run_tag=title or "run", model=model, title=title, start=F.lit(start), end=F.lit(end), **said)
    progress(25)
    if out:
        write_results(found, out)
    progress(95)
    return found


def write_results(found: dict[str, DataFrame], out: str) -> None:
    """The logs, curves and summary below out."""
    store.write_orders(found["orders"], f"{out}/orders")
    store.write_positions(found["positions"], f"{out}/positions")
    found["trades"].write.mode("overwrite").parquet(f"{out}/trades")
    store.upsert_curves(found["curves"].drop("run"), f"{out}/curves")
    found["summary"].write.mode("overwrite").json(f"{out}/summary")


def run_sweep(bars: DataFrame, long_factors: DataFrame, buy: list[Rule], sell: list[Rule], model: Model, objective: str = "profit", maximise: bool = True) -> tuple[DataFrame, DataFrame]:
    """All trials and the best one; a run of the best trial's rules has its trades."""
    if not model.sweeps:
        raise ValueError(f"model {model.id} can't be swept")
    f = frame(bars, long_factors, list(dict.fromkeys(r.factor for r in [*buy, *sell])), model)
    trials = sweep.sweep(f, buy, sell, budget_of(bars), may_buy=may_buy(), may_sell=may_sell())
    return trials, sweep.best(trials, objective, maximise)


def run_study(bars: DataFrame, long_factors: DataFrame, buy: list[Rule], sell: list[Rule], model: Model, folder: str, **settings: object) -> study.Study:
    """A Study of a model's frame, not yet run: its run(), cancel(), state() and result() do the rest."""
    if not model.sweeps:
        raise ValueError(f"model {model.id} can't be swept")
    f = frame(bars, long_factors, list(dict.fromkeys(r.factor for r in [*buy, *sell])), model)
    return study.Study(f, buy, sell, budget_of(bars), folder, may_buy=may_buy(), may_sell=may_sell(), **settings)


def main(argv: list[str] | None = None) -> None:
    """One run per year, all in one plan, or one for a range; codes from the command line or a CSV."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--prices", required=True)
    p.add_argument("--factors", required=True)
    p.add_argument("--codes", nargs="*", default=[])
    p.add_argument("--codes-file")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--years", nargs="*", type=int, default=[])
    p.add_argument("--buy", nargs="+", required=True)
    p.add_argument("--sell", nargs="+", required=True)
    p.add_argument("--segments")
    p.add_argument("--look-back", type=int, default=0)
    p.add_argument("--model", default="signal_rules")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if bool(a.start) != bool(a.end) or (a.start and a.years):
        p.error("give --start and --end, or --years")
    if not a.codes and not a.codes_file:
        p.error("give --codes or --codes-file")
    spark = SparkSession.builder.getOrCreate()
    codes = a.codes or store.pool(spark, a.codes_file)
    config = {"codes": codes, "buy_rules": [{"factor": x} for x in a.buy], "sell_rules": [{"factor": x} for x in a.sell], "look_back_days": a.look_back, "adopt_model": a.model}
    if a.start:
        found = run_configured(spark, {**config, "start_date": a.start, "end_date": a.end, "run_name": a.start}, a.prices, a.factors, a.out, segment_base=a.segments)
    else:
        years = a.years or DEFAULT_YEARS
        found = run_many(spark, config, [(str(y), f"{y}-01-01", f"{y + 1}-01-01") for y in years], a.prices, a.factors, a.segments)
        write_results(found, a.out)
    discard(found)


#: Years of a batch where none are named (fixed values).
DEFAULT_YEARS = [2019, 2020, 2021]


if __name__ == "__main__":
    main()
