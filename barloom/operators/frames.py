"""Relational operators on bars, factors and segments, all left to Catalyst.

Keys are (htsc_code, time); prices are open, high, low, close; segments are closed intervals with a factor xdy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import number, ratio, signal

KEY = ["htsc_code", "time"]
PRICES = ["open", "high", "low", "close"]


@dataclass(frozen=True)
class Rule:
    """A factor hits when its value is at least the threshold."""

    factor: str
    threshold: float = 1.0


#: Factors as they are stored and as strategies name them (fixed values).
FACTOR_NAMES = {
    "总买入信号": "total_buy_signal",
    "总买入信号改": "total_buy_signal_adjusted",
    "总卖出信号+逃顶总分+J值超买因子": "sell_combo_signal",
    "RSI死叉+RSI超买": "rsi_sell_combo",
    "抄底总分": "bottom_fishing_score",
    "MAC总": "mac_total",
    "总卖出信号": "total_sell_signal",
}
#: Factors of the older four-factor frame (fixed values).
LEGACY_NAMES = {"MAC总": "mac_total", "KDJ信号": "kdj_signal", "OBV多头排列": "obv_bullish", "抄底总分": "bottom_score"}
LEGACY_FACTORS = list(LEGACY_NAMES.values())
#: Factors that a configured run's frame has besides those of its rules (fixed values).
AUXILIARY_NAMES = {"MAC总": "mac_total", "KDJ信号": "kdj_signal", "OBV多头排列": "obv_bullish"}


def named_factors(long: DataFrame, names: dict[str, str]) -> DataFrame:
    """long with factors renamed by the map; the others keep their names."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return long.withColumn("factor", F.coalesce(F.create_map(*pairs)[F.col("factor")], "factor"))


def wide_factors(long: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One column per named factor: a single grouping in place of a chain of outer joins."""
    picked = [F.max(F.when(F.col("factor") == n, F.col("value"))).alias(n) for n in names]
    return long.where(F.col("factor").isin(*names)).groupBy(*by, *KEY).agg(*picked)


def with_factors(bars: DataFrame, wide: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """bars with factor columns, 0 where missing."""
    return bars.join(wide, [*by, *KEY], "left").withColumns({n: number(F.col(n)) for n in names})


def rules_hit(rules: Sequence[Rule], operator: str = "and") -> Column:
    """Whether the rules, on columns named as their factors, hit together; no rules never do."""
    hits = [signal_at_least(F.col(r.factor), r.threshold) for r in rules]
    if not hits:
        return F.lit(False)
    return reduce(lambda a, b: a | b, hits) if str(operator).lower() == "or" else reduce(lambda a, b: a & b, hits)


def signal_at_least(c: Column, threshold: float) -> Column:
    return number(c) >= F.lit(float(threshold))


def segment_factors(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Segments with the running product of xdy and the product of all later ones; a missing xdy spoils what it enters.

    by names the columns that tell runs apart, here and below: a run's segments are its own. The products depend on which segments are given: pass those that overlap the query window, no more.
    """
    w = Window.partitionBy(*by, "htsc_code").orderBy("begin_date", "end_date")
    x = F.coalesce(F.col("xdy"), F.lit(float("nan")))
    clean = segments.dropna(subset=["begin_date", "end_date"])
    past = F.product(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.coalesce(F.product(x).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    return clean.withColumns({"cum": F.nanvl(past, F.lit(1.0)), "suffix": F.nanvl(later, F.lit(1.0))})


def overlapping(segments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Segments that overlap the closed interval and aren't of synthetic curves."""
    return segments.where((F.col("end_date") >= start) & (F.col("begin_date") <= end) & ~F.col("htsc_code").endswith(".YKRS"))


def binned(segments: DataFrame, bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per segment and month in which its security's bars may lie: _begin and _end inside it.

    Segments are clipped to the span of their security's bars first, so an open end costs as many rows as there are months
    of bars.
    """
    keys = [*by, "htsc_code"]
    spans = bars.groupBy(*keys).agg(F.min("time").alias("_from"), F.max("time").alias("_to"))
    near = segments.join(spans, keys).withColumns({"_begin": F.greatest("begin_date", "_from"), "_end": F.least("end_date", "_to")})
    near = near.where("_begin <= _end AND begin_date <= end_date").drop("_from", "_to", "begin_date", "end_date")
    return near.withColumn("_month", F.explode(F.sequence(F.trunc("_begin", "MM"), F.trunc("_end", "MM"), F.expr("interval 1 month"))))


def adjusted(bars: DataFrame, segments: DataFrame, mode: str, by: Sequence[str] = ()) -> DataFrame:
    """bars with adjusted prices; volume stays. mode: backward, forward or none.

    Bars meet segments by security and month, and inside a month by comparison; on weekends prices stay as they are, and a
    bar in several segments is repeated for each.
    """
    if mode == "none":
        return bars
    if mode not in ("backward", "forward"):
        raise ValueError(f"adjust mode {mode!r} is not backward, forward or none")
    factor = {"backward": F.col("cum"), "forward": F.col("suffix")}[mode]
    keys = [*by, "htsc_code", "_month"]
    near = binned(segment_factors(segments, by), bars, by).select(*(F.col(k).alias(f"s_{k}") for k in keys), "_begin", "_end", factor.alias("_adj"))
    on = (F.weekday("time") < 5) & F.col("time").between(F.col("_begin"), F.col("_end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    out = bars.withColumn("_month", F.trunc("time", "MM")).join(near, on, "left").withColumn("_adj", F.coalesce("_adj", F.lit(1.0)))
    change = (lambda c: F.col(c) * F.col("_adj")) if mode == "backward" else (lambda c: F.col(c) / F.col("_adj"))
    return out.withColumns({c: change(c) for c in PRICES if c in bars.columns}).select(*bars.columns)


def halving_mask(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with block_halving_future_buy: 1 after the fifth bar of a year up to the fifth of the next, if the close halves between them."""
    w = Window.partitionBy(*by, "htsc_code").orderBy("_year", "time")
    # frames by value: 1 is the next year and -1 the one before, and no row where these have no bar
    year = lambda a, b=None: Window.partitionBy(*by, "htsc_code").orderBy("_year").rangeBetween(a, a if b is None else b)
    ranked = bars.withColumn("_year", F.year("time"))
    ranked = ranked.withColumn("_rn", F.row_number().over(w) - F.count("*").over(year(Window.unboundedPreceding, -1)))
    fifth = ranked.withColumn("_fifth", F.when(F.col("_rn") == 5, F.col("close")))
    c5 = {f"_c{k + 1}": F.max("_fifth").over(year(k)) for k in (-1, 0, 1)}
    halves = lambda old, new: F.coalesce((F.col(old) > 0) & (F.col(new) <= 0.5 * F.col(old)), F.lit(False))
    blocked = F.when(F.col("_rn") > 5, halves("_c1", "_c2")).otherwise(halves("_c0", "_c1"))
    return fifth.withColumns(c5).withColumn("block_halving_future_buy", blocked.cast("double")).drop("_year", "_rn", "_fifth", *c5)


def rule_columns(buy: Sequence[Rule], sell: Sequence[Rule], auxiliary: dict[str, str] = AUXILIARY_NAMES) -> tuple[dict[str, str], list[Rule], list[Rule]]:
    """The frame's column of each stored factor, and the rules on these columns.

    Auxiliary factors have columns of their own, and a rule on one of them shares it; further ones get buy_factor_0 and so
    on, sell_factor_0 and so on, in order, the first name of a factor counting.
    """
    columns = dict(auxiliary)
    for prefix, rules in (("buy", buy), ("sell", sell)):
        for k, r in enumerate(rules):
            columns.setdefault(r.factor, f"{prefix}_factor_{k}")
    named = lambda rules: [Rule(columns[r.factor], r.threshold) for r in rules]
    return columns, named(buy), named(sell)


def active_rules(template: Sequence[Rule], mask: dict[str, bool]) -> list[Rule]:
    """The rules of a template whose factor the mask switches on; factors that it doesn't name are off."""
    return [r for r in template if mask.get(r.factor, False)]


def with_strong_signals(frame: DataFrame, buy: Sequence[Rule], sell: Sequence[Rule], buy_operator: str = "and", sell_operator: str = "or") -> DataFrame:
    """frame with strong_buy_signal and strong_sell_signal, 0 or 1.

    total_buy_signal becomes the strong one; without buy rules it is the other way round. total_sell_signal stays, and
    without sell rules nothing sells.
    """
    strong = rules_hit(buy, buy_operator).cast("double") if buy else number(F.col("total_buy_signal"))
    out = frame.withColumn("strong_buy_signal", strong)
    return out.withColumns({"total_buy_signal": F.col("strong_buy_signal"), "strong_sell_signal": rules_hit(sell, sell_operator).cast("double")})


def legacy_frame(bars: DataFrame, long_factors: DataFrame) -> DataFrame:
    """Bars as they are, neither adjusted nor masked, with the four older factors by their columns' names, 0 where missing."""
    return with_factors(bars, wide_factors(named_factors(long_factors, LEGACY_NAMES), LEGACY_FACTORS), LEGACY_FACTORS)


def seven_factor_frame(bars: DataFrame, long_factors: DataFrame) -> DataFrame:
    """bars with the seven factors of the rule models by their columns' names, 0 where missing."""
    names = list(FACTOR_NAMES.values())
    return with_factors(bars, wide_factors(named_factors(long_factors, FACTOR_NAMES), names), names)


def range_frame(bars: DataFrame, segments: DataFrame | None, long_factors: DataFrame, names: Sequence[str], start: date, end: date, last: date, adjust: str = "backward", mask: bool = True) -> DataFrame:
    """Adjusted bars from start on with factors, and with the halving mask that looks ahead to last; clipped to before end.

    bars and factors reach from start, maybe days before a run begins, to before last; only segments that overlap that
    range enter the products.
    """
    inside = lambda df, until: df.where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(until)))
    out = inside(bars, last)
    if adjust != "none":
        near = overlapping(segments, F.lit(start), F.date_sub(F.lit(last), 1))  # those without bars end in the join
        out = adjusted(out, near, adjust)
    out = halving_mask(out) if mask else out.withColumn("block_halving_future_buy", F.lit(0.0))
    return with_factors(inside(out, end), wide_factors(inside(long_factors, end), names), names)


@dataclass(frozen=True)
class Span:
    """A run: its name, its first day and the day after its last, and how far its bars reach back and ahead for the mask."""

    run: str
    start: date
    end: date
    reach_from: date
    reach_to: date


def of_runs(rows: DataFrame, spans: Sequence[Span], until: str = "reach_to") -> DataFrame:
    """rows with run, repeated for each run whose days from reach_from to before `until` hold their time: no join, one scan."""
    runs = F.array(*(F.struct(F.lit(s.run).alias("run"), F.lit(s.reach_from).alias("a"), F.lit(getattr(s, until)).alias("b")) for s in spans))
    met = F.filter(runs, lambda r: (F.col("time") >= r["a"]) & (F.col("time") < r["b"]))
    return rows.withColumn("_run", F.explode(met)).select(F.col("_run.run").alias("run"), *rows.columns)


def frame_of_runs(bars: DataFrame, segments: DataFrame | None, long_factors: DataFrame, names: Sequence[str], spans: Sequence[Span], adjust: str = "backward", mask: bool = True) -> DataFrame:
    """range_frame() of many runs at once: bars and factors meet before they are repeated for runs, and are dealt by run and security.

    The frame has `started`: false on bars before a run's start, which only lend their prices.
    """
    by, out = ["run"], of_runs(with_factors(bars, wide_factors(long_factors, names), names), spans)
    if adjust != "none":
        runs = F.array(*(F.struct(F.lit(s.run).alias("run"), F.lit(s.reach_from).alias("a"), F.lit(s.reach_to).alias("b")) for s in spans))
        met = F.filter(runs, lambda r: (F.col("end_date") >= r["a"]) & (F.col("begin_date") < r["b"]))
        near = segments.where(~F.col("htsc_code").endswith(".YKRS")).withColumn("run", F.explode(F.transform(met, lambda r: r["run"])))
        out = adjusted(out, near, adjust, by)
    out = halving_mask(out, by) if mask else out.withColumn("block_halving_future_buy", F.lit(0.0))
    begins, ends = (F.create_map(*(F.lit(x) for s in spans for x in (s.run, getattr(s, end)))) for end in ("start", "end"))
    return out.where(F.col("time") < ends[F.col("run")]).withColumn("started", F.col("time") >= begins[F.col("run")])


def backscan(frame: DataFrame, start: Column, buy: str, sell: str, limit: int = 50, cap: float = 0.05) -> DataFrame:
    """Codes to hold at start: the last buy signal before it came after every sell; newest first, equal weights up to cap."""
    before = frame.where(F.col("time") < start)
    last = before.groupBy("htsc_code").agg(F.max(F.when(signal(F.col(buy)) >= 1, F.col("time"))).alias("last_buy"), F.max(F.when(signal(F.col(sell)) >= 1, F.col("time"))).alias("last_sell"))
    held = last.where("last_buy IS NOT NULL AND (last_sell IS NULL OR last_buy > last_sell)")
    top = held.orderBy(F.desc("last_buy"), "htsc_code").limit(limit)
    n = F.count("*").over(Window.partitionBy())
    return top.withColumn("weight", F.least(F.lit(cap), F.lit(1.0) / n)).drop("last_sell")


def move_gate(bars: DataFrame, limit: float = 0.098, by: Sequence[str] = ()) -> DataFrame:
    """bars with tradable: the close moved by no more than limit since the last bar, or there is none."""
    prev = F.lag("close").over(Window.partitionBy(*by, "htsc_code").orderBy("time"))
    move = F.abs(F.when(prev > 0, F.col("close") / prev) - 1)
    return bars.withColumn("tradable", F.coalesce(move <= limit, F.lit(True)))


def position_log(raw: DataFrame, daily: DataFrame, run_tag: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Derived columns of held positions: cost, returns, weights and contributions.

    before_close and before_value are those of the row before; where raw lacks them, lags are taken before empty positions go.
    """
    w = Window.partitionBy(*by, "code").orderBy("date")
    known = "before_close" in raw.columns and "before_value" in raw.columns
    before = {f"_prev_{c}": F.col(f"before_{c}") if known else F.lag({"value": "market_value"}.get(c, c)).over(w) for c in ("close", "value")}
    out = raw.withColumns(before).drop("before_close", "before_value").where("position_size <> 0")
    out = out.join(daily.select(*by, "date", "cash_value", "portfolio_value"), [*by, "date"], "left")
    out = out.withColumns({
        "cost_basis": F.col("position_size") * F.col("position_price"),
        "daily_pnl": F.col("position_size") * (F.col("close") - F.col("_prev_close")),
    }).withColumns({
        "unrealized_return_pct": ratio(F.col("unrealized_pnl"), F.abs("cost_basis")),
        "weight_pct": ratio(F.col("market_value"), F.col("portfolio_value")),
        "daily_pnl_pct": ratio(F.col("daily_pnl"), F.abs("_prev_value")),
        "contribution_pct": ratio(F.col("daily_pnl"), F.col("portfolio_value")),
    })
    return out.drop("_prev_close", "_prev_value").withColumn("run_tag", F.lit(run_tag))


def filled(bars: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with each row repeated on the days of `days` up to its security's next one, or to the last day of all.

    Windows see bars only; the rows in between are made last, and met with the days that exist.
    """
    return spread(with_until(bars, by), days, by)


def with_until(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with _until, the day before the security's next bar; null at its last."""
    return bars.withColumn("_until", F.date_sub(F.lead("time").over(Window.partitionBy(*by, "htsc_code").orderBy("time")), 1))


def spread(bars: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """filled() of bars that have _until already: without a window, so of a stored table too."""
    last = F.broadcast(days.groupBy(*by).agg(F.max("time").alias("_last")))  # one row, or one a run
    out = bars.join(last, list(by)) if by else bars.join(last)
    out = out.withColumn("time", F.explode(F.sequence("time", F.coalesce("_until", F.greatest("_last", "time")))))
    return out.join(days.select(*by, "time").distinct(), [*by, "time"], "left_semi").select(*(c for c in bars.columns if c != "_until"))


def last_known(bars: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per code and day of days since its first bar, with the last known close."""
    w = Window.partitionBy(*by, "htsc_code").orderBy("time")
    return filled(bars.select(*by, *KEY, F.last("close", ignorenulls=True).over(w).alias("close")), days, by)
