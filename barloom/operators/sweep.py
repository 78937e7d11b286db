"""Exhaustive sweep over subsets of buy and sell rules, all trials in one plan.

A bar's rule hits are bits of a number, so a trial is a pair of masks and its signals are integer arithmetic on rows
that were scanned once. Only bars that some rule hits are repeated per trial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.frames import Rule, signal_at_least
from barloom.operators.replay import orders, trades

MAX_TRIALS = 4096


def bits(rules: dict[int, Rule]) -> Column:
    """The rules that hit, rule k as bit k."""
    out = F.lit(0)
    for k, r in rules.items():
        out = out + F.when(signal_at_least(F.col(r.factor), r.threshold), 1 << k).otherwise(0)
    return out


def hit(bits_: Column, mask: Column, operator: str) -> Column:
    common = bits_.bitwiseAND(mask)
    return common != 0 if operator == "or" else common == mask


def subsets(names: Column) -> Column:
    """All non-empty subsets of an array, smaller ones first, then by mask."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(names)) - 1)
    picked = F.transform(masks, lambda m: F.struct(F.bit_count(m).alias("size"), m.alias("mask"), F.filter(names, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1).alias("names")))
    return F.sort_array(picked)


def sweep(frame: DataFrame, buy: Sequence[Rule], sell: Sequence[Rule], budget: float, buy_operator: str = "and", sell_operator: str = "or", may_buy: Column | None = None, may_sell: Column | None = None) -> DataFrame:
    """trial, masks, trades, profit of every pair of non-empty subsets; trials without a trade have profit 0.

    Bars for which may_buy (may_sell) is false give no buys (sells) in any trial.
    """
    n = (2 ** len(buy) - 1) * (2 ** len(sell) - 1)
    if not buy or not sell:
        raise ValueError("a sweep needs buy and sell rules")
    if n > MAX_TRIALS:
        raise ValueError(f"{n} trials are more than {MAX_TRIALS}")
    return trials_of(frame, buy, sell, budget, range(n), buy_operator, sell_operator, may_buy, may_sell)


def trials_of(frame: DataFrame, buy: Sequence[Rule], sell: Sequence[Rule], budget: float, trials: range, buy_operator: str = "and", sell_operator: str = "or", may_buy: Column | None = None, may_sell: Column | None = None) -> DataFrame:
    """sweep() of the trials of a range only; rules that none of them uses are not looked at."""
    width = 2 ** len(sell) - 1
    masks = [(t // width + 1, t % width + 1) for t in trials]
    used = lambda rules, k: {i: r for i, r in enumerate(rules) if any(m[k] >> i & 1 for m in masks)}
    missing = sorted({r.factor for k, rules in enumerate((buy, sell)) for r in used(rules, k).values()} - set(frame.columns))
    if missing:
        raise ValueError(f"the frame has no factor {', '.join(missing)}")
    allowed = lambda found, may: found if may is None else F.when(may, found).otherwise(0)
    marked = frame.withColumns({"_b": allowed(bits(used(buy, 0)), may_buy), "_s": allowed(bits(used(sell, 1)), may_sell), "bar": F.lit(0)})
    marked = marked.where("_b > 0 OR _s > 0").select("htsc_code", "time", "close", "bar", "_b", "_s")
    # bars are dealt by security before they are repeated, and that serves the windows of all trials
    marked = marked.repartition("htsc_code")
    parts = {"buy_mask": F.expr(f"cast(trial div {width} as int)") + 1, "sell_mask": F.pmod("trial", F.lit(width)) + 1}
    trial = marked.withColumn("trial", F.explode(F.sequence(F.lit(trials[0]), F.lit(trials[-1])))).withColumns(parts)
    run = ["trial", "buy_mask", "sell_mask"]
    log = orders(trial, hit(F.col("_b"), F.col("buy_mask"), buy_operator), hit(F.col("_s"), F.col("sell_mask"), sell_operator), budget, run)
    scores = trades(log, run).groupBy(*run).agg(F.count("*").alias("n_trades"), F.sum("pnlcomm").alias("profit"))
    every = frame.sparkSession.range(trials[0], trials[-1] + 1).select(F.col("id").cast("int").alias("trial")).withColumns(parts)
    return every.join(scores, run, "left").fillna({"n_trades": 0, "profit": 0.0})


def best(trials: DataFrame, objective: str = "profit", maximise: bool = True) -> DataFrame:
    """The best trial, the first of ties; what is no number loses."""
    worst = float("-inf") if maximise else float("inf")
    score = F.coalesce(F.col(objective).try_cast("double"), F.lit(worst))
    return trials.orderBy(F.desc(score) if maximise else F.asc(score), "trial").limit(1)
