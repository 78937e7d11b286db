"""Summaries of value paths that can be merged: a year's figures follow from those of its months, in any grouping.

A series is cut into chunks of time. A chunk's summary holds its ends, its peak and trough, the largest fall inside it, and
count, mean and sum of squared deviations of its day-on-day returns, of their losses, and of the returns over a benchmark.
Merging two neighbours adds what happens between them: the return from the last day of one to the first of the next, and a
fall from the peak of the one to the trough of the other. So no window spans a whole series: windows see one chunk, and a
series is a fold over its chunks' rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import ratio

#: The chunk of a day, unless a caller cuts otherwise.
MONTH = "yyyy-MM"


def _moments(c: Column) -> Column:
    return F.struct(F.count(c).cast("double").alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("m2"), F.coalesce(F.sum(F.pow(F.least(c, F.lit(0.0)), 2)), F.lit(0.0)).alias("down"))


def chunked(values: DataFrame, by: Sequence[str], day: str = "date", value: str = "value", benchmark: str | None = None, chunk: Column | None = None) -> DataFrame:
    """One summary `s` per group and chunk of values; rows without a value or benchmark are gaps of that series.

    chunk: an expression that grows with the day; the month by default.
    """
    bench = F.col(benchmark) if benchmark else F.lit(None).cast("double")
    rows = values.select(*by, F.col(day).alias("_d"), F.col(value).alias("_v"), bench.alias("_b"), (F.date_format(day, MONTH) if chunk is None else chunk).alias("_chunk"))
    w = Window.partitionBy(*by, "_chunk").orderBy("_d")
    ahead, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    step = lambda c: F.when(F.col(c).isNotNull(), ratio(F.col(c), F.last(c, ignorenulls=True).over(ahead)) - 1)
    rows = rows.withColumns({"_r": step("_v"), "_rb": step("_b"), "_peak": F.max("_v").over(so_far)})
    rows = rows.withColumns({"_active": F.col("_r") - F.col("_rb"), "_fall": F.when(F.col("_v").isNotNull(), F.struct((ratio(F.col("_peak") - F.col("_v"), F.col("_peak")) * 100).alias("pct"), (F.col("_peak") - F.col("_v")).alias("money")))})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("_d"))
    s = F.struct(
        F.min_by("_v", at("_v")).alias("first"), F.max_by("_v", at("_v")).alias("last"), F.min(at("_v")).alias("first_day"), F.max(at("_v")).alias("last_day"),
        F.min_by("_b", at("_b")).alias("first_b"), F.max_by("_b", at("_b")).alias("last_b"), F.min(at("_b")).alias("first_b_day"), F.min_by("_r", at("_b")).alias("r_at_b"), F.min_by("_rb", at("_v")).alias("rb_at_v"),
        F.max("_v").alias("peak"), F.min("_v").alias("trough"), F.max("_fall").alias("fall"), _moments(F.col("_r")).alias("r"), _moments(F.col("_active")).alias("active"),
    )
    return rows.groupBy(*by, "_chunk").agg(s.alias("s")).withColumnRenamed("_chunk", "chunk")


def _share(n: str, d: str) -> str:
    return f"if(abs({d}) > 1e-12D, {n} / {d}, NULL)"


def _bound(values: dict[str, str], name: str, body: str) -> str:
    """body with the values as fields of `name`, each worked out once."""
    fields = ", ".join(f"'{n}', {v}" for n, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def _added(m: str, points: Sequence[str]) -> str:
    """Moments m of a and b and of those returns between them that aren't null."""
    weighted = [(f"a.{m}.n", f"a.{m}.mean"), (f"b.{m}.n", f"b.{m}.mean"), *((f"if({p} IS NULL, 0D, 1D)", f"coalesce({p}, 0D)") for p in points)]
    mean = _bound({"n": " + ".join(w for w, _ in weighted), "total": " + ".join(f"{w} * {x}" for w, x in weighted)}, "v", "named_struct('n', v.n, 'mean', if(v.n > 0, v.total / v.n, 0D))")
    m2 = f"a.{m}.m2 + b.{m}.m2 + " + " + ".join(f"{w} * pow({x} - u.mean, 2)" for w, x in weighted)
    down = f"a.{m}.down + b.{m}.down + " + " + ".join(f"{w} * pow(least({x}, 0D), 2)" for w, x in weighted[2:])
    return f"element_at(transform(array({mean}), u -> named_struct('n', u.n, 'mean', u.mean, 'm2', {m2}, 'down', {down})), 1)"


def merged() -> str:
    """SQL of the summary of two neighbours a and b."""
    between = {"r": f"{_share('b.first', 'a.last')} - 1", "rb": f"{_share('b.first_b', 'a.last_b')} - 1", "together": "coalesce(b.first_b_day = b.first_day, false)", "money": "a.peak - b.trough", "pct": _share("(a.peak - b.trough)", "a.peak") + " * 100"}
    # b's first days of benchmark and path: what the other series does on them, which is b's own affair on another day
    days = {"r_at_b": "if(t.together, t.r, b.r_at_b)", "rb_at_v": "if(t.together, t.rb, b.rb_at_v)", "r": "t.r", "rb": "t.rb", "together": "t.together", "fall": "if(t.money IS NOT NULL, named_struct('pct', t.pct, 'money', t.money), NULL)"}
    either = ", ".join(f"'{c}', coalesce(a.{c}, b.{c})" if c.startswith("first") else f"'{c}', coalesce(b.{c}, a.{c})" for c in ("first", "last", "first_day", "last_day", "first_b", "last_b", "first_b_day"))
    at = ("'r_at_b', if(a.first_b_day IS NOT NULL, a.r_at_b, if(a.last IS NULL, b.r_at_b, d.r_at_b)), "
          "'rb_at_v', if(a.first_day IS NOT NULL, a.rb_at_v, if(a.last_b IS NULL, b.rb_at_v, d.rb_at_v))")  # fmt: skip
    active = _added("active", ["d.r_at_b - d.rb", "if(d.together, NULL, d.r - d.rb_at_v)"])
    out = f"named_struct({either}, {at}, 'peak', greatest(a.peak, b.peak), 'trough', least(a.trough, b.trough), 'fall', greatest(a.fall, b.fall, d.fall), 'r', {_added('r', ['d.r'])}, 'active', {active})"
    return _bound(between, "t", _bound(days, "d", out))


def folded(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """One summary `s` per group: its chunks' summaries (a row per month, say) merged in order."""
    listed = chunks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chunk", "s"))).alias("_all"))
    return listed.select(*by, F.expr(f"aggregate(slice(_all, 2, greatest(size(_all) - 1, 1)).s, _all[0].s, (a, b) -> {merged()})").alias("s"))


def deviation(moments: Column) -> Column:
    """Sample standard deviation, null of fewer than two."""
    return F.when(moments["n"] > 1, F.sqrt(moments["m2"] / (moments["n"] - 1)))


def figures(s: Column, year: float) -> dict[str, Column]:
    """Sharpe, Sortino and information ratio, largest fall, and what further figures need, of a summary."""
    some = lambda m, c: F.when(m["n"] > 0, c)
    r, active = s["r"], s["active"]
    return {
        "first_value": s["first"], "final_value": s["last"], "benchmark_value": s["last_b"], "periods": r["n"].cast("long"), "active_days": active["n"].cast("long"),
        "sharpe": some(r, ratio(r["mean"], deviation(r)) * year), "sortino": some(r, ratio(r["mean"], F.sqrt(r["down"] / r["n"])) * year),
        "information_ratio": some(active, ratio(active["mean"], deviation(active)) * year), "downside": some(active, active["down"] / active["n"]),
        "max_drawdown_pct": s["fall"]["pct"], "max_drawdown_money": s["fall"]["money"],
    }
