"""Column functions: cleaning, guarded arithmetic, formats and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252.0
#: Characters that file names can't hold, and the names that stand in for empty ones (fixed values).
ILLEGAL = r'[\\/:*?"<>|]'
NO_FACTOR, NO_TOKEN = "未命名因子", "因子"


def code(c: Column) -> Column:
    """Security codes are trimmed and in capitals."""
    return F.upper(F.trim(c))


def finite(c: Column) -> Column:
    """Whether a double is neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def number(c: Column, default: float = 0.0) -> Column:
    """c as double; what is missing, NaN or no number becomes default (infinity stays)."""
    return F.nanvl(F.coalesce(c.try_cast("double"), F.lit(default)), F.lit(default))


def signal(c: Column) -> Column:
    """A signal as a strategy reads it: anything that is not finite is 0."""
    x = c.try_cast("double")
    return F.when(finite(x), x).otherwise(F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is (nearly) zero."""
    return F.when(F.abs(d) > 1e-12, n / d)


def shown(v: Column, digits: int = 2) -> Column:
    """A summary number: rounded, null if not finite."""
    return F.when(finite(v), F.round(v, digits))


def percent(v: Column, already: bool = False) -> Column:
    """A summary percentage such as 12.5%, with one decimal at least."""
    scaled = F.round(v if already else v * 100, 2)
    return F.when(finite(v), F.concat(F.regexp_replace(F.format_string("%.2f", scaled), "0$", ""), F.lit("%")))


def path_name(c: Column) -> Column:
    """A factor's name as a directory name."""
    name = F.rtrim(F.regexp_replace(F.trim(c), ILLEGAL, "_"), F.lit(" ."))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(NO_FACTOR)).otherwise(name)


def directory_name(name: str) -> str:
    """path_name() of one name on the driver."""
    return re.sub(ILLEGAL, "_", str(name).strip()).rstrip(" .") or NO_FACTOR


def token_name(c: Column) -> Column:
    """A factor's name as a part of a run's name: runs of illegal characters and white space become one underscore."""
    name = F.rtrim(F.regexp_replace(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\s]+', "_"), "_+", "_"), F.lit("._"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(NO_TOKEN)).otherwise(name)


def period_name(start: Column, end: Column) -> Column:
    """Prefix of a run's name from its dates: years, months of a year, or two months; empty if a date is missing."""
    a, b = F.least(start, end), F.greatest(start, end)
    ym = lambda d: F.date_format(d, "yyyyMM")
    years = F.concat(F.year(a), F.lit("_to_"), F.year(b))
    name = F.when(b > F.add_months(a, 12), years).when(F.year(a) == F.year(b), F.concat(ym(a), F.lit("_to_"), F.date_format(b, "MM")))
    return F.when(start.isNull() | end.isNull(), F.lit("")).otherwise(name.when(F.lit(True), F.concat(ym(a), F.lit("_to_"), ym(b))))


def without_period(name: Column, start: Column, end: Column) -> Column:
    """A run's name without the prefix that its dates give, and the underscores behind it."""
    text, prefix = F.trim(F.coalesce(name, F.lit(""))), period_name(start, end)
    return F.when((prefix != "") & text.startswith(prefix), F.ltrim(F.substr(text, F.length(prefix) + 1), F.lit("_"))).otherwise(text)


def run_suffix(buy: Column, sell: Column) -> Column:
    """Suffix of a run's name from arrays of factor names."""
    part = lambda mark, names: F.when(F.size(names) > 0, F.concat(F.lit(mark), F.array_join(F.transform(names, token_name), "_"))).otherwise(F.lit(""))
    return F.concat(part("_买", buy), part("_卖", sell))
