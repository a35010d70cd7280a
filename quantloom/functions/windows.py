"""Rolling functions over a symbol's rows: a value exists only where the window holds n non-null values."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order():
    """A symbol's rows by date. Windows need a session, so they are made when asked for."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def day():
    return Window.partitionBy("trade_date")


def trailing(n: int):
    return order().rowsBetween(-(n - 1), 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(n: int, x: str | Column, agg: Callable[[Column], Column], least: int | None = None) -> Column:
    """agg over the last n rows where at least `least` (n unless given) of them aren't null."""
    x = col(x)
    return F.when(known(x, n) >= (least or n), agg(x).over(trailing(n)))


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(order())


def lead(x: str | Column, k: int = 1) -> Column:
    return F.lead(col(x), k).over(order())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def pct_change(x: str | Column, k: int) -> Column:
    return ratio(col(x), lag(x, k)) - 1


def known(x: Column, n: int) -> Column:
    """How many of the last n values aren't null: a difference of two running counts, which are exact, so the same work for any n."""
    upto, before = order().rowsBetween(Window.unboundedPreceding, 0), order().rowsBetween(Window.unboundedPreceding, -n)
    return F.count(x).over(upto) - F.coalesce(F.count(x).over(before), F.lit(0))


def mean(x, n: int) -> Column:
    return full(n, x, F.avg)


def std(x, n: int) -> Column:
    """Each window anew, for windows without spread must give 0 exactly."""
    return full(n, x, F.stddev_samp)


def total(x, n: int) -> Column:
    """Each window anew, as all others: a difference of running sums would keep what a large value or an infinity has left behind."""
    return full(n, col(x).cast("double"), F.sum)


def highest(x, n: int) -> Column:
    return full(n, x, F.max)


def lowest(x, n: int) -> Column:
    return full(n, x, F.min)


def quantile(x, n: int, q: float) -> Column:
    return full(n, x, lambda c: F.percentile(c, F.lit(q)))


def skew(x, n: int) -> Column:
    """Sample-adjusted; Spark's own is the population's."""
    return full(n, x, F.skewness) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(x, n: int) -> Column:
    return (full(n, x, F.kurtosis) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def corr(x, y, n: int) -> Column:
    """Pearson over the last n rows, all known; null without spread (Spark's corr raises there)."""
    w = trailing(n)
    x, y = col(x), col(y)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    return F.when(F.count(both).over(w) == n, ratio(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))


def pair_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson over a group's rows where both are known; null without spread (Spark's corr raises there)."""
    x, y = col(x), col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ts_rank(x, n: int) -> Column:
    """Percent rank, with average ties, of the last of n values."""
    x = col(x)
    values = F.collect_list(x).over(trailing(n))
    below = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return F.when(F.count(x).over(trailing(n)) == n, (below + (same + 1) / 2) / n)


def argmax(x, n: int) -> Column:
    """Rows since the start of the window at which its (first) maximum lies, from 0."""
    x = col(x)
    return F.when(F.count(x).over(trailing(n)) == n, F.array_position(F.collect_list(x).over(trailing(n)), F.max(x).over(trailing(n))) - 1)


def running(x) -> Column:
    return F.sum(col(x)).over(order().rowsBetween(Window.unboundedPreceding, 0))


def filled(x) -> Column:
    """The last value that isn't null."""
    return F.last(col(x), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))


def filled_back(x) -> Column:
    """The next value that isn't null."""
    return F.first(col(x), ignorenulls=True).over(order().rowsBetween(0, Window.unboundedFollowing))


def ewm(frame: DataFrame, value: str, spans: dict[str, float], by: str = "symbol", order: str = "trade_date", carried: tuple[str, ...] = (), std: bool = False) -> DataFrame:
    """frame's (by, order, carried ...) with, for each name, the recursion y += (x - y) * 2 / (span + 1), seeded by the first value;

    or, with std, the bias-corrected standard deviation under weights that decay by that rate. Nulls are skipped. A symbol's history is one
    Arrow group, sorted and folded in its task: one pass, and its size is that of one history.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    kept = [by, order, *carried]

    def task(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        x = own[value].astype(float)
        weighed = {n: x.ewm(span=s, adjust=True).std() if std else x.ewm(span=s, adjust=False).mean() for n, s in spans.items()}
        return own[kept].assign(**weighed)

    rows = frame.where(F.col(value).isNotNull()).select(*dict.fromkeys([*kept, value]))
    return rows.groupBy(by).applyInPandas(task, ", ".join([f"`{n}` {kinds[n]}" for n in kept] + [f"{n} double" for n in spans]))
