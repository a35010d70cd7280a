"""Functions over the names of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import col, day


def winsorized(x, lo: float = 0.01, hi: float = 0.99) -> Column:
    """Clipped at two quantiles of the date; as it is where fewer than 3 values aren't null."""
    x = col(x)
    a, b = F.percentile(x, F.lit(lo)).over(day()), F.percentile(x, F.lit(hi)).over(day())
    return F.when(x.isNull() | (F.count(x).over(day()) < 3), x).otherwise(F.greatest(F.least(x, b), a))


def median_filled(x) -> Column:
    x = col(x)
    return F.coalesce(x, F.percentile(x, F.lit(0.5)).over(day()), F.lit(0.0))


def zscored(x) -> Column:
    """0 for all names of a date without spread."""
    x = col(x)
    sd = F.stddev_pop(x).over(day())
    return F.when(sd.isNull() | (sd <= 1e-12), F.lit(0.0)).otherwise((x - F.avg(x).over(day())) / sd)


def processed(df: DataFrame, x: str) -> DataFrame:
    """Winsorize, then fill, then z-score, always in this order; one pass each."""
    return df.withColumn(x, winsorized(x)).withColumn(x, median_filled(x)).withColumn(x, zscored(x))


def average_rank(x: str, by: tuple[str, ...] = ("trade_date",)) -> Column:
    """Rank from 1 with average ties. Nulls must be gone. From the ranks at both ends, so one partitioning does."""
    w = Window.partitionBy(*by)
    return (F.rank().over(w.orderBy(x)) + F.count(F.lit(1)).over(w) + 1 - F.rank().over(w.orderBy(F.desc(x)))) / 2.0


def percent_rank(x: str, by: tuple[str, ...] = ("trade_date",)) -> Column:
    return average_rank(x, by) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def bucket_of_rank(x: str, q: int) -> Column:
    """ceil(q * rank / n) by first rank: score, then symbol."""
    r = F.row_number().over(Window.partitionBy("trade_date").orderBy(x, "symbol"))
    return F.greatest(F.lit(1), F.least(F.lit(q), F.ceil(r * float(q) / F.count(F.lit(1)).over(day())))).cast("int")


def equal_count_bucket(x: str, q: int) -> Column:
    """Linear edges on first ranks, closed to the right."""
    r = F.row_number().over(Window.partitionBy("trade_date").orderBy(x, "symbol"))
    n = F.count(F.lit(1)).over(day())
    return F.greatest(F.lit(1), F.ceil((r - 1) * float(q) / F.greatest(n - 1, F.lit(1)))).cast("int")


def demeaned(x, group: str, least: int = 1) -> Column:
    """Minus the mean of its group on that date; groups of fewer than `least` stay as they are."""
    w = Window.partitionBy("trade_date", group)
    x = col(x)
    return F.when(F.count(x).over(w) >= least, x - F.avg(x).over(w)).otherwise(x)


def residual(y, x, least: int = 30) -> Column:
    """Residual of the date's regression of y on x; y where fewer than `least` pairs."""
    y, x = col(y), col(x)
    slope, cut = F.regr_slope(y, x).over(day()), F.regr_intercept(y, x).over(day())
    return F.when(F.regr_count(y, x).over(day()) > least, y - (cut + slope * x)).otherwise(y)
