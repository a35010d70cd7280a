"""Net asset values and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ratio

def dates():
    """Only over tables of one row a date."""
    return Window.orderBy("trade_date")


def universe_returns(membership: DataFrame, bars: DataFrame) -> DataFrame:
    """Weighted return of the universe by date; a missing asset return counts as 0."""
    r = bars.select("trade_date", "symbol", "ret")
    return membership.join(r, ["trade_date", "symbol"], "left").groupBy("trade_date").agg(F.sum(F.col("universe_weight") * F.coalesce("ret", F.lit(0.0))).alias("daily_return"))


def nav(returns: DataFrame) -> DataFrame:
    running = F.exp(F.sum(F.log1p("daily_return")).over(dates().rowsBetween(Window.unboundedPreceding, 0)))
    return returns.withColumn("nav", running)


def drawdown(navs: DataFrame) -> DataFrame:
    top = F.max("nav").over(dates().rowsBetween(Window.unboundedPreceding, 0))
    return navs.withColumn("drawdown", F.col("nav") / top - 1)


def monthly(navs: DataFrame) -> DataFrame:
    ends = navs.groupBy(F.last_day("trade_date").alias("month_end")).agg(F.max_by("nav", "trade_date").alias("nav"))
    before = F.lag("nav").over(Window.orderBy("month_end"))
    return ends.select("month_end", "nav", F.coalesce(ratio(F.col("nav"), before) - 1, F.lit(0.0)).alias("monthly_return"))


def yearly(navs: DataFrame) -> DataFrame:
    by = drawdown(navs).groupBy(F.year("trade_date").alias("year"))
    return by.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.max_by("nav", "trade_date") / F.min_by("nav", "trade_date") - 1).alias("total_return"),
        F.stddev_samp("daily_return").alias("volatility"),
        F.min("drawdown").alias("max_drawdown"),
    )


def performance(navs: DataFrame, per_year: int = 52) -> DataFrame:
    d = drawdown(navs)
    n, mean, sd = F.count(F.lit(1)), F.avg("daily_return"), F.stddev_samp("daily_return")
    return d.agg(
        n.alias("n_rows"),
        (F.max_by("nav", "trade_date") - 1).alias("total_return"),
        (F.pow(F.max_by("nav", "trade_date"), F.lit(float(per_year)) / n) - 1).alias("annual_return"),
        (F.stddev_pop("daily_return") * per_year**0.5).alias("annual_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        ratio(mean * per_year**0.5, sd).alias("sharpe"),
        F.avg(F.when(F.col("daily_return") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
    )


def regimes(returns: DataFrame, threshold: float = 0.02) -> DataFrame:
    """bull, bear or neutral by the benchmark's own return, and what was earned in each."""
    kind = F.when(F.col("daily_return") > threshold, "bull").when(F.col("daily_return") < -threshold, "bear").otherwise("neutral")
    return returns.groupBy(kind.alias("regime")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("daily_return").alias("mean_return"), F.stddev_samp("daily_return").alias("volatility"))


def ladder(index: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    """Exposure by where the index stands: above its short mean, its long mean, falling, or else low."""
    mean = lambda n: F.when(F.count("nav").over(dates().rowsBetween(-(n - 1), 0)) == n, F.avg("nav").over(dates().rowsBetween(-(n - 1), 0)))
    momentum = ratio(F.col("nav"), F.lag("nav", short).over(dates())) - 1
    x = index.withColumns({"ma_short": mean(short), "ma_long": mean(long), "momentum": momentum})
    step = (
        F.when(F.col("ma_long").isNull(), 1.0).when(F.col("nav") >= F.col("ma_short"), 1.0).when(F.col("nav") >= F.col("ma_long"), 0.7).when(F.col("momentum") < 0, 0.2).otherwise(0.4)
    )
    return x.select("trade_date", "nav", step.alias("gross_exposure"))
