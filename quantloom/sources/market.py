"""Market-style tables derived from the given tables: bars, calendar, master, universe, tradability, corporate actions.

A symbol is a supplier. The unit price of an order line is a trade; the lines of one ship date make a daily bar, the bars
of a week a weekly bar. Every first and last is taken by a key that is unique within a bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = ["symbol", "trade_date", "open", "high", "low", "close", "volume", "amount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("k"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("x"),
    )
    return lines.groupBy("symbol", "trade_date").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("q").alias("volume"),
        F.round(F.sum("x"), 2).alias("amount"),
    )


def weekly_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_bar(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "trade_date")))
    return d.groupBy("symbol", F.col("week").alias("trade_date")).agg(
        F.min_by("open", "trade_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"),
        F.round(F.sum("amount"), 2).alias("amount"),
    )


def trade_calendar(bars: DataFrame) -> DataFrame:
    """One row a date: its number (from 0) and whether it trades."""
    dates = bars.select("trade_date").distinct()
    return dates.withColumn("day_no", F.row_number().over(Window.orderBy("trade_date")) - 1).withColumn("is_trading_day", F.lit(True))


def security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = daily_bar(spark, sf_dir).groupBy("symbol").agg(F.min("trade_date").alias("listed_date"), F.max("trade_date").alias("last_date"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return named.select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("security_name"), F.col("r_name").alias("market"), F.col("n_name").alias("industry")
    ).join(first, "symbol", "left")


def with_returns(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return bars.withColumn("adj_close", F.col("close")).withColumn("pct_chg", 100 * (F.col("close") / F.lag("close").over(w) - 1))


def tradability(bars: DataFrame, limit: float = 30.0, new_days: int = 60, carried: tuple[str, ...] = ()) -> DataFrame:
    """Bars with a limit move can't be bought (up) or sold (down); names listed for fewer than new_days are new."""
    w = Window.partitionBy("symbol")
    b = with_returns(bars).withColumn("listed", F.min("trade_date").over(w))
    up, down = F.coalesce(F.col("pct_chg") >= limit, F.lit(False)), F.coalesce(F.col("pct_chg") <= -limit, F.lit(False))
    return b.select(
        "trade_date",
        "symbol",
        (F.col("volume") > 0).alias("is_tradable"),
        (~up).alias("can_buy"),
        (~down).alias("can_sell"),
        (F.datediff("trade_date", "listed") < new_days).alias("is_new_listing"),
        (F.col("symbol") % 17 == 0).alias("is_st"),
        *carried,
    )


def universe_membership(bars: DataFrame, every: int = 20, share: float = 0.6) -> DataFrame:
    """Every `every` dates the most traded names since the last time, in equal weights; held until the next time."""
    cal = trade_calendar(bars).withColumn("period", F.expr(f"day_no div {every}"))
    traded = bars.join(F.broadcast(cal), "trade_date").groupBy("symbol", (F.col("period") + 1).alias("period")).agg(F.sum("volume").alias("traded"))
    ranked = traded.withColumn("r", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("traded"), "symbol"))).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("period"))
    )
    chosen = ranked.where(F.col("r") <= F.ceil(F.col("n") * share)).withColumn("universe_weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("period")))
    return cal.join(chosen, "period").select("trade_date", "symbol", "universe_weight", F.col("period").alias("rebalance_id"))


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09")
    return x.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("event_date")).agg(
        F.lit("cash_dividend").alias("event_type"), F.round(F.sum(0.01 * F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("event_value")
    )
