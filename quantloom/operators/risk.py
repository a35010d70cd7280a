"""Risk of target weights: constraints, cost scenarios, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ratio


def exposure_report(weights: DataFrame, industries: DataFrame, max_industry: float = 0.3, max_single: float = 0.1) -> DataFrame:
    """By date: names, gross exposure, the largest single and industry weight, and a level."""
    w = weights.join(industries, "symbol", "left")
    by = w.groupBy("trade_date", F.coalesce("industry", F.lit("unknown")).alias("industry")).agg(F.sum("weight").alias("w"), F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))
    day = by.groupBy("trade_date").agg(F.sum("n").alias("n_names"), F.sum("w").alias("gross"), F.max("top").alias("max_single"), F.max("w").alias("max_industry"))
    over = (F.col("max_single") > max_single).cast("int") + (F.col("max_industry") > max_industry).cast("int") + (F.col("gross") > 1.0 + 1e-9).cast("int")
    return day.withColumn("level", F.when(over == 0, "ok").when(over == 1, "warn").otherwise("breach"))


def cost_scenarios(turnover: DataFrame, gross_return: DataFrame, multipliers: list[float], unit_cost: float = 0.001) -> DataFrame:
    """Net return under each cost multiplier, and whether it survives. Both inputs have one row a date."""
    grid = turnover.sparkSession.createDataFrame([(m,) for m in multipliers], "multiplier double")
    both = turnover.join(gross_return, "trade_date").crossJoin(F.broadcast(grid))
    out = both.groupBy("multiplier").agg(F.sum(F.col("daily_return") - F.col("turnover") * F.col("multiplier") * unit_cost).alias("net_return"))
    return out.withColumn("survives", F.col("net_return") > 0)


def gate(ic: DataFrame, buckets: DataFrame, navs: DataFrame, turnover: DataFrame) -> DataFrame:
    """One row a check: value, threshold, passed. A check without data is skipped, and not passed."""
    i = ic.agg(F.avg("rank_ic").alias("ic"), F.stddev_samp("rank_ic").alias("sd"))
    i = i.select("ic", ratio(F.col("ic"), F.col("sd")).alias("ir"))
    x, y = F.col("bucket").cast("double"), F.col("mean_forward_return")
    b = buckets.agg(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("monotonicity"))
    top = F.max("nav").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    n = navs.withColumn("dd", F.col("nav") / top - 1).agg((-F.min("dd")).alias("max_drawdown"))
    t = turnover.agg(F.avg("turnover").alias("turnover"))
    row = i.crossJoin(b).crossJoin(n).crossJoin(t)  # one row each
    checks = [("ic", 0.02, 1), ("ir", 0.15, 1), ("monotonicity", 0.6, 1), ("max_drawdown", 0.3, -1), ("turnover", 0.5, -1)]
    each = [
        F.struct(
            F.lit(c).alias("check_name"), F.col(c).alias("value"), F.lit(th).alias("threshold"), F.coalesce(F.col(c) >= th if sign > 0 else F.col(c) <= th, F.lit(False)).alias("passed"), F.col(c).isNull().alias("skipped")
        )
        for c, th, sign in checks
    ]
    return row.select(F.explode(F.array(*each)).alias("z")).select("z.*")
