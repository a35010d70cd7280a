"""The research panel: features and labels by name and week, the universe joined to them, and what is selected from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross as X
from ..functions import rolling as V
from ..functions import windows as W
from ..sources import market

FEATURES = ["mom20", "rev5", "vol20", "liq5_20"]


def forward_return(start: int = 1, end: int = 20) -> Column:
    """Bought `start` rows after the signal, sold `end` rows after it."""
    return W.ratio(W.lead("close", end), W.lead("close", start)) - 1


def weekly_panel(spark, sf_dir: str, momenta: tuple[int, ...] = ()) -> DataFrame:
    """Weekly bars with four features and the label, and the change over further numbers of rows as mom<n>; one pass over sorted rows."""
    names = [*market.BAR[2:], "ret", *FEATURES, "fwd", *[f"mom{n}" for n in momenta]]

    def body(t: V.Rows) -> dict[str, V.Vec]:
        t.add(ret=t.pct_change("close", 1))
        made = {"mom20": t.pct_change("close", 20), "rev5": -t.pct_change("close", 5), "vol20": t.std("ret", 20), "liq5_20": t.ratio(t.mean("volume", 5), t.mean("volume", 20))}
        made |= {f"mom{n}": t.pct_change("close", n) for n in momenta}
        return {x: t.col(x) for x in (*market.BAR[2:], "ret")} | made | {"fwd": t.ratio(t.lead("close", 20), t.lead("close", 1)) - 1}

    return V.over_rows(market.weekly_bar(spark, sf_dir), market.BAR[2:], names, body, None)


def model_dataset(spark, sf_dir: str) -> DataFrame:
    """universe, features, labels and tradability on (trade_date, symbol); rows with all features."""
    keys = ["trade_date", "symbol"]
    # features, label and tradability are windows over the same bars: one pass, one exchange by symbol
    panel = market.tradability(weekly_panel(spark, sf_dir), carried=(*FEATURES, "fwd")).select(*keys, *FEATURES, "fwd", "can_buy", "can_sell", "is_new_listing", "is_st")
    # rows without a feature are out anyway, so the outer join to the universe is an inner one
    return market.universe_membership(market.weekly_bar(spark, sf_dir)).join(panel.dropna(subset=FEATURES), keys)


def rank_ic(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman by date: Pearson of average ranks on rows where both are known; 0 without spread; dates with one row are out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("trade_date", "symbol", x, y)
    ranked = both.withColumns({"rx": X.average_rank(x), "ry": X.average_rank(y)})
    out = ranked.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("dx"), F.count_distinct(y).alias("dy"), W.pair_corr("rx", "ry").alias("c")
    )
    ic = F.when((F.col("dx") < 2) | (F.col("dy") < 2) | F.col("c").isNull() | F.isnan("c"), 0.0).otherwise(F.col("c"))
    return out.where("n >= 2").select("trade_date", "n", ic.alias("rank_ic"))


def ic_summary(ic: DataFrame, value: str = "rank_ic") -> DataFrame:
    x = F.col(value)
    sd = F.stddev_pop(x)
    return ic.agg(
        F.count(x).alias("n_dates"),
        F.avg(x).alias("mean_ic"),
        sd.alias("std_ic"),
        F.when(sd <= 1e-12, 0.0).otherwise(W.ratio(F.avg(x), sd)).alias("ir"),
        F.avg(F.when(x > 1e-12, 1.0).otherwise(0.0)).alias("positive_rate"),
        F.avg(F.abs(x)).alias("mean_abs_ic"),
    )


def quantile_returns(df: DataFrame, x: str, y: str, q: int = 5) -> DataFrame:
    """Mean label by date and bucket, then mean, spread and size over dates."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bucket", X.bucket_of_rank(x, q))
    daily = both.groupBy("trade_date", "bucket").agg(F.avg(y).alias("m"))
    return daily.groupBy("bucket").agg(F.avg("m").alias("mean_forward_return"), F.stddev_samp("m").alias("std_forward_return"), F.count(F.lit(1)).alias("n_dates"))


def long_short(df: DataFrame, x: str, y: str, q: int = 5) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bucket", X.bucket_of_rank(x, q))
    daily = both.groupBy("trade_date", "bucket").agg(F.avg(y).alias("m"))
    ends = daily.groupBy("trade_date").agg(F.max_by("m", "bucket").alias("top"), F.min_by("m", "bucket").alias("bottom"))
    return ends.select("trade_date", (F.col("top") - F.col("bottom")).alias("long_short"))


def signal_ranks(df: DataFrame, score: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc_nulls_last(score), "symbol"))
    return df.where(F.col(score).isNotNull()).withColumn("signal_rank", r)


def signal_stats(df: DataFrame, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("scored_count"), F.max(score).alias("top_score"), F.percentile(F.col(score), F.lit(0.5)).alias("median_score"), F.min(score).alias("bottom_score")
    )


def selection_turnover(ranked: DataFrame, n: int) -> DataFrame:
    """1 - kept / selected against the date before; 0 on the first date."""
    held = ranked.where(F.col("signal_rank") <= n).groupBy("trade_date").agg(F.sort_array(F.collect_set("symbol")).alias("held"))
    before = F.lag("held").over(Window.orderBy("trade_date"))  # one row a date
    kept = F.size(F.array_intersect("held", before))
    return held.select("trade_date", F.size("held").alias("selected"), F.when(before.isNull(), 0.0).otherwise(1 - kept / F.size("held")).alias("turnover"))


def reasons(df: DataFrame) -> DataFrame:
    """Why a candidate may not be held; a later rule overrides an earlier one."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = (
        F.when(~F.coalesce(F.col("can_buy"), F.lit(False)), "temporarily_restricted")
        .when(flag("is_new_listing"), "new_listing")
        .when(flag("is_st"), "is_st")
        .when(F.col("universe_weight").isNull(), "not_in_universe")
        .otherwise("")
    )
    return df.withColumn("reason", why)


def neutralised(df: DataFrame, x: str, least: int = 3) -> DataFrame:
    """x minus its industry's mean, and its residual on the log of traded amount."""
    return df.withColumn("size", F.ln("amount")).withColumns({f"{x}_industry": X.demeaned(x, "industry", least), f"{x}_size": X.residual(x, "size", 30)})


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the latest `value` of right at or before its date, by key: one sort of the union, no range join."""
    known = right.select(by, F.col(at), F.col(value).alias("_known"), F.lit(0).alias("_side"))
    asks = left.withColumn("_side", F.lit(1))
    both = asks.unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_known", ignorenulls=True).over(w)).where("_side = 1").drop("_known", "_side")
