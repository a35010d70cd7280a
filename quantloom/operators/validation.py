"""Weights that follow a factor's decay and the market's state, walk-forward verdicts, and risk checks with an emergency mode."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.folds import fold
from . import models as M

#: How factors of a family weigh in a market state; others weigh 1. Fixed values.
FAMILIES = {
    "bull": {"momentum": 1.5, "quality": 1.2, "value": 0.8, "reversal": 0.5},
    "bear": {"momentum": 0.3, "quality": 1.3, "value": 1.5, "reversal": 0.8},
    "ranging": {"momentum": 0.5, "quality": 1.3, "value": 1.0, "reversal": 1.5},
}


def decay_status(ics: DataFrame, lookback: int = 60, low: float = -0.03, run: int = 5, cut: float = 0.5, least_positive: float = 0.35) -> DataFrame:
    """trade_date, feature, status, multiplier, from the last `lookback` ICs of a feature up to the date; active where there are fewer.

    offline: the latest is under `low`. reduced: somewhere among them stand `run` below 0 in a row, or too few are above 0 (unless the
    oldest 4 * run all reach 0). Else active.
    """
    by = M.dates()
    back = lambda a, b: by.rowsBetween(-a, -b)
    x = ics.select("trade_date", "feature", "ic").withColumn("i", F.row_number().over(by))
    x = x.withColumn("down", F.col("i") - F.coalesce(F.max(F.when(~(F.col("ic") < 0), F.col("i"))).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    bad = F.max((F.col("down") >= run).cast("int")).over(back(lookback - run, 0)) == 1  # a run that lies among them as a whole
    steady = F.min("ic").over(back(lookback - 1, lookback - 4 * run)) >= 0
    few = F.avg((F.col("ic") > 0).cast("double")).over(back(lookback - 1, 0)) < least_positive
    status = F.when(F.col("i") < lookback, "active").when(F.col("ic") < low, "offline").when(bad, "reduced").when(steady, "active").when(few, "reduced").otherwise("active")
    out = x.withColumn("status", status)
    return out.select("trade_date", "feature", "status", F.when(F.col("status") == "offline", 0.0).when(F.col("status") == "reduced", cut).otherwise(1.0).alias("multiplier"))


def simple_regimes(index: DataFrame, short: int = 20, long: int = 60, far: float = 0.05) -> DataFrame:
    """trade_date, regime (bull, bear, ranging) of an index of one row a date (trade_date, nav)."""
    w = Window.orderBy("trade_date")
    x = index.select("trade_date", "nav", F.row_number().over(w).alias("i"), F.avg("nav").over(w.rowsBetween(-(short - 1), 0)).alias("s"), F.avg("nav").over(w.rowsBetween(-(long - 1), 0)).alias("l"))
    place = W.ratio(F.col("nav"), F.col("l")) - 1
    known = F.col("i") >= long
    return x.select("trade_date", F.when(known & (place > far) & (F.col("s") > F.col("l")), "bull").when(known & (place < -far) & (F.col("s") < F.col("l")), "bear").otherwise("ranging").alias("regime"))


def decayed_weights(ics: DataFrame, horizon: int = 20, lookback: int = 120, half_life: float = 20.0, floor: float = 0.001, least: float = 0.05, regimes: DataFrame | None = None, families: dict[str, str] | None = None, **decay) -> DataFrame:
    """trade_date, feature, weight, status: exponentially weighted ICs that were known by then, times the decay's multiplier, and the family's in
    the date's regime, floored and normalised by date.
    """
    by = M.dates()
    w = by.rowsBetween(-(horizon + 1 + lookback), -(horizon + 2))
    x = ics.join(decay_status(ics, **decay), ["trade_date", "feature"])
    x = x.withColumn("k", F.row_number().over(by)).withColumn("e", F.exp(F.col("k") * (0.6931471805599453 / half_life)))
    mean = F.sum(F.col("ic") * F.col("e")).over(w) / F.sum("e").over(w)
    x = x.withColumns({"base": F.greatest(F.coalesce(mean, F.lit(floor)), F.lit(floor)), "known": F.coalesce(F.lag("status", horizon + 2).over(by), F.lit("active")), "cut": F.coalesce(F.lag("multiplier", horizon + 2).over(by), F.lit(1.0))})
    if regimes is not None:
        table = F.create_map(*[F.lit(v) for regime, own in FAMILIES.items() for f, family in (families or {}).items() if family in own for v in (f"{regime}|{f}", own[family])]) if families else F.create_map(F.lit(""), F.lit(1.0))
        x = x.join(regimes.select("trade_date", "regime"), "trade_date", "left")
        x = x.withColumn("cut", F.col("cut") * F.coalesce(F.try_element_at(table, F.concat_ws("|", F.coalesce("regime", F.lit("ranging")), "feature")), F.lit(1.0)))
    raw = F.greatest(F.col("base") * F.col("cut"), F.lit(least))
    return x.select("trade_date", "feature", (raw / F.sum(raw).over(Window.partitionBy("trade_date"))).alias("weight"), F.col("known").alias("status"))


def walk_forward(p: DataFrame, feature: str, label: str, train: int = 100, test: int = 20, step: int = 20, expanding: bool = True, names: int = 40, cost: float = 0.02 * 15.75e-4, periods: float = 52.0) -> DataFrame:
    """A row a window: training and test ICs, and of the `names` best of each test date in equal weights the return after cost, Sharpe, drawdown and hits.

    One pass over the panel gives a row a date; windows are made of those. Returns of all dates are compounded, as labels overlap this is a
    score, not an account. Training returns are there for the comparison.
    """
    long = p.select("trade_date", "symbol", F.col(feature).cast("double").alias("x"), F.col(label).cast("double").alias("y")).dropna()
    day = Window.partitionBy("trade_date")
    ranked = long.withColumns({
        "rx": (F.rank().over(day.orderBy("x")) + F.count(F.lit(1)).over(day) + 1 - F.rank().over(day.orderBy(F.desc("x")))) / 2.0,
        "ry": (F.rank().over(day.orderBy("y")) + F.count(F.lit(1)).over(day) + 1 - F.rank().over(day.orderBy(F.desc("y")))) / 2.0,
        "i": F.row_number().over(day.orderBy(F.desc("x"), "symbol")),
    })
    daily = ranked.groupBy("trade_date").agg(W.pair_corr("rx", "ry").alias("ic"), (F.sum(F.when(F.col("i") <= names, F.col("y"))) / names - cost).alias("ret"))
    daily = daily.withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)  # a row a date
    # window k: training [start, train + k step), test [train + k step, train + k step + test)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - train - test + 1) / float(step)))
    n_dates = daily.agg(F.max("i").alias("last"))
    of_test = daily.withColumn("w", F.explode(F.sequence(first.cast("int"), F.greatest(first.cast("int"), F.floor((F.col("i") - train) / float(step)).cast("int"))))).where((F.col("i") >= train + F.col("w") * step) & (F.col("i") < train + F.col("w") * step + test))
    last_window = F.floor((F.col("last") + 1 - train - test) / float(step)).cast("int")
    rows = daily.crossJoin(n_dates).where(last_window >= 0)  # one number
    reach = F.greatest(F.lit(0), F.ceil((F.col("i") - train + 1) / float(step)).cast("int"))
    of_train = rows.where(reach <= last_window).withColumn("w", F.explode(F.sequence(reach, last_window))).where((F.col("i") < train + F.col("w") * step) & (F.lit(expanding) | (F.col("i") >= F.col("w") * step)))
    growth = F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))))
    before = of_train.groupBy("w").agg(F.count(F.lit(1)).alias("n_train"), F.avg("ic").alias("is_ic"), (growth - 1).alias("is_return"))
    upto = Window.partitionBy("w").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    nav = of_test.withColumn("nav", F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(upto)))
    nav = nav.withColumn("dd", F.col("nav") / F.max("nav").over(upto) - 1)
    sd = F.stddev_samp("ret")
    after = nav.groupBy("w").agg(
        F.count(F.lit(1)).alias("n_test"), F.min("trade_date").alias("test_start"), F.max("trade_date").alias("test_end"), F.avg("ic").alias("oos_ic"), W.ratio(F.avg("ic"), F.stddev_samp("ic")).alias("oos_ic_ir"), (growth - 1).alias("oos_return"),
        F.coalesce(W.ratio(F.avg("ret"), sd) * periods**0.5, F.lit(0.0)).alias("oos_sharpe"), F.min("dd").alias("oos_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("oos_hits"),
    )
    return after.where(F.col("n_test") == test).join(before, "w").withColumnRenamed("w", "fold")


def walk_forward_verdict(windows: DataFrame) -> DataFrame:
    """One row over all windows: means, how steady they are, what is lost out of sample, and the issues (empty: passed)."""
    x = windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("oos_return").alias("mean_return"), F.stddev_pop("oos_return").alias("std_return"), F.min("oos_return").alias("min_return"), F.max("oos_return").alias("max_return"),
        F.avg("oos_sharpe").alias("mean_sharpe"), F.avg("oos_ic").alias("mean_ic"), F.avg((F.col("oos_sharpe") > 0).cast("double")).alias("sharpe_consistency"), F.avg("is_return").alias("is_return"), W.pair_corr("is_return", "oos_return").alias("is_oos_corr"),
    )
    x = x.withColumns({"stability": W.ratio(F.col("std_return"), F.abs("mean_return")), "degradation": W.ratio(F.col("mean_return"), F.col("is_return"))})
    issues = {
        "sharpe_consistency": F.col("sharpe_consistency") < 0.6,
        "degradation": F.coalesce(F.col("degradation"), F.lit(0.0)) < 0.5,
        "sharpe": F.col("mean_sharpe") < 0.3,
        "stability": F.coalesce(F.col("stability") > 2.0, F.lit(True)),
    }
    return x.withColumn("issues", F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in issues.items()])), ",")).withColumn("passed", (F.col("n_windows") > 0) & (F.col("issues") == ""))


@dataclass(frozen=True)
class Limits:
    # fixed values
    single: float = 0.08
    single_emergency: float = 0.10
    industry: float = 0.30
    least_names: int = 10
    least_gross: float = 0.5
    most_gross: float = 1.1
    trade_share: float = 0.01
    turnover: float = 0.30
    cost: float = 0.20
    drawdown: float = -0.15
    stop: float = -0.20
    ic: float = -0.02
    spread: float = 0.1
    coverage: float = 0.80


CHECKS = "strategy string, execution_date date, check string, level string, value double, threshold double, emergency boolean"


def checked(state: dict, own: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """All checks of one date. own: symbol, weight, industry, daily_value, and, the same in all rows: ic, spread, coverage, turnover, cost, nav, account.

    Only what is worse than low is returned, but for the IC and the largest position, which always are. The position limit is wider in the
    emergency mode; that begins with a critical check or more than three high ones, and ends on a date without any high one.
    """
    one, w, out = own.iloc[0], own["weight"].fillna(0.0), []
    add = lambda name, level, value, threshold: out.append((name, level, float(value), float(threshold)))
    # a lower second bound can't be met below the first, so an IC is high or low
    add("rolling_ic", "HIGH" if one["ic"] < limits.ic else "LOW", one["ic"], limits.ic)
    if one["spread"] < limits.spread:
        add("score_spread", "MEDIUM", one["spread"], limits.spread)
    if one["coverage"] < limits.coverage:
        add("signal_coverage", "HIGH", one["coverage"], limits.coverage)
    limit, top = limits.single_emergency if state.get("emergency") else limits.single, w.max()
    add("position_concentration", "CRITICAL" if top > limit * 1.2 else "HIGH" if top > limit else "MEDIUM" if top > limits.single * 0.9 else "LOW", top, limits.single)
    if (w > 0.01).sum() < limits.least_names:
        add("position_count", "MEDIUM", (w > 0.01).sum(), limits.least_names)
    gross = w.sum()
    if gross < limits.least_gross:
        add("total_exposure", "HIGH", gross, limits.least_gross)
    elif gross > limits.most_gross:
        add("total_exposure", "CRITICAL", gross, limits.most_gross)
    by_industry = w.groupby(own["industry"]).sum()
    if len(by_industry) and by_industry.max() > limits.industry:
        add("industry_exposure", "HIGH", by_industry.max(), limits.industry)
    if one["turnover"] > limits.turnover:
        add("turnover", "HIGH", one["turnover"], limits.turnover)
    if one["nav"] > 0 and one["cost"] / one["nav"] > limits.cost:
        add("cost_ratio", "CRITICAL", one["cost"] / one["nav"], limits.cost)
    state["peak"], state["dates"] = max(state.get("peak", one["nav"]), one["nav"]), state.get("dates", 0) + 1
    if state["dates"] >= 20 and state["peak"] > 0:
        down = one["nav"] / state["peak"] - 1
        if down < limits.drawdown:
            add("current_drawdown", "CRITICAL" if down < limits.stop else "HIGH", down, limits.stop if down < limits.stop else limits.drawdown)
    share = w * one["account"] / own["daily_value"]
    for s in share[(own["daily_value"] > 0) & (share > limits.trade_share)].sort_index():
        add("liquidity", "MEDIUM", s, limits.trade_share)
    levels = [x[1] for x in out]
    if "CRITICAL" in levels or levels.count("HIGH") > 3:
        state["emergency"] = True
    elif "HIGH" not in levels:
        state["emergency"] = False
    return pd.DataFrame(out, columns=["check", "level", "value", "threshold"]).assign(emergency=bool(state.get("emergency", False)))


def risk_checks(held: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """held: strategy, execution_date, symbol and the columns of `checked`. The checks of each date, folded in order for each strategy."""
    both = fold(held, "strategy", "execution_date", ["symbol"], lambda state, key, date, own: checked(state, own.reset_index(drop=True), limits), CHECKS)
    return both.where("state is null").drop("state")
