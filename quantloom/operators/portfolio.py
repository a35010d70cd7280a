"""From scores to target weights, and the folds over dates that depend on what is already held."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAV = "scenario string, trade_date date, cash double, market_value double, equity double, trade_notional double, trade_cost double, turnover double"


def schedule(dates: DataFrame, every: int = 4, delay: int = 1) -> DataFrame:
    """Every k-th date executes what was signalled `delay` dates before."""
    w = Window.orderBy("trade_date")  # one row a date
    numbered = dates.withColumns({"i": F.row_number().over(w) - 1, "signal_date": F.lag("trade_date", delay).over(w)})
    return numbered.where((F.col("i") % every == 0) & F.col("signal_date").isNotNull()).select("signal_date", F.col("trade_date").alias("execution_date"))


def top_n(ranked: DataFrame, n: int, gross: DataFrame | None = None, max_single: float = 0.1) -> DataFrame:
    """Equal weights of the n best: min(max_single, gross / how many there are)."""
    chosen = ranked.where(F.col("signal_rank") <= n)
    if gross is not None:
        chosen = chosen.join(F.broadcast(gross.select("trade_date", "gross_exposure")), "trade_date", "left")
    exposure = F.coalesce("gross_exposure", F.lit(1.0)) if gross is not None else F.lit(1.0)
    size = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    return chosen.withColumn("target_weight", F.least(F.lit(max_single), exposure / size))


def constrained(weights: DataFrame, max_single: float = 0.08) -> DataFrame:
    """Clamp single weights and scale back to the date's total of before, at most 1."""
    day = Window.partitionBy("trade_date")
    w = weights.withColumn("before", F.sum("target_weight").over(day)).withColumn("clamped", F.least(F.col("target_weight"), F.lit(max_single)))
    return w.withColumn("final_weight", F.col("clamped") * F.least(F.lit(1.0), F.col("before")) / F.sum("clamped").over(day)).drop("before", "clamped")


def rebalance(current: DataFrame, target: DataFrame, small: float = 0.005) -> DataFrame:
    """Full outer join of what is held and what is wanted; small trades are left out."""
    both = current.withColumnRenamed("weight", "current_weight").join(target.withColumnRenamed("weight", "new_weight"), "symbol", "full")
    delta = F.coalesce("new_weight", F.lit(0.0)) - F.coalesce("current_weight", F.lit(0.0))
    act = F.when(F.abs(delta) < small, "hold").when(delta > 0, "buy").otherwise("sell")
    return both.select("symbol", F.coalesce("current_weight", F.lit(0.0)).alias("current_weight"), F.coalesce("new_weight", F.lit(0.0)).alias("new_weight"), act.alias("action"))


def smoothed(weights: DataFrame, share: float = 0.5, least: float = 1e-4) -> DataFrame:
    """trade_date, symbol, target_weight -> what is held when only `share` of each step is taken, and that scaled to the date's gross target.

    w += share * (target - w) over all dates, one Arrow group a name; a name that left the target is held until less than `least` is left.
    """
    dates = weights.groupBy("trade_date").agg(F.sum("target_weight").alias("gross"))
    grid = weights.select("symbol").distinct().crossJoin(F.broadcast(dates)).join(weights, ["trade_date", "symbol"], "left")  # a row a name and date
    kind = weights.schema["symbol"].dataType.simpleString()

    def task(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("trade_date")
        targets = pd.Series([0.0, *own["target_weight"].fillna(0.0)])
        return own[["trade_date", "symbol", "gross"]].assign(held_weight=targets.ewm(alpha=share, adjust=False).mean().to_numpy()[1:])

    held = grid.groupBy("symbol").applyInPandas(task, f"trade_date date, symbol {kind}, gross double, held_weight double").where(F.col("held_weight") >= least)
    total = F.sum("held_weight").over(Window.partitionBy("trade_date"))
    return held.select("symbol", "trade_date", "held_weight", (F.col("held_weight") * F.col("gross") / total).alias("scaled_weight"))


def backtest(market: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One account for each scenario, folded over dates; scenarios run in parallel.

    market: trade_date, symbol, open, close, can_buy, can_sell, weight (null where no order), dividend (cash a share).
    scenarios: scenario, cash, lot, commission, stamp, slippage, least_trade. Only names that a scenario can hold are sent to
    it. Sells come first, by symbol; buys by weight, as far as the cash goes; fees are commission, and stamp on sells.
    """
    held = market.where(F.col("weight").isNotNull()).select("symbol").distinct()
    rows = market.join(held, "symbol", "left_semi").crossJoin(F.broadcast(scenarios))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        s = df.iloc[0]
        cash, shares, last, out = float(s.cash), {}, {}, []
        for day, rows in df.sort_values(["trade_date", "symbol"]).groupby("trade_date", sort=True):
            for r in rows[rows.dividend.notna()].itertuples():
                cash += shares.get(r.symbol, 0) * r.dividend
            price = {r.symbol: r.open for r in rows.itertuples() if r.open > 0}
            equity = cash + sum(n * price.get(x, last.get(x, 0.0)) for x, n in shares.items())
            wanted = {r.symbol: r.weight for r in rows.itertuples() if r.weight == r.weight and r.weight is not None}
            notional = fees = 0.0
            if wanted:
                lots = {}
                for x in {*shares, *wanted}:
                    p = price.get(x)
                    if p:
                        n = math.floor(equity * wanted.get(x, 0.0) / p / s.lot) * s.lot
                        lots[x] = n if n * p >= s.least_trade else 0
                can = {r.symbol: (r.can_buy, r.can_sell) for r in rows.itertuples()}
                for x in sorted(lots):
                    n = shares.get(x, 0) - lots[x]
                    if n > 0 and can[x][1]:
                        value = n * price[x] * (1 - s.slippage)
                        fee = value * (s.commission + s.stamp)
                        cash, notional, fees = cash + value - fee, notional + value, fees + fee
                        shares[x] = lots[x]
                for x in sorted(lots, key=lambda y: (-wanted.get(y, 0.0), y)):
                    n = lots[x] - shares.get(x, 0)
                    p = price[x] * (1 + s.slippage)
                    n = min(n, math.floor(cash / (p * (1 + s.commission)) / s.lot) * s.lot)
                    if n > 0 and can[x][0] and n * p >= s.least_trade:
                        fee = n * p * s.commission
                        cash, notional, fees = cash - n * p - fee, notional + n * p, fees + fee
                        shares[x] = shares.get(x, 0) + n
            last |= {r.symbol: r.close for r in rows.itertuples() if r.close > 0}
            shares = {x: n for x, n in shares.items() if n}
            value = sum(n * last.get(x, 0.0) for x, n in shares.items())
            out.append((s.scenario, day, round(cash, 2), round(value, 2), round(cash + value, 2), round(notional, 2), round(fees, 2), round(notional / equity, 6) if equity else 0.0))
        return pd.DataFrame(out, columns=[x.split()[0] for x in NAV.split(", ")])

    return rows.groupBy("scenario").applyInPandas(run, NAV)
