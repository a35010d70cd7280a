"""What is held from one rebalance date to the next: buffer, exposure, smoothing and cost filter as one ordered fold.

A strategy's state (weights held and for how long, last scores, smoothed weights) goes from date to date; strategies run in parallel. The
cost filter compares with what the step before left held, not with what was wanted then.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.folds import fold
from ..functions.ranks import PARTS, global_ranks, value_bucket


@dataclass(frozen=True)
class Rules:
    # fixed values
    retain_rank: int = 50
    score_drop: float = 0.1
    retain_share: float = 0.6
    step: float = 0.5
    least_step: float = 0.001
    least_change: float = 0.005
    least_alpha: float = 0.0001
    cost_to_alpha: float = 0.5
    lot: int = 100
    commission: float = 0.75e-4
    stamp: float = 10e-4
    slippage: float = 5e-4
    least_trade: float = 2000.0
    equity: float = 1_000_000.0
    bucket_returns: tuple[float, ...] = (-0.012, -0.005, 0.002, 0.008, 0.015)
    other_return: float = 0.005


STATES = {"BULL": 1.0, "BEAR": 0.0, "TRENDING": 1.0, "RANGING": 0.3}
DECISIONS = (
    "strategy string, execution_date date, symbol {kind}, multiplier double, wanted_weight double, held_before double, final_weight double, "
    "bucket int, cost double, alpha double, direction string, held_for int"
)


def multipliers(state: dict, rows: pd.DataFrame, rules: Rules) -> np.ndarray:
    """Of each candidate: 1, or a half for what is held though both its rank and its score have fallen. Updates the scores of what stays.

    At most a share of the candidates is retained, best scores first; what is beyond it is left as it is, and its score isn't noted.
    """
    out = np.ones(len(rows))
    held = state.get("held", {})
    if not held:
        return out
    scores = state.setdefault("scores", {})
    names, score = rows["symbol"].astype(str).to_numpy(), rows["score"].to_numpy(float)
    is_held = np.array([n in held for n in names], bool)
    before = np.array([scores.get(n, s) for n, s in zip(names, score, strict=True)])
    with np.errstate(invalid="ignore"):
        good = (rows["rank"].to_numpy() <= rules.retain_rank) | (score / np.maximum(before, 0.001) > 1 - rules.score_drop)
    retained, most = np.flatnonzero(is_held), int(len(rows) * rules.retain_share)
    if len(retained) > most:
        retained = retained[np.argsort(-score[retained], kind="stable")][:most]
    stays = ~is_held
    stays[retained] = True
    out[stays & is_held & ~good] = 0.5
    scores.update(zip(names[stays], score[stays].tolist(), strict=True))
    return out


def smoothed(state: dict, names: np.ndarray, wanted: np.ndarray, gross: float, rules: Rules) -> np.ndarray:
    """A share of the way from the smoothed weight of before, then scaled to the date's gross exposure."""
    known = state.setdefault("smooth", {})
    now = np.array([known.get(n, 0.0) for n in names])
    away = wanted - now
    new = np.where(np.abs(away) < rules.least_step, now, now + away * rules.step)
    known.update(zip(names, new.tolist(), strict=True))
    return new / new.sum() * gross if new.sum() > 0 else new


def bucket_of(share: np.ndarray) -> np.ndarray:
    """1 to 5 by fifths of a share between 0 and 1; other scores count as between -1 and 1; unknown ones go to the lowest."""
    inside = np.where((share >= 0) & (share <= 1), share, np.clip((share + 1) / 2, 0, 1))
    return np.where(np.isnan(share), 1, 1 + sum((inside >= x).astype(int) for x in (0.2, 0.4, 0.6, 0.8)))


def filtered(now: np.ndarray, wanted: np.ndarray, price: np.ndarray, share: np.ndarray, rules: Rules) -> pd.DataFrame:
    """final_weight, bucket, cost, alpha, direction: trades that aren't worth it leave the weight as it is."""
    away = wanted - now
    value = np.abs(rules.equity * away)
    priced = price > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = np.where(priced, np.floor(value / np.where(priced, price, 1.0) / rules.lot) * rules.lot, 0.0)
    traded = shares * np.where(priced, price, 0.0)
    buys = away > 0
    cost = traded * (rules.commission + rules.slippage) + np.where(buys, 0.0, traded * rules.stamp)
    bucket = bucket_of(share)
    expected = np.array([rules.bucket_returns[b - 1] if b <= len(rules.bucket_returns) else rules.other_return for b in bucket])
    alpha = expected * np.abs(away) * rules.equity
    reasons = [
        (np.abs(away) < rules.least_change, "SKIP_TOO_SMALL"),
        (~priced, "SKIP_NO_PRICE"),
        (np.full(len(now), not (np.isfinite(rules.equity) and rules.equity > 0)), "SKIP_INVALID_EQUITY"),
        (~(np.isfinite(value) & (value > 0)), "SKIP_INVALID_DIFF"),
        (traded < rules.least_trade, "SKIP_MIN_TRADE"),
    ]
    early = np.logical_or.reduce([c for c, _ in reasons])
    reasons += [
        (buys & ((alpha <= 0) | (alpha < rules.least_alpha * rules.equity)), "SKIP_LOW_ALPHA"),
        (buys & (cost / np.maximum(alpha, 1) > rules.cost_to_alpha), "SKIP_HIGH_COST"),
        (buys, "BUY"),
    ]
    direction = np.select([c for c, _ in reasons], [d for _, d in reasons], "SELL")
    skipped = np.char.startswith(direction.astype(str), "SKIP")
    zero = lambda x: np.where(early, 0.0, x)  # noqa: E731  not estimated for what is left out before
    return pd.DataFrame({"final_weight": np.where(skipped, now, wanted), "bucket": np.where(early, 0, bucket), "cost": zero(cost), "alpha": zero(alpha), "direction": direction})


def stepped(state: dict, rows: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """One rebalance date of one strategy. rows: symbol, score, rank, share, target_weight (null where not wanted), gross, exposure, price."""
    rows = rows.assign(multiplier=multipliers(state, rows, rules))
    held, ages = state.get("held", {}), state.get("ages", {})
    t = rows[rows["target_weight"].notna()].reset_index(drop=True)
    names = t["symbol"].astype(str).to_numpy()
    wanted = (t["target_weight"] * t["multiplier"] * t["exposure"].fillna(1.0)).to_numpy(float)
    wanted = smoothed(state, names, wanted, float(t["gross"].iloc[0]), rules) if len(t) else wanted
    now = np.array([held.get(n, 0.0) for n in names])
    out = filtered(now, wanted, t["price"].to_numpy(float), t["share"].to_numpy(float), rules)
    out = out.assign(symbol=t["symbol"], multiplier=t["multiplier"], wanted_weight=wanted, held_before=now)
    gone = rows[rows["target_weight"].isna() & rows["symbol"].astype(str).isin(held)]
    before = gone["symbol"].astype(str).map(held).to_numpy(float)
    exits = pd.DataFrame({"symbol": gone["symbol"], "multiplier": gone["multiplier"], "wanted_weight": 0.0, "held_before": before, "final_weight": 0.0, "bucket": 0, "cost": 0.0, "alpha": 0.0, "direction": "EXIT"})
    kept = {n: w for n, w in zip(names, out["final_weight"].tolist(), strict=True) if w > 0}
    state["held"], state["ages"] = kept, {n: ages.get(n, 0) + 1 for n in kept}
    out = pd.concat([out, exits], ignore_index=True) if len(exits) else out
    return out.assign(held_for=[state["ages"].get(str(s), 0) for s in out["symbol"]])


def enhanced(candidates: DataFrame, rules: Rules = Rules(), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions, and each strategy's state after its last date, which a later call takes as `known`.

    candidates: strategy, execution_date, symbol, score, rank, share, target_weight, gross, exposure, price. What is held and isn't among a
    date's candidates any more is dropped without a row.
    """
    schema = DECISIONS.format(kind=candidates.schema["symbol"].dataType.simpleString())
    rows = candidates.select("strategy", "execution_date", "symbol", *[F.col(c).cast("double").alias(c) for c in ("score", "rank", "share", "target_weight", "gross", "exposure", "price")])
    both = fold(rows, "strategy", "execution_date", ["rank", "symbol"], lambda state, key, date, own: stepped(state, own, rules), schema, known)
    return both.where("state is null").drop("state"), both.where("state is not null").select("strategy", "execution_date", "state")


def trade_summary(decisions: DataFrame) -> DataFrame:
    """By strategy and date: trades of each kind, why others were left out, and sums of cost and alpha."""
    count = lambda c: F.count_if(c).alias
    d = F.col("direction")
    return decisions.groupBy("strategy", "execution_date").agg(
        count(d == "BUY")("buys"), count(d == "SELL")("sells"), count(d == "EXIT")("exits"), count(d.startswith("SKIP"))("skipped"), count(d.isin("SKIP_LOW_ALPHA", "SKIP_HIGH_COST"))("not_worth_it"),
        F.sum("cost").alias("cost"), F.sum("alpha").alias("alpha"), F.sum("final_weight").alias("gross"), F.sum(F.abs(F.col("final_weight") - F.col("held_before"))).alias("moved"),
    )


def market_exposure(index: DataFrame, short: int = 20, long: int = 60, near: float = 0.03, slope: float = 0.005) -> DataFrame:
    """trade_date, market_state, exposure from an index of one row a date (trade_date, nav): where it stands to its means."""
    w = Window.orderBy("trade_date")
    x = index.select("trade_date", F.row_number().over(w).alias("i"), F.col("nav"), F.avg("nav").over(w.rowsBetween(-(short - 1), 0)).alias("s"), F.avg("nav").over(w.rowsBetween(-(long - 1), 0)).alias("l"))
    place, tilt = W.ratio(F.col("nav"), F.col("l")) - 1, W.ratio(F.col("s"), F.col("l")) - 1
    state = (
        F.when(F.col("i") < long + 10, "RANGING")
        .when((place > near) & (tilt > slope), "BULL")
        .when((place < -near) | ((place < 0) & (tilt < -slope)), "BEAR")
        .when(F.abs(place) < near, "RANGING")
        .otherwise("TRENDING")
    )
    out = x.select("trade_date", state.alias("market_state"))
    exposure = F.element_at(F.create_map(*[F.lit(v) for pair in STATES.items() for v in pair]), F.col("market_state"))
    return out.withColumn("exposure", exposure)


def calibrated(df: DataFrame, score: str, ret: str, q: int = 5, parts: int = PARTS) -> DataFrame:
    """bucket, mean_return, n: the mean return between quantiles of all scores; quantiles that fall together make one edge."""
    known = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(ret).isNotNull() & ~F.isnan(ret)).select(score, ret)
    ranked = global_ranks(known, [score], parts, least=True)
    n = known.count()
    by = ranked.withColumn("b", value_bucket(F.col(f"{score}_least"), n, q)).groupBy("b").agg(F.avg(ret).alias("mean_return"), F.count(F.lit(1)).alias("n"))
    return by.select(F.row_number().over(Window.orderBy("b")).alias("bucket"), "mean_return", "n")  # a row a bucket
