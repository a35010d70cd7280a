"""Decay and regimes, walk-forward windows, and risk checks against loops over plain lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import validation as A


def days(n):
    return [d.date() for d in pd.date_range("2020-01-01", periods=n)]


def status(ics):
    """Of a list of ICs, the last one being the newest."""
    if len(ics) < 60:
        return "active"
    x = ics[-60:]
    if x[-1] < -0.03:
        return "offline"
    down = up = 0
    for v in reversed(x):
        down, up = (down + 1, 0) if v < 0 else (0, up + 1)
        if down >= 5:
            return "reduced"
    if up >= 20:
        return "active"
    return "reduced" if np.mean([v > 0 for v in x]) < 0.35 else "active"


def table(spark, seed, n=150):
    g = np.random.default_rng(seed)
    series = {"a": g.normal(0.0, 0.02, n), "b": np.abs(g.normal(0, 0.02, n)), "c": np.where(np.arange(n) % 4 == 3, -0.01, 0.0), "d": g.normal(0.01, 0.01, n)}
    rows = [(d, f, float(v)) for f, x in series.items() for d, v in zip(days(n), x)]
    return series, spark.createDataFrame(rows, "trade_date date, feature string, ic double")


@pytest.mark.parametrize("seed", [1, 2])
def test_decay_status(spark, seed):
    series, df = table(spark, seed)
    got = {(r["feature"], r["trade_date"]): (r["status"], r["multiplier"]) for r in A.decay_status(df).collect()}
    seen = set()
    for f, x in series.items():
        for i, d in enumerate(days(len(x))):
            want = status(x[: i + 1].tolist())
            seen.add(want)
            assert got[f, d] == (want, {"active": 1.0, "reduced": 0.5, "offline": 0.0}[want]), (f, i)
    assert seen == {"active", "reduced", "offline"}


def test_decayed_and_regime_weights(spark):
    series, df = table(spark, 3)
    d = days(150)
    regimes = spark.createDataFrame([(t, ["bull", "bear", "ranging"][i % 3]) for i, t in enumerate(d[:-1])], "trade_date date, regime string")
    plain = {(r["feature"], r["trade_date"]): r["weight"] for r in A.decayed_weights(df, horizon=5, least=0.002).collect()}
    families = {"a": "momentum", "b": "value", "c": "reversal"}
    within = {(r["feature"], r["trade_date"]): r["weight"] for r in A.decayed_weights(df, horizon=5, least=0.002, regimes=regimes, families=families).collect()}
    for i, t in enumerate(d):
        raw, more = {}, {}
        for f, x in series.items():
            lo, hi = max(0, i - 126), i - 7  # rows that were known
            part = x[lo : hi + 1] if hi >= 0 else x[:0]
            e = np.exp(np.arange(len(part)) * np.log(2) / 20)
            base = max(float((part * e).sum() / e.sum()) if len(part) else 0.001, 0.001)
            cut = {"active": 1.0, "reduced": 0.5, "offline": 0.0}[status(x[: i - 6].tolist())] if i >= 7 else 1.0
            regime = ["bull", "bear", "ranging"][i % 3] if i < 149 else "ranging"
            raw[f] = max(base * cut, 0.002)
            more[f] = max(base * cut * A.FAMILIES[regime].get(families.get(f, ""), 1.0), 0.002)
        for f in series:
            assert np.isclose(plain[f, t], raw[f] / sum(raw.values())) and np.isclose(within[f, t], more[f] / sum(more.values()))


def test_simple_regimes(spark):
    nav = pd.Series(np.cumprod(1 + np.random.default_rng(2).normal(0, 0.04, 200)))
    got = A.simple_regimes(spark.createDataFrame([(d, float(v)) for d, v in zip(days(200), nav)], "trade_date date, nav double")).orderBy("trade_date").collect()
    for i, r in enumerate(got):
        h = nav[: i + 1]
        p = h.iloc[-1] / h.tail(60).mean() - 1
        s, long = h.tail(20).mean(), h.tail(60).mean()
        assert r["regime"] == ("ranging" if len(h) < 60 else "bull" if p > 0.05 and s > long else "bear" if p < -0.05 and s < long else "ranging")
    assert len({r["regime"] for r in got}) == 3


@pytest.mark.parametrize("expanding", [True, False])
def test_walk_forward_windows(spark, expanding):
    g = np.random.default_rng(5)
    d, names = days(53), 12
    x, y = g.normal(size=(53, names)), g.normal(scale=0.05, size=(53, names))
    rows = [(d[i], j, float(x[i, j]), float(y[i, j])) for i in range(53) for j in range(names)]
    df = spark.createDataFrame(rows, "trade_date date, symbol int, x double, y double")
    got = {r["fold"]: r for r in A.walk_forward(df, "x", "y", train=20, test=10, step=7, expanding=expanding, names=4, cost=0.001).collect()}
    ret = np.array([y[i][np.argsort(-x[i], kind="stable")[:4]].sum() / 4 - 0.001 for i in range(53)])
    ic = np.array([pd.Series(x[i]).rank().corr(pd.Series(y[i]).rank()) for i in range(53)])
    want = {}
    k = 0
    while 20 + 7 * k + 10 <= 53:
        lo = 0 if expanding else 7 * k
        train, test = slice(lo, 20 + 7 * k), slice(20 + 7 * k, 30 + 7 * k)
        nav = np.cumprod(1 + ret[test])
        want[k] = (np.mean(ic[train]), np.prod(1 + ret[train]) - 1, np.mean(ic[test]), np.prod(1 + ret[test]) - 1, np.mean(ret[test]) / np.std(ret[test], ddof=1) * 52**0.5, (nav / np.maximum.accumulate(nav) - 1).min(), (ret[test] > 0).mean())
        k += 1
    assert got.keys() == want.keys() and len(want) == 4
    for k, w in want.items():
        assert np.allclose([got[k][c] for c in ("is_ic", "is_return", "oos_ic", "oos_return", "oos_sharpe", "oos_drawdown", "oos_hits")], w)
        assert got[k]["n_test"] == 10 and got[k]["n_train"] == (20 + 7 * k if expanding else 20)
    one = A.walk_forward_verdict(A.walk_forward(df, "x", "y", train=20, test=10, step=7, names=4, cost=0.001)).first()
    assert one["n_windows"] == 4 and one["passed"] == (one["issues"] == "")
    short = df.where(F.col("trade_date") < d[25])
    assert A.walk_forward(short, "x", "y", train=20, test=10, step=7).count() == 0 and not A.walk_forward_verdict(A.walk_forward(short, "x", "y", train=20, test=10, step=7)).first()["passed"]


def frame(**changes):
    base = pd.DataFrame({"symbol": range(20), "weight": [0.04] * 20, "industry": [f"i{k % 5}" for k in range(20)], "daily_value": [1e9] * 20})
    one = {"ic": 0.01, "spread": 1.0, "coverage": 1.0, "turnover": 0.1, "cost": 0.0, "nav": 1.0, "account": 1e6}
    return base.assign(**one).assign(**changes)


def names(state, own):
    return {(r.check, r.level) for r in A.checked(state, own, A.Limits()).itertuples()}


def test_each_check():
    calm = {("rolling_ic", "LOW"), ("position_concentration", "LOW")}
    assert names({}, frame()) == calm
    assert names({}, frame(ic=-0.05)) == {("rolling_ic", "HIGH"), ("position_concentration", "LOW")}
    assert names({}, frame(spread=0.05, coverage=0.5)) == calm | {("score_spread", "MEDIUM"), ("signal_coverage", "HIGH")}
    assert ("position_concentration", "CRITICAL") in names({}, frame(weight=[0.1] + [0.04] * 19))
    assert ("position_concentration", "HIGH") in names({}, frame(weight=[0.09] + [0.04] * 19))
    assert ("position_concentration", "MEDIUM") in names({}, frame(weight=[0.075] + [0.04] * 19))
    assert ("position_concentration", "MEDIUM") in names({"emergency": True}, frame(weight=[0.09] + [0.04] * 19))
    assert ("position_count", "MEDIUM") in names({}, frame(weight=[0.08] * 9 + [0.0] * 11))
    assert ("total_exposure", "HIGH") in names({}, frame(weight=0.02)) and ("total_exposure", "CRITICAL") in names({}, frame(weight=0.06))
    assert ("industry_exposure", "HIGH") in names({}, frame(industry="one"))
    assert ("turnover", "HIGH") in names({}, frame(turnover=0.4)) and ("cost_ratio", "CRITICAL") in names({}, frame(cost=0.3))
    assert ("liquidity", "MEDIUM") in names({}, frame(daily_value=[1e6] + [1e9] * 19))
    deep = {"peak": 1.0, "dates": 30}
    assert ("current_drawdown", "HIGH") in names(dict(deep), frame(nav=0.83)) and ("current_drawdown", "CRITICAL") in names(dict(deep), frame(nav=0.7))
    assert names({"peak": 1.0, "dates": 3}, frame(nav=0.7)) == calm


def test_emergency_goes_from_date_to_date(spark):
    plan = [{}, {"cost": 0.3}, {"turnover": 0.4}, {}, {"turnover": 0.4}, {"turnover": 0.4, "ic": -0.1, "coverage": 0.1, "industry": "one"}, {"ic": -0.1}, {}]
    held = pd.concat([frame(**c).assign(strategy="s", execution_date=d) for c, d in zip(plan, days(len(plan)))])
    got = A.risk_checks(spark.createDataFrame(held)).where("check = 'rolling_ic'").orderBy("execution_date").collect()
    assert [r["emergency"] for r in got] == [False, True, True, False, False, True, True, False]
