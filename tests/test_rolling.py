"""Rolling functions over sorted rows give what Spark's windows give, however the rows are cut into batches."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import windows as W


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in ((1, 90), (2, 3), (3, 41), (None, 30)):
        for i in range(n):
            x = None if symbol == 1 and i % 23 == 7 else 0.1 if symbol == 3 and i > 10 else math.inf if symbol == 1 and i == 40 else float(rng.integers(1, 9)) / 3
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), x, float(rng.integers(1, 50))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol bigint, trade_date date, x double, y double").cache()


CALLS = {
    "lag": lambda t: t.lag("y", 3),
    "pct": lambda t: t.pct_change("y", 2),
    "mean": lambda t: t.mean("x", 7),
    "total": lambda t: t.total("x", 12),
    "std": lambda t: t.std("x", 5),
    "skew": lambda t: t.skew("y", 11),
    "kurt": lambda t: t.kurt("y", 11),
    "top": lambda t: t.highest("x", 13),
    "low": lambda t: t.lowest("y", 6),
    "median": lambda t: t.quantile("y", 9, 0.3),
    "corr": lambda t: t.corr("y", "x", 10),
    "rank": lambda t: t.ts_rank("y", 8),
    "argmax": lambda t: t.argmax("y", 8),
    "sum": lambda t: t.running("y"),
}


class Native:
    def __getattr__(self, name):
        return getattr(W, name)


@pytest.mark.parametrize("rows", [7, 1 << 15])
def test_as_windows_do(spark, frame, rows):
    mine = R.over_rows(frame, ["x", "y"], list(CALLS), lambda t: {k: f(t) for k, f in CALLS.items()}, 20, rows=rows).collect()
    theirs = frame.select("symbol", "trade_date", *[f(Native()).cast("double").alias(k) for k, f in CALLS.items()]).collect()
    want = {(r["symbol"], r["trade_date"]): r for r in theirs}
    assert len(mine) == len(want) == 164
    for r in mine:
        for k in CALLS:
            a, b = r[k], want[r["symbol"], r["trade_date"]][k]
            assert (a is None) == (b is None) and (a is None or a == b or (a != a and b != b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (k, r["symbol"], r["trade_date"], a, b)


def test_no_spread_is_none_and_nothing_is_left_behind(frame):
    out = R.over_rows(frame, ["x"], ["sd", "m"], lambda t: {"sd": t.std("x", 20), "m": t.mean("x", 20)}, 20).where("symbol = 3 and trade_date > '2020-02-01'")
    assert {(r["sd"], round(r["m"], 12)) for r in out.collect()} == {(0.0, 0.1)}


def test_ranks_of_whole_histories(frame):
    mine = R.over_rows(frame, ["x"], ["q"], lambda t: {"q": t.whole_rank("x")}, None, rows=7).collect()
    by = {}
    for r in frame.collect():
        by.setdefault(r["symbol"], {})[r["trade_date"]] = r["x"]
    for r in mine:
        known = [v for v in by[r["symbol"]].values() if v is not None]
        x = by[r["symbol"]][r["trade_date"]]
        assert r["q"] is None if x is None else math.isclose(r["q"], (sum(v < x for v in known) + (known.count(x) + 1) / 2) / len(known))


@pytest.mark.parametrize("name", ["factors_volatility", "factors_liquidity", "factors_technical", "factors_distribution"])
def test_factor_families_take_no_sliding_window(spark, sf, name):
    from quantloom.plans import all_queries

    plan = all_queries()[name][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["alphas_price_a", "alphas_price_b", "alphas_ranked", "factors_further"])
def test_alphas_sort_a_symbols_rows_once(spark, sf, name):
    """No sliding window, and one sort behind the bars, whatever ranks over whole histories they take."""
    from quantloom.plans import all_queries

    plan = all_queries()[name][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1 and plan.count("Sort [") == 1


def test_percentile_of_a_column_no_task_holds(spark):
    from quantloom.functions.ranks import percentile

    df = spark.range(0, 40_000).select(F.when(F.col("id") % 7 > 0, F.sin("id")).alias("x"), F.when(F.col("id") % 3 > 0, F.lit(2.0)).otherwise(F.col("id") * 1.0).alias("y"))
    for c in ("x", "y"):
        for q in (0.0, 0.31, 0.5, 1.0):
            want = df.agg(F.percentile(c, F.lit(q))).first()[0]
            assert percentile(df, c, q, most=100) == pytest.approx(want, abs=1e-12), (c, q)
    assert percentile(df.where("x > 2"), "x", 0.5) is None


def test_correlations_come_from_sums_of_tasks(spark, frame):
    from quantloom.operators.research import correlations

    df = frame.where("x is null or x < 100").withColumns({"z": F.col("y") * -2.0, "one": F.lit(3.0)}).repartition(5)
    got = {(r["factor_a"], r["factor_b"]): r["corr"] for r in correlations(df, ["x", "y", "z", "one"]).collect()}
    assert got["y", "z"] == pytest.approx(-1) and got["y", "one"] is None
    assert got["x", "y"] == pytest.approx(df.dropna(subset=["x"]).agg(F.corr("x", "y")).first()[0])
    assert "Aggregate" not in correlations(df, ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()


def test_panel_is_one_pass(spark, sf):
    from quantloom.operators.panel import weekly_panel

    assert "Window" not in weekly_panel(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
