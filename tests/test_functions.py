"""Window functions against pandas, folds, the catalog and the stream."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import cross as X
from quantloom.functions import windows as W
from quantloom.operators import factors, models, panel, portfolio, research
from quantloom.sources import catalog, market
from quantloom.streaming import bars


@pytest.fixture(scope="module")
def series(spark):
    g = random.Random(2)
    rows = []
    for s in (1, 2):
        for d in pd.bdate_range("2024-01-01", periods=60):
            x = None if g.random() < 0.1 else g.choice([g.uniform(1, 9), 5.0])
            rows.append((s, d.date(), x, g.uniform(1, 9)))
    return spark.createDataFrame(rows, "symbol bigint, trade_date date, x double, y double")


def by_symbol(df, name):
    p = df.toPandas().sort_values(["symbol", "trade_date"])
    return p, p[name].to_numpy(float)


@pytest.mark.parametrize(
    "column, same",
    [
        (lambda: W.mean("y", 7), lambda s: s.rolling(7).mean()),
        (lambda: W.std("y", 7), lambda s: s.rolling(7).std()),
        (lambda: W.skew("y", 9), lambda s: s.rolling(9).skew()),
        (lambda: W.kurt("y", 9), lambda s: s.rolling(9).kurt()),
        (lambda: W.quantile("y", 8, 0.3), lambda s: s.rolling(8).quantile(0.3)),
        (lambda: W.ts_rank("y", 6), lambda s: s.rolling(6).rank(pct=True)),
        (lambda: W.argmax("y", 6), lambda s: s.rolling(6).apply(np.argmax)),
        (lambda: W.pct_change("y", 3), lambda s: s.pct_change(3)),
        (lambda: W.running("y"), lambda s: s.cumsum()),
    ],
)
def test_windows_are_those_of_pandas(series, column, same):
    p, got = by_symbol(series.withColumn("z", column()), "z")
    want = p.groupby("symbol")["y"].transform(same).to_numpy(float)
    assert np.allclose(got, want, equal_nan=True, atol=1e-9)


def test_full_windows_need_all_values(series):
    p, got = by_symbol(series.withColumn("z", W.mean("x", 5)), "z")
    want = p.groupby("symbol")["x"].transform(lambda s: s.rolling(5).mean()).to_numpy(float)
    assert np.allclose(got, want, equal_nan=True, atol=1e-9) and np.isnan(got).sum() > 8


def test_exponential_recursion(series):
    got = W.ewm(series, "y", {"e": 9}).toPandas().sort_values(["symbol", "trade_date"])["e"].to_numpy()
    want = series.toPandas().sort_values(["symbol", "trade_date"]).groupby("symbol")["y"].transform(lambda s: s.ewm(span=9, adjust=False).mean()).to_numpy()
    assert np.allclose(got, want, atol=1e-9)


def test_cross_section(spark):
    rows = [(i, pd.Timestamp("2024-01-02").date(), v) for i, v in enumerate([1.0, 2.0, 2.0, None, 100.0])] + [(9, pd.Timestamp("2024-01-03").date(), None)]
    df = X.processed(spark.createDataFrame(rows, "symbol int, trade_date date, x double"), "x").toPandas()
    first = df[df.symbol < 9].sort_values("symbol")["x"].to_numpy()
    x = pd.Series([1.0, 2.0, 2.0, np.nan, 100.0])
    x = x.clip(x.quantile(0.01), x.quantile(0.99))
    x = x.fillna(x.median())
    assert np.allclose(first, (x - x.mean()) / x.std(ddof=0))
    assert df[df.symbol == 9]["x"].iloc[0] == 0.0


def test_as_of_takes_the_latest_known(spark):
    day = lambda k: pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=k)
    left = spark.createDataFrame([("a", day(k)) for k in (0, 3, 5, 9)] + [("b", day(4))], "k string, t date")
    right = spark.createDataFrame([("a", day(3), 1.0), ("a", day(6), 2.0), ("b", day(5), 9.0)], "k string, t date, v double")
    got = {(r["k"], r["t"].day - 1): r["v"] for r in panel.as_of(left, right, "k", "t", "v").collect()}
    assert got == {("a", 0): None, ("a", 3): 1.0, ("a", 5): 1.0, ("a", 9): 2.0, ("b", 4): None}


def test_registry_refuses_a_second_factor_of_a_name(spark):
    with pytest.raises(ValueError):
        factors.add("mom20", "momentum", 21, lambda: F.lit(0.0), "0")
    assert factors.REGISTRY.inventory(spark).count() == len(factors.REGISTRY) > 100


def test_ic_weights_only_look_back(spark):
    rows = [(pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=7 * i), f, float(i) if f == "a" else 1.0) for i in range(120) for f in ("a", "b")]
    w = models.ic_weights(spark.createDataFrame(rows, "trade_date date, feature string, ic double"), horizon=20, lookback=60).toPandas()
    a = w[w.feature == "a"].sort_values("trade_date")["weight"].to_numpy()
    assert np.allclose(a[:22], 0.5)  # nothing known yet
    assert a[100] == pytest.approx(np.mean(range(100 - 81, 100 - 21)) / (np.mean(range(100 - 81, 100 - 21)) + 1))


def test_smoothing_takes_half_steps(spark):
    d = [pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=7 * i) for i in range(3)]
    w = spark.createDataFrame([(d[0], 1, 0.8), (d[1], 2, 0.4), (d[2], 2, 0.4)], "trade_date date, symbol int, target_weight double")
    got = {(r["symbol"], d.index(r["trade_date"])): round(r["held_weight"], 6) for r in portfolio.smoothed(w).collect()}
    assert got == {(1, 0): 0.4, (1, 1): 0.2, (1, 2): 0.1, (2, 1): 0.2, (2, 2): 0.3}


def test_states_step_down_and_never_straight_back(spark):
    ics = [-0.05] * 16 + [0.1] * 3
    rows = [("f", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), v) for i, v in enumerate(ics)]
    got = [r["state"] for r in research.factor_states(spark.createDataFrame(rows, "feature string, trade_date date, ic double")).orderBy("trade_date").collect()]
    assert got[3:5] == ["ACTIVE", "WATCH"] and got[9] == "REDUCED" and got[14] == "OFFLINE" and set(got[16:]) == {"RESERVE"}


def test_small_helpers():
    assert research.redundant_groups([("a", "b", 0.9), ("b", "c", -0.8), ("d", "e", 0.1)]) == [{"a", "b", "c"}]
    decay = [(h, 0.1 * math.exp(-h / 30)) for h in (2, 5, 10, 20)]
    assert research.half_life(decay) == pytest.approx(30 * math.log(2))


def test_catalog_round_trip(spark, sf, tmp_path):
    cat = catalog.Catalog(spark, str(tmp_path))
    b = market.daily_bar(spark, sf)
    cat.promote({"daily_bar": b})
    entries = {r["zone"]: r for r in cat.registry().collect()}
    assert set(entries) == {"raw", "bronze", "silver"} and len({r["digest"] for r in entries.values()}) == 1
    assert cat.query("select count(*) as n from daily_bar").first()["n"] == entries["raw"]["row_count"] == b.count()
    with pytest.raises(ValueError):
        cat.write("daily_bar", "raw", b.drop("close"))


def test_stream_gives_the_bars_of_the_table(spark, sf, tmp_path):
    events = market.table(spark, sf, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = bars.event_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in bars.event_bars(events).collect()}
    assert {tuple(r) for r in spark.table("bars").collect()} == want and want
