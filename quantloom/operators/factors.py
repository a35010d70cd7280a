"""The factor registry. A factor is a column over staged bars; its SQL text says the same for checking.

Stages: bars with lags and returns; then averages and running sums, of which some factors take windows again. Spark plans
each stage as one pass over rows partitioned and sorted by symbol: the stages and all factors share one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import windows as W
from ..plans import sql as S

YEAR = 252**0.5
#: Added before rounding, so that values half-way between two decimals aren't decided by the last bit of a sum's order.
NUDGE = 1e-9


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    lookback: int
    build: Callable[..., Column | R.Vec]
    sql: str
    digits: int = 6
    inputs: tuple[str, ...] = ("close",)


class Registry(dict):
    def add(self, name: str, category: str, lookback: int, build: Callable[..., Column | R.Vec], sql: str, digits: int = 6) -> None:
        if name in self:
            raise ValueError(f"factor {name} is registered twice")
        self[name] = Factor(name, category, lookback, build, sql, digits)

    def of(self, category: str) -> list[Factor]:
        return [f for f in self.values() if f.category == category]

    def inventory(self, spark) -> DataFrame:
        return spark.createDataFrame([(f.name, f.category, f.lookback) for f in self.values()], "name string, category string, lookback int")


class Native:
    """What factors are built of as Spark's own windows; `rolling.Rows` has the same functions over sorted rows."""

    col = staticmethod(F.col)
    ln, sqrt, abs = staticmethod(F.ln), staticmethod(F.sqrt), staticmethod(F.abs)

    def __getattr__(self, name: str):
        return getattr(W, name)

    def when(self, condition: Column, a: Column, b: Column) -> Column:
        return F.when(condition, a).otherwise(b)

    def number(self, condition: Column) -> Column:
        return condition.cast("double")


REGISTRY = Registry()
add = REGISTRY.add


def K(name: str) -> Column:
    return F.col(name)


def staged(bars: DataFrame) -> DataFrame:
    b = bars.select("symbol", "trade_date", *[F.col(x).alias(y) for x, y in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"), ("amount", "amt"))]).withColumn("a", F.col("c"))
    one = b.withColumns(
        {
            "ret": W.pct_change("a", 1),
            "r": 100 * W.pct_change("c", 1),
            "dv": W.pct_change("v", 1),
            "c1": W.lag("c"),
            "h1": W.lag("h"),
            "l1": W.lag("l"),
            "b1": W.lag(F.col("c") - F.col("o")),
            "b2": W.lag(F.col("c") - F.col("o"), 2),
            "g2": W.lag(F.col("h") - F.col("l"), 2),
            "tp": (F.col("h") + F.col("l") + F.col("c")) / 3,
            "av": F.col("a") * F.col("v"),
        }
    )
    two = one.withColumns(
        {
            "neg": F.when(K("ret").isNotNull(), F.least(K("ret"), F.lit(0.0))),
            "pos": F.when(K("ret").isNotNull(), F.greatest(K("ret"), F.lit(0.0))),
            "tr": F.greatest(K("h") - K("l"), F.abs(K("h") - K("c1")), F.abs(K("l") - K("c1"))),
            "il": W.ratio(F.abs(K("r") / 100), K("amt") / 1e6),
            "r1": W.lag("r"),
            "ret2": K("ret") * K("ret"),
            "obv": W.running(F.coalesce(F.signum(K("ret")), F.lit(0.0)) * K("v")),
            "chk": W.running(F.coalesce(W.ratio(K("v") * ((K("c") - K("l")) - (K("h") - K("c"))), K("h") - K("l")), F.lit(0.0))),
            "dev14": F.abs(K("tp") - W.mean("tp", 14)),
            "dev20": F.abs(K("tp") - W.mean("tp", 20)),
            "pc10": W.pct_change("c", 10),
            "pc120": W.pct_change("c", 120),
            "hh20": W.highest("h", 20),
            "ll20": W.lowest("l", 20),
        }
    )
    return two


STAGED_SQL = f"""b as (select symbol, trade_date, open as o, high as h, low as l, close as c, volume as v, amount as amt, close as a from {{bars}}),
s1 as (select *, {S.pct("a", 1)} as ret, 100 * {S.pct("c", 1)} as r, {S.pct("v", 1)} as dv, {S.lag("c")} as c1, {S.lag("h")} as h1, {S.lag("l")} as l1,
  {S.lag("c - o")} as b1, {S.lag("c - o", 2)} as b2, {S.lag("h - l", 2)} as g2, (h + l + c) / 3 as tp, a * v as av from b),
s2 as (select *, case when ret is not null then least(ret, 0.0) end as neg, case when ret is not null then greatest(ret, 0.0) end as pos,
  greatest(h - l, abs(h - c1), abs(l - c1)) as tr, abs(r / 100) / nullif(amt / 1e6, 0) as il, {S.lag("r")} as r1, ret * ret as ret2,
  {S.running("coalesce(sign(ret), 0) * v")} as obv, {S.running("coalesce(v * ((c - l) - (h - c)) / nullif(h - l, 0), 0)")} as chk,
  abs(tp - {S.mean("tp", 14)}) as dev14, abs(tp - {S.mean("tp", 20)}) as dev20, {S.pct("c", 10)} as pc10, {S.pct("c", 120)} as pc120,
  {S.highest("h", 20)} as hh20, {S.lowest("l", 20)} as ll20 from s1)"""

for n in (3, 5, 10, 20, 30, 60, 90, 120, 250):
    add(f"mom{n}", "momentum", n + 1, lambda t, n=n: t.pct_change("a", n), S.pct("a", n))
for n in (1, 3, 5, 10, 20):
    add(f"rev{n}", "reversal", n + 1, lambda t, n=n: -t.pct_change("a", n), f"-{S.pct('a', n)}")
for n in (5, 20, 60):
    add(f"log_ret{n}", "momentum", n + 1, lambda t, n=n: t.ln(t.ratio(t.col("a"), t.lag("a", n))), f"ln(a / nullif({S.lag('a', n)}, 0))")
for s, l in ((20, 60), (60, 120)):
    add(f"relative_momentum_{s}_{l}", "momentum", l, lambda t, s=s, l=l: t.pct_change("c", s) - t.pct_change("c", l), f"{S.pct('c', s)} - {S.pct('c', l)}")
for s, l in ((5, 20), (20, 60)):
    add(f"mom_accel_{s}_{l}", "momentum", l + 1, lambda t, s=s, l=l: t.pct_change("a", s) - t.pct_change("a", l), f"{S.pct('a', s)} - {S.pct('a', l)}")
add("ts_momentum_120", "momentum", 150, lambda t: t.lag("pc120", 20), S.lag("pc120", 20))
add("momentum_reversal_ratio", "momentum", 20, lambda t: t.ratio(t.pct_change("c", 5), t.pct_change("c", 20)), S.div(S.pct("c", 5), S.pct("c", 20)), 4)
add("acceleration_20", "momentum", 15, lambda t: t.col("pc10") - t.lag("pc10"), f"pc10 - {S.lag('pc10')}")

for n in (5, 10, 20, 30, 60, 120):
    add(f"vol{n}", "volatility", n, lambda t, n=n: t.std("ret", n), S.std("ret", n))
for s, l in ((5, 20), (10, 60), (20, 60)):
    add(f"vol_std_ratio{s}_{l}", "volatility", l, lambda t, s=s, l=l: t.ratio(t.std("ret", s), t.std("ret", l)), S.div(S.std("ret", s), S.std("ret", l)))
for n in (14, 20):
    add(f"atr{n}", "volatility", n + 1, lambda t, n=n: t.ratio(t.mean("tr", n), t.col("c")), S.div(S.mean("tr", n), "c"))
for n in (20, 60):
    add(f"vol_realized_{n}", "volatility", n, lambda t, n=n: t.sqrt(t.total("ret2", n)) * YEAR, f"sqrt({S.total('ret2', n)}) * {YEAR}", 5)
    add(f"downside_vol{n}", "volatility", n, lambda t, n=n: t.std("neg", n) * YEAR, f"{S.std('neg', n)} * {YEAR}", 5)
    add(f"upside_vol{n}", "volatility", n, lambda t, n=n: t.std("pos", n) * YEAR, f"{S.std('pos', n)} * {YEAR}", 5)
add("vol_term_structure", "volatility", 20, lambda t: t.std("r", 5) - t.std("r", 20), f"{S.std('r', 5)} - {S.std('r', 20)}", 5)
add("volume_vol_20", "volatility", 20, lambda t: t.ratio(t.std("v", 20), t.mean("v", 20)), S.div(S.std("v", 20), S.mean("v", 20)))
add("price_range_20", "volatility", 20, lambda t: t.ratio(t.col("hh20") - t.col("ll20"), t.mean("c", 20)), S.div("hh20 - ll20", S.mean("c", 20)))
add("overnight_gap", "volatility", 1, lambda t: t.ratio(t.col("o") - t.col("c1"), t.col("c1")), S.div("o - c1", "c1"))
add("close_open_gap", "volatility", 1, lambda t: t.ratio(t.col("c") - t.col("o"), t.col("o")), S.div("c - o", "o"))

for s, l in ((5, 20), (10, 60), (20, 60), (5, 60), (20, 120)):
    add(f"vol_ratio_{s}_{l}", "liquidity", l, lambda t, s=s, l=l: t.ratio(t.mean("v", s), t.mean("v", l)), S.div(S.mean("v", s), S.mean("v", l)))
for n in (5, 10, 20, 60):
    add(f"vol_growth{n}", "liquidity", n + 1, lambda t, n=n: t.pct_change("v", n), S.pct("v", n))
for n in (5, 20, 60):
    add(f"amount_growth{n}", "liquidity", n + 1, lambda t, n=n: t.pct_change("av", n), S.pct("av", n))
    add(f"amihud_illiq_{n}d", "liquidity", n, lambda t, n=n: t.mean("il", n), S.mean("il", n), 4)
for n in (5, 10, 20):
    add(f"money_flow{n}", "liquidity", n, lambda t, n=n: t.ratio(t.total(t.col("tp") * t.col("v"), n), t.total("v", n)), S.div(S.total("tp * v", n), S.total("v", n)), 4)
add("trade_activity", "liquidity", 60, lambda t: t.ratio(t.mean("amt", 20), t.mean("amt", 60)), S.div(S.mean("amt", 20), S.mean("amt", 60)))
add("volume_turnover_60", "liquidity", 60, lambda t: t.ratio(t.col("v"), t.mean("v", 60)), S.div("v", S.mean("v", 60)))
add(
    "small_order_imbalance",
    "liquidity",
    20,
    lambda t: t.number(t.col("v") < t.quantile("v", 20, 0.3)) - t.number(t.col("v") > t.quantile("v", 20, 0.7)),
    f"cast(v < {S.quantile('v', 20, 0.3)} as double) - cast(v > {S.quantile('v', 20, 0.7)} as double)",
)
add("order_flow_imbalance", "liquidity", 20, lambda t: t.when(t.col("r") > 0, t.col("r"), -t.std("r", 20)), f"case when r > 0 then r else -{S.std('r', 20)} end", 5)

for s, l in ((5, 20), (10, 20), (5, 60), (20, 60)):
    add(f"ma_diff_{s}_{l}", "technical", l, lambda t, s=s, l=l: t.ratio(t.mean("a", s), t.mean("a", l)), S.div(S.mean("a", s), S.mean("a", l)))
for n in (20, 60, 120):
    add(f"price_to_ma{n}", "technical", n, lambda t, n=n: t.ratio(t.col("a"), t.mean("a", n)), S.div("a", S.mean("a", n)))
    add(f"high_low_pos{n}", "technical", n, lambda t, n=n: t.ratio(t.col("a") - t.lowest("a", n), t.highest("a", n) - t.lowest("a", n)), S.div(f"a - {S.lowest('a', n)}", f"{S.highest('a', n)} - {S.lowest('a', n)}"))
for n in (14, 28):
    add(f"williams_r{n}", "technical", n, lambda t, n=n: t.ratio(-100 * (t.highest("h", n) - t.col("a")), t.highest("h", n) - t.lowest("l", n)), S.div(f"-100 * ({S.highest('h', n)} - a)", f"{S.highest('h', n)} - {S.lowest('l', n)}"))
for n in (14, 20):
    add(f"cci{n}", "technical", n, lambda t, n=n: t.ratio(t.col("tp") - t.mean("tp", n), 0.015 * t.mean(f"dev{n}", n)), S.div(f"tp - {S.mean('tp', n)}", f"0.015 * {S.mean(f'dev{n}', n)}"), 4)
for n in (20, 60, 120, 250):
    add(f"close_to_high{n}", "technical", n, lambda t, n=n: t.ratio(t.col("a"), t.highest("a", n)), S.div("a", S.highest("a", n)))
    add(f"close_to_low{n}", "technical", n, lambda t, n=n: t.ratio(t.col("a"), t.lowest("a", n)), S.div("a", S.lowest("a", n)))
for n in (20, 60):
    add(f"bb_position{n}", "technical", n, lambda t, n=n: t.ratio(t.col("a") - (t.mean("a", n) - 2 * t.std("a", n)), 4 * t.std("a", n)), S.div(f"a - ({S.mean('a', n)} - 2 * {S.std('a', n)})", f"4 * {S.std('a', n)}"))
    add(f"trend_strength{n}", "technical", n, lambda t, n=n: t.ratio(t.ratio(t.mean("a", n), t.col("a")) - 1, t.ratio(t.std("a", n), t.mean("a", n))), S.div(f"{S.div(S.mean('a', n), 'a')} - 1", S.div(S.std("a", n), S.mean("a", n))))
    add(f"pv_corr{n}", "technical", n, lambda t, n=n: t.corr("a", "v", n), f"case when count(a) over {S.over(n)} = {n} then corr(a, v) over {S.over(n)} end")
add("ma_cross_strength", "technical", 60, lambda t: t.ratio(t.mean("a", 5), t.mean("a", 20)) - t.ratio(t.mean("a", 20), t.mean("a", 60)), f"{S.div(S.mean('a', 5), S.mean('a', 20))} - {S.div(S.mean('a', 20), S.mean('a', 60))}")
add("obv", "technical", 1, lambda t: t.col("obv"), "obv")
add("volume_chaikin10", "technical", 10, lambda t: t.mean("chk", 10), S.mean("chk", 10), 4)

for n in (20, 60):
    add(f"return_skew{n}", "distribution", n, lambda t, n=n: t.skew("ret", n), S.full(n, "ret", "skewness(ret)"), 4)
    add(f"return_kurt{n}", "distribution", n, lambda t, n=n: t.kurt("ret", n), S.full(n, "ret", "kurtosis(ret)"), 4)
add("tail_ratio_20", "distribution", 20, lambda t: t.ratio(t.quantile("r", 20, 0.95), t.abs(t.quantile("r", 20, 0.05))), S.div(S.quantile("r", 20, 0.95), f"abs({S.quantile('r', 20, 0.05)})"), 5)
add("head_shoulders", "distribution", 20, lambda t: t.ratio(t.col("c") - t.mean("c", 20), t.mean("c", 20)), S.div(f"c - {S.mean('c', 20)}", S.mean("c", 20)))
add("return_distribution", "distribution", 60, lambda t: t.ratio(t.col("r"), t.std("r", 60)), S.div("r", S.std("r", 60)))
add("volume_skew_20", "distribution", 20, lambda t: t.skew("v", 20), S.full(20, "v", "skewness(v)"), 4)

BODY, SPAN = "abs(c - o)", "(h - l)"
UP, LOW = "(h - greatest(o, c))", "(least(o, c) - l)"


def pattern(name: str, lookback: int, condition: str) -> None:
    """A yes / no pattern as 1.0 / 0.0; an unknown comparison is no. The condition reads the same in both dialects."""
    add(name, "pattern", lookback, lambda t: F.coalesce(F.expr(condition).cast("double"), F.lit(0.0)), f"coalesce(cast(({condition}) as double), 0.0)")


pattern("candle_hammer", 1, f"{LOW} > 2 * {BODY} and {UP} < 0.3 * {BODY}")
pattern("candle_shooting_star", 1, f"{UP} > 2 * {BODY} and {LOW} < 0.3 * {BODY}")
pattern("candle_engulfing", 2, f"b1 > 0 and c - o < 0 and {BODY} > abs(b1)")
pattern("candle_doji_star", 1, f"{BODY} < 0.1 * {SPAN}")
pattern("candle_morning_star", 3, f"b2 < 0 and abs(b1) < g2 and c - o > 0")
pattern("gap_up", 1, "(o - c1) / c1 > 0.02")
pattern("gap_down", 1, "(c1 - o) / c1 > 0.02")
pattern("inside_bar", 2, "h < h1 and l > l1")
pattern("outside_bar", 2, "h > h1 and l < l1")
pattern("tweezer_top", 2, "abs(h - h1) < 0.001 * c and r1 < -1")
pattern("tweezer_bottom", 2, "abs(l - l1) < 0.001 * c and r1 > 1")
add("breakout_20d", "pattern", 21, lambda t: F.coalesce((K("c") > W.lag("hh20")).cast("double"), F.lit(0.0)), f"coalesce(cast(c > {S.lag('hh20')} as double), 0.0)")
add("breakdown_20d", "pattern", 21, lambda t: F.coalesce((K("c") < W.lag("ll20")).cast("double"), F.lit(0.0)), f"coalesce(cast(c < {S.lag('ll20')} as double), 0.0)")
for k in (2, 3, 5):
    add(f"volume_spike_{k}x", "pattern", 20, lambda t, k=k: F.coalesce((K("v") > k * W.mean("v", 20)).cast("double"), F.lit(0.0)), f"coalesce(cast(v > {k} * {S.mean('v', 20)} as double), 0.0)")
add("volume_climax", "pattern", 60, lambda t: W.ratio(K("v"), W.mean("v", 60)), S.div("v", S.mean("v", 60)))
add("intraday_range", "pattern", 1, lambda t: W.ratio(K("h") - K("l"), K("o")), S.div("h - l", "o"))
add("upper_shadow_ratio", "pattern", 1, lambda t: W.ratio(K("h") - F.greatest(K("o"), K("c")), K("h") - K("l")), S.div("h - greatest(o, c)", "h - l"))
add("lower_shadow_ratio", "pattern", 1, lambda t: W.ratio(F.least(K("o"), K("c")) - K("l"), K("h") - K("l")), S.div("least(o, c) - l", "h - l"))
add("body_ratio", "pattern", 1, lambda t: W.ratio(F.abs(K("c") - K("o")), K("h") - K("l")), S.div("abs(c - o)", "h - l"))
for n in (5, 10):
    add(f"consecutive_up_{n}", "pattern", n, lambda t, n=n: W.total(F.coalesce((K("r") > 0).cast("double"), F.lit(0.0)), n), S.total("coalesce(cast(r > 0 as double), 0.0)", n))
    add(f"consecutive_down_{n}", "pattern", n, lambda t, n=n: W.total(F.coalesce((K("r") < 0).cast("double"), F.lit(0.0)), n), S.total("coalesce(cast(r < 0 as double), 0.0)", n))


#: Families of lags and comparisons alone, which Spark's own windows do in one pass.
LIGHT = ("momentum", "reversal", "pattern")
PRICES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "amt": "amount"}


def staged_rows(t: R.Rows) -> None:
    """The stages of `staged` over sorted rows."""
    o, h, l, c, v = (t.col(x) for x in "ohlcv")
    t.add(a=c, ret=t.pct_change("c", 1), r=100 * t.pct_change("c", 1), dv=t.pct_change("v", 1), c1=t.lag("c"), tp=(h + l + c) / 3, av=c * v)
    ret, tp, move = t.col("ret"), t.col("tp"), h - l
    flow = t.ratio(v * ((c - l) - (h - c)), move)
    t.add(
        neg=t.only(t.least(ret, 0.0), ret), pos=t.only(t.greatest(ret, 0.0), ret), tr=t.greatest(move, t.abs(h - t.col("c1")), t.abs(l - t.col("c1"))),
        il=t.ratio(t.abs(t.col("r") / 100), t.col("amt") / 1e6), ret2=ret * ret, obv=t.running(t.or_else(t.sign(ret), 0.0) * v), chk=t.running(t.or_else(flow, 0.0)),
        dev14=t.abs(tp - t.mean("tp", 14)), dev20=t.abs(tp - t.mean("tp", 20)), pc10=t.pct_change("c", 10), pc120=t.pct_change("c", 120), hh20=t.highest("h", 20), ll20=t.lowest("l", 20),
    )


def compute(bars: DataFrame, names: list[str]) -> DataFrame:
    """symbol, trade_date and the factors, unrounded: by Spark's windows where all are light, else over sorted rows."""
    found = [REGISTRY[n] for n in names]
    if all(f.category in LIGHT for f in found):
        return staged(bars).select("symbol", "trade_date", *[f.build(Native()).alias(f.name) for f in found])
    if any(f.category == "pattern" for f in found):
        heavy = [f.name for f in found if f.category not in LIGHT]
        light = compute(bars, [n for n in names if n not in heavy])
        return light.join(compute(bars, heavy), ["symbol", "trade_date"]).select("symbol", "trade_date", *names)

    def body(t: R.Rows) -> dict[str, R.Vec]:
        staged_rows(t)
        return {f.name: f.build(t) for f in found}

    rows = bars.select("symbol", "trade_date", *[F.col(y).alias(x) for x, y in PRICES.items()])
    return R.over_rows(rows, list(PRICES), names, body, 2 * max(f.lookback for f in found) + 50)


def family(bars: DataFrame, category: str) -> DataFrame:
    found = REGISTRY.of(category)
    return compute(bars, [f.name for f in found]).select("symbol", "trade_date", *[F.round(F.col(f.name) + NUDGE, f.digits).alias(f.name) for f in found])


def family_sql(category: str, grain: str = "daily") -> str:
    cols = ", ".join(f"round({f.sql} + 1e-9, {f.digits}) as {f.name}" for f in REGISTRY.of(category))
    return f"with {S.bars(grain)}, {STAGED_SQL.format(bars=grain)} select symbol, trade_date, {cols} from s2"


def long_form(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["symbol", "trade_date"], [x for x in wide.columns if x not in ("symbol", "trade_date")], "feature_name", "feature_value")
