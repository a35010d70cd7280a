"""Queries over formula alphas and further factors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import alphas as A
from ..sources import market
from . import sql as S
from .panel import PANEL, r, rounded
from .registry import query


def family(name: str, rows: str, stages, keep: list[str], digits: int = 5) -> None:
    duck_stages = stages(A.Duck())
    sql = f"with {S.WEEKLY}, {A.staged_sql('weekly', duck_stages, 'al')} select symbol, trade_date, {', '.join(f'{r(k, digits)} as {k}' for k in keep)} from al"
    query(name, sql)(lambda spark, d: rounded(A.by_rows(market.weekly_bar(spark, d), rows, keep), digits))


_PRICE = A.names_of(A.price_alphas(A.Spark())[-1])
_RANKED = A.names_of(A.ranked_alphas(A.Spark())[-1])
family("alphas_price_a", "price", lambda t: [*A.base(t), *A.price_alphas(t)], _PRICE[:24], 4)
family("alphas_price_b", "price", lambda t: [*A.base(t), *A.price_alphas(t)], _PRICE[24:], 4)
family("alphas_ranked", "ranked", lambda t: [*A.base(t), A.ranks(t), *A.ranked_alphas(t)], _RANKED, 4)
family("factors_further", "further", A.further, A.names_of(A.further(A.Spark())[-1]), 4)


_LISTS = "hl as (select symbol, list(trade_date order by trade_date) as ts, {lists} from {source} group by symbol), ex as (select *, unnest(range(1, len(ts) + 1)) as i from hl)"


def _ewm(xs: str, span: float) -> str:
    return f"list_reduce({xs}, lambda y, x: y + (x - y) * {2.0 / (span + 1.0)!r})"


@query(
    "macd",
    f"""with {PANEL}, {_LISTS.format(lists="list(close order by trade_date) as xs", source="p")},
e as (select symbol, ts[i] as trade_date, i, {_ewm("xs[1:i]", 12)} - {_ewm("xs[1:i]", 26)} as diff from ex),
dl as (select symbol, list(trade_date order by trade_date) as ts, list(diff order by trade_date) as ds from e group by symbol), dx as (select *, unnest(range(1, len(ts) + 1)) as i from dl),
m as (select symbol, ts[i] as trade_date, ds[i] as diff, {_ewm("ds[1:i]", 9)} as dea from dx)
select symbol, trade_date, {r("diff", 4)} as macd_diff, {r("dea", 4)} as macd_dea, {r("2 * (diff - dea)", 4)} as macd_hist, {r("diff - dea", 4)} as macd_signal from m""",
)
def macd(spark, d):
    e = W.ewm(market.weekly_bar(spark, d), "close", {"fast": 12, "slow": 26}).select("symbol", "trade_date", (F.col("fast") - F.col("slow")).alias("diff"))
    m = W.ewm(e, "diff", {"dea": 9}, carried=("diff",))
    hist = F.col("diff") - F.col("dea")
    return rounded(m.select("symbol", "trade_date", F.col("diff").alias("macd_diff"), F.col("dea").alias("macd_dea"), (2 * hist).alias("macd_hist"), hist.alias("macd_signal")), 4)


_RSI = (6, 12, 14, 24)


@query(
    "rsi_family",
    f"""with {PANEL}, c as (select symbol, trade_date, close - {S.lag("close")} as ch from p), k as (select *, greatest(ch, 0) as u, greatest(-ch, 0) as w from c where ch is not null),
{_LISTS.format(lists="list(u order by trade_date) as us, list(w order by trade_date) as ws", source="k")},
e as (select symbol, ts[i] as trade_date, {", ".join(f"{_ewm('us[1:i]', n)} as u{n}, {_ewm('ws[1:i]', n)} as w{n}" for n in _RSI)} from ex)
select symbol, trade_date, {", ".join(f"{r(f'100 * u{n} / nullif(u{n} + w{n}, 0)', 4)} as rsi{n}" for n in _RSI)} from e""",
)
def rsi_family(spark, d):
    c = market.weekly_bar(spark, d).withColumn("ch", F.col("close") - W.lag("close")).where("ch is not null")
    up = W.ewm(c.withColumn("x", F.greatest("ch", F.lit(0.0))), "x", {f"u{n}": n for n in _RSI}, carried=("ch",))
    both = W.ewm(up.withColumn("x", F.greatest(-F.col("ch"), F.lit(0.0))), "x", {f"w{n}": n for n in _RSI}, carried=tuple(f"u{n}" for n in _RSI))
    return rounded(both.select("symbol", "trade_date", *[(100 * W.ratio(F.col(f"u{n}"), F.col(f"u{n}") + F.col(f"w{n}"))).alias(f"rsi{n}") for n in _RSI]), 4)


def _rsv(n: int) -> str:
    lo, hi = f"min(low) over {S.over(n)}", f"max(high) over {S.over(n)}"
    return f"case when count(high) over {S.over(n)} = {n} then 100 * (close - {lo}) / nullif({hi} - {lo}, 0) end"


@query(
    "kdj_family",
    f"""with {PANEL}, s as (select symbol, trade_date, {_rsv(9)} as rsv from p), k as (select * from s where rsv is not null),
{_LISTS.format(lists="list(rsv order by trade_date) as xs", source="k")}, e as (select symbol, ts[i] as trade_date, {_ewm("xs[1:i]", 3)} as k from ex),
kl as (select symbol, list(trade_date order by trade_date) as ts, list(k order by trade_date) as ks from e group by symbol), kx as (select *, unnest(range(1, len(ts) + 1)) as i from kl),
m as (select symbol, ts[i] as trade_date, ks[i] as k, {_ewm("ks[1:i]", 3)} as d from kx) select symbol, trade_date, {r("k", 4)} as kdj_k9, {r("d", 4)} as kdj_d9, {r("3 * k - 2 * d", 4)} as kdj_j from m""",
)
def kdj_family(spark, d):
    b = market.weekly_bar(spark, d)
    rsv = 100 * W.ratio(F.col("close") - W.lowest("low", 9), W.highest("high", 9) - W.lowest("low", 9))
    k = W.ewm(b.withColumn("rsv", rsv), "rsv", {"k": 3})
    m = W.ewm(k, "k", {"d": 3}, carried=("k",))
    return rounded(m.select("symbol", "trade_date", F.col("k").alias("kdj_k9"), F.col("d").alias("kdj_d9"), (3 * F.col("k") - 2 * F.col("d")).alias("kdj_j")), 4)


@query(
    "ewm_std",
    f"""with {PANEL}, k as (select symbol, trade_date, ret, row_number() over (partition by symbol order by trade_date) as i from p where ret is not null),
j as (select a.symbol, a.trade_date, pow(1 - 2.0 / 21, a.i - b.i) as w, b.ret as x from k a join k b on a.symbol = b.symbol and b.i <= a.i),
s as (select symbol, trade_date, sum(w) as sw, sum(w * w) as sww, sum(w * x) / sum(w) as m, count(*) as n from j group by all),
v as (select s.symbol, s.trade_date, any_value(n) as n, sum(w * (x - m) * (x - m)) / any_value(sw) * (any_value(sw) * any_value(sw)) / nullif(any_value(sw) * any_value(sw) - any_value(sww), 0) as var from s join j using (symbol, trade_date) group by all)
select symbol, trade_date, {r("case when n > 1 then sqrt(var) end", 5)} as ewm_std20 from v""",
)
def ewm_std(spark, d):
    """Bias-corrected, with weights that decay by span 20 from the newest row."""
    b = market.weekly_bar(spark, d).withColumn("ret", W.pct_change("close", 1))
    return rounded(W.ewm(b, "ret", {"ewm_std20": 20}, std=True).select("symbol", "trade_date", "ewm_std20"), 5)


@query(
    "filled_gaps",
    f"""with {PANEL}, g as (select symbol, trade_date, case when volume > 100 then close end as x from p)
select symbol, trade_date, {r("last_value(x ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row)")} as forward,
  {r("coalesce(last_value(x ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row), first_value(x ignore nulls) over (partition by symbol order by trade_date rows between current row and unbounded following))")} as both_ways from g""",
)
def filled_gaps(spark, d):
    g = market.weekly_bar(spark, d).select("symbol", "trade_date", F.when(F.col("volume") > 100, F.col("close")).alias("x"))
    return rounded(g.select("symbol", "trade_date", W.filled("x").alias("forward"), F.coalesce(W.filled("x"), W.filled_back("x")).alias("both_ways")))
