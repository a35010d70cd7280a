"""Queries over events, risk, gates and contracts, and formula alphas, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rolling as V
from ..functions import windows as W
from ..operators import panel as P
from ..operators import research as R
from ..operators import risk as K
from ..sources import catalog, market
from ..streaming import bars as T
from . import sql as S
from .panel import IC, NAVS, PANEL, RANKED, UNI, navs, r, rounded, scored
from .registry import query


@query(
    "event_bars",
    f"""with k as (select *, row_number() over (partition by event_type, date_trunc('day', ts) order by ts, event_id) as i, row_number() over (partition by event_type, date_trunc('day', ts) order by ts desc, event_id desc) as j from events)
select cast(date_trunc('day', ts) as timestamp) as start_ts, event_type, {r("max(case when i = 1 then value end)")} as open, {r("max(value)")} as high, {r("min(value)")} as low, {r("max(case when j = 1 then value end)")} as close, count(*) as n_events from k group by 1, 2""",
)
def event_bars(spark, d):
    return rounded(T.event_bars(market.table(spark, d, "events")))


@query(
    "bar_contract",
    f"""with {S.DAILY} select count(*) as n_rows, min(trade_date) as first_date, max(trade_date) as last_date, count(*) filter (symbol is null) as null_symbol, count(*) filter (close is null) as null_close from daily""",
)
def bar_contract(spark, d):
    return catalog.contract(market.daily_bar(spark, d).select("symbol", "trade_date", "close"), "trade_date").drop("null_trade_date")


@query(
    "exposure_report",
    f"""with {RANKED}, t as (select trade_date, symbol, volume / sum(volume) over (partition by trade_date) as w from sr where signal_rank <= 20),
i as (select trade_date, n_name, sum(w) as w, max(w) as top, count(*) as n from t join supplier on s_suppkey = symbol join nation on s_nationkey = n_nationkey group by all),
g as (select trade_date, sum(n)::bigint as n_names, sum(w) as gross, max(top) as max_single, max(w) as max_industry from i group by trade_date)
select trade_date, n_names, {r("gross")} as gross, {r("max_single")} as max_single, {r("max_industry")} as max_industry,
  case (max_single > 0.1)::int + (max_industry > 0.3)::int + (gross > 1.0 + 1e-9)::int when 0 then 'ok' when 1 then 'warn' else 'breach' end as level from g""",
)
def exposure_report(spark, d):
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20").where("signal_rank <= 20")
    w = ranked.select("trade_date", "symbol", (F.col("volume") / F.sum("volume").over(W.day())).alias("weight"))
    return rounded(K.exposure_report(w, market.security_master(spark, d).select("symbol", "industry")))


@query(
    "cost_scenarios",
    f"""with {NAVS}, sr as (select *, row_number() over (partition by trade_date order by mom20 desc, symbol) as signal_rank from p where mom20 is not null),
hd as (select trade_date, list(distinct symbol) as held from sr where signal_rank <= 15 group by trade_date), hb as (select *, lag(held) over (order by trade_date) as before from hd),
tv as (select trade_date, case when before is null then 0.0 else 1 - len(list_intersect(held, before)) / len(held)::double end as turnover from hb), c as (select unnest([0.5, 1.0, 2.0, 4.0]) as m)
select m::double as multiplier, {r("sum(daily_return - turnover * m * 0.001)", 5)} as net_return, sum(daily_return - turnover * m * 0.001) > 0 as survives from tv join ur using (trade_date), c group by m""",
)
def cost_scenarios(spark, d):
    tv = P.selection_turnover(P.signal_ranks(P.weekly_panel(spark, d), "mom20"), 15).select("trade_date", "turnover")
    return rounded(K.cost_scenarios(tv, navs(spark, d).select("trade_date", "daily_return"), [0.5, 1.0, 2.0, 4.0]), net_return=5)


_TAIL = NAVS.split(UNI + ",")[1]
#: One row each: gi (ic, sd, positive), gb (monotonicity), gt (turnover), gd (drawdown) of the processed factor.
JUDGED = f"""{IC}, {UNI}, {_TAIL},
gi as (select avg(rank_ic) as ic, stddev_samp(rank_ic) as sd, avg((rank_ic > 1e-12)::int::double) as positive from ic),
g1 as (select trade_date, fwd, ceil(row_number() over (partition by trade_date order by mom20_z, symbol) * 5.0 / count(*) over (partition by trade_date)) as b from z where fwd is not null),
g2 as (select trade_date, cast(greatest(1, least(5, b)) as int) as bucket, avg(fwd) as m from g1 group by all), g3 as (select bucket, avg(m) as y from g2 group by bucket), gb as (select corr(bucket, y) as monotonicity from g3),
g4 as (select trade_date, symbol, row_number() over (partition by trade_date order by mom20_z desc, symbol) as i from z), g5 as (select trade_date, list(distinct symbol) as held from g4 where i <= 15 group by trade_date), g6 as (select *, lag(held) over (order by trade_date) as before from g5),
gt as (select avg(case when before is null then 0.0 else 1 - len(list_intersect(held, before)) / len(held)::double end) as turnover from g6), gd as (select -min(drawdown) as max_drawdown from dd)"""
GATE_SQL = f"""with {JUDGED}, v as (select 'ic' as check_name, ic as value, 0.02 as threshold, 1 as sign from gi union all select 'ir', ic / nullif(sd, 0), 0.15, 1 from gi union all select 'monotonicity', monotonicity, 0.6, 1 from gb
union all select 'max_drawdown', max_drawdown, 0.3, -1 from gd union all select 'turnover', turnover, 0.5, -1 from gt)
select check_name, {r("value")} as value, {r("threshold::double")} as threshold, coalesce(sign * value >= sign * threshold, false) as passed, value is null as skipped from v"""


@query(
    "factor_health",
    f"""with {JUDGED}, v as (select ic as mean_ic, ic / nullif(sd, 0) as ir, positive, monotonicity, turnover from gi, gb, gt),
c as (select *, coalesce(mean_ic >= 0.02, false)::int + coalesce(ir >= 0.15, false)::int + coalesce(positive >= 0.5, false)::int + coalesce(monotonicity >= 0.6, false)::int + coalesce(turnover <= 0.5, false)::int as n_passed from v)
select {", ".join(f"{r(x)} as {x}" for x in ("mean_ic", "ir", "positive", "monotonicity", "turnover"))}, n_passed, case when n_passed = 5 then 'PASS' when n_passed * 3 >= 10 then 'CONDITIONAL' else 'FAIL' end as verdict from c""",
)
def factor_health(spark, d):
    p = scored(spark, d)
    return rounded(R.health(P.rank_ic(p, "mom20", "fwd"), P.quantile_returns(p, "mom20", "fwd"), P.selection_turnover(P.signal_ranks(p, "mom20"), 15)))


@query("strategy_gate", GATE_SQL)
def strategy_gate(spark, d):
    p = scored(spark, d)
    return rounded(K.gate(P.rank_ic(p, "mom20", "fwd"), P.quantile_returns(p, "mom20", "fwd"), navs(spark, d), P.selection_turnover(P.signal_ranks(p, "mom20"), 15)))


def pr(x: str) -> str:
    return f"({S.average_rank(x)} / count(*) over (partition by trade_date))"


ALPHAS = f"""{PANEL},
a1 as (select *, close - open as body, high - low as span, {S.pct("volume", 5)} as dv5, {S.lag("close", 5)} as c5,
  case when count(close) over {S.over(10)} = 10 then corr(close, volume) over {S.over(10)} end as pv10,
  case when count(open) over {S.over(10)} = 10 then corr(open, volume) over {S.over(10)} end as ov10 from p),
a2 as (select * from a1 where dv5 is not null and ret is not null and pv10 is not null and not isnan(pv10) and ov10 is not null and not isnan(ov10))"""


@query(
    "formula_alphas",
    f"""with {ALPHAS} select trade_date, symbol, {r("-" + pr("ov10"))} as alpha_open_volume, {r("-" + pr("pv10") + " * " + pr("ret"))} as alpha_price_volume,
  {r("body / (span + 0.001)")} as alpha_body, {r("sign(dv5) * -(close - c5)", 5)} as alpha_flow, {r(pr("dv5") + " - " + pr("ret"))} as alpha_volume_less_return from a2""",
)
def formula_alphas(spark, d):
    return rounded(formula_alphas_of(market.weekly_bar(spark, d)), alpha_flow=5)


def formula_alphas_of(bars):
    """Windows by name in one pass over sorted rows, then the ranks of each date's names in another."""
    ranked = ["ov10", "pv10", "ret", "dv5"]

    def by_name(t: V.Rows) -> dict[str, V.Vec]:
        made = {"ov10": t.corr("open", "volume", 10), "pv10": t.corr("close", "volume", 10), "ret": t.pct_change("close", 1), "dv5": t.pct_change("volume", 5)}
        body = (t.col("close") - t.col("open")) / (t.col("high") - t.col("low") + 0.001)
        return made | {"alpha_body": body, "alpha_flow": t.sign(made["dv5"]) * -t.diff("close", 5)}

    def by_date(t: V.Rows) -> dict[str, V.Vec]:
        rank = {c: t.whole_rank(c) for c in ranked}
        made = {"alpha_open_volume": -rank["ov10"], "alpha_price_volume": -rank["pv10"] * rank["ret"], "alpha_volume_less_return": rank["dv5"] - rank["ret"]}
        return made | {c: t.col(c) for c in ("alpha_body", "alpha_flow")}

    x = V.over_rows(bars, ["open", "high", "low", "close", "volume"], [*ranked, "alpha_body", "alpha_flow"], by_name, 10)
    x = x.where("dv5 is not null and ret is not null and pv10 is not null and not isnan(pv10) and ov10 is not null and not isnan(ov10)")
    names = ["alpha_open_volume", "alpha_price_volume", "alpha_body", "alpha_flow", "alpha_volume_less_return"]
    return V.over_rows(x, [*ranked, "alpha_body", "alpha_flow"], names, by_date, None, "trade_date", "symbol")


_HI, _LO = f"max(high) over {S.over(9)}", f"min(low) over {S.over(9)}"


@query(
    "kdj",
    f"""with {PANEL}, s as (select symbol, trade_date, case when count(high) over {S.over(9)} = 9 then 100 * (close - {_LO}) / nullif({_HI} - {_LO}, 0) end as rsv from p),
hl as (select symbol, list(trade_date order by trade_date) as ts, list(rsv order by trade_date) as xs from s where rsv is not null group by symbol),
e as (select symbol, ts[i] as trade_date, list_reduce(xs[1:i], lambda y, x: y + (x - y) * 0.5) as k from (select *, unnest(range(1, len(ts) + 1)) as i from hl))
select symbol, trade_date, {r("k", 5)} as kdj_k from e""",
)
def kdj(spark, d):
    b = market.weekly_bar(spark, d)
    rsv = 100 * W.ratio(F.col("close") - W.lowest("low", 9), W.highest("high", 9) - W.lowest("low", 9))
    e = W.ewm(b.withColumn("rsv", rsv), "rsv", {"kdj_k": 3})
    return rounded(e, kdj_k=5)


@query(
    "rsi",
    f"""with {PANEL}, c as (select symbol, trade_date, close - {S.lag("close")} as ch from p),
hl as (select symbol, list(trade_date order by trade_date) as ts, list(greatest(ch, 0) order by trade_date) as us, list(greatest(-ch, 0) order by trade_date) as ds from c where ch is not null group by symbol),
e as (select symbol, ts[i] as trade_date, list_reduce(us[1:i], lambda y, x: y + (x - y) * (2.0 / 15)) as u, list_reduce(ds[1:i], lambda y, x: y + (x - y) * (2.0 / 15)) as w from (select *, unnest(range(1, len(ts) + 1)) as i from hl))
select symbol, trade_date, {r("100 * u / nullif(u + w, 0)", 5)} as rsi14 from e""",
)
def rsi(spark, d):
    c = market.weekly_bar(spark, d).withColumn("ch", F.col("close") - W.lag("close")).where("ch is not null")
    up = W.ewm(c.withColumn("x", F.greatest("ch", F.lit(0.0))), "x", {"u": 14})
    down = W.ewm(c.withColumn("x", F.greatest(-F.col("ch"), F.lit(0.0))), "x", {"w": 14})
    both = up.join(down, ["symbol", "trade_date"])
    return rounded(both.select("symbol", "trade_date", (100 * W.ratio(F.col("u"), F.col("u") + F.col("w"))).alias("rsi14")), rsi14=5)


@query(
    "walk_forward_windows",
    f"""with {IC}, d as (select trade_date, rank_ic, (row_number() over (order by trade_date) - 1) as i from ic), w as (select unnest(range(0, (select max(i) from d) // 20 + 1)) as fold)
select w.fold::int as fold, count(*) filter (i >= fold * 20 and i < fold * 20 + 100) as n_train, {r("avg(rank_ic) filter (i >= fold * 20 and i < fold * 20 + 100)")} as train_ic,
  count(*) filter (i >= fold * 20 + 121 and i < fold * 20 + 141) as n_test, {r("avg(rank_ic) filter (i >= fold * 20 + 121 and i < fold * 20 + 141)")} as test_ic from d, w group by w.fold having count(*) filter (i >= fold * 20 + 121 and i < fold * 20 + 141) > 0""",
)
def walk_forward_windows(spark, d):
    """Rolling folds of 100 training dates and 20 test dates, an embargo of 21 dates between."""
    from pyspark.sql import Window

    ic = P.rank_ic(scored(spark, d), "mom20", "fwd").withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - 140) / 20.0))  # the folds that may hold a date
    each = ic.withColumn("fold", F.explode(F.sequence(first.cast("int"), F.floor(F.col("i") / 20).cast("int"))))
    at = F.col("i") - 20 * F.col("fold")
    train, test = (at >= 0) & (at < 100), (at >= 121) & (at < 141)
    both = each.groupBy("fold")
    out = both.agg(F.count(F.when(train, 1)).alias("n_train"), F.avg(F.when(train, F.col("rank_ic"))).alias("train_ic"), F.count(F.when(test, 1)).alias("n_test"), F.avg(F.when(test, F.col("rank_ic"))).alias("test_ic"))
    return rounded(out.where("n_test > 0"))


@query(
    "execution_plan",
    f"""with {RANKED}, m as (select max(trade_date) as t from sr), q as (select symbol, close, signal_rank from sr, m where trade_date = t and signal_rank <= 20)
select symbol, case when signal_rank % 3 = 0 then 'SELL' else 'BUY' end as side, cast(floor(1000000.0 / 20 / close / 10) * 10 as bigint) as shares,
  {r("close * (case when signal_rank % 3 = 0 then 0.999 else 1.001 end)", 4)} as limit_price from q""",
)
def execution_plan(spark, d):
    """Lots of 10 for equal parts of an account, at a price with slippage on the side of the order."""
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20")
    last = ranked.agg(F.max("trade_date").alias("trade_date"))
    q = ranked.where("signal_rank <= 20").join(F.broadcast(last), "trade_date")
    sell = F.col("signal_rank") % 3 == 0
    return q.select(
        "symbol",
        F.when(sell, "SELL").otherwise("BUY").alias("side"),
        (F.floor(F.lit(1000000.0) / 20 / F.col("close") / 10) * 10).cast("bigint").alias("shares"),
        F.round(F.col("close") * F.when(sell, 0.999).otherwise(1.001) + 1e-9, 4).alias("limit_price"),
    )
