"""Queries over the weekly panel, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cross as X
from ..functions import windows as W
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators import research as R
from ..sources import market
from . import sql as S
from .registry import query

N = 1e-9


def rounded(df, digits: int = 6, **named):
    """Doubles rounded (see factors.NUDGE)."""
    return df.select(*[F.round(F.col(c) + N, named.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"round({x} + 1e-9, {digits})"


FWD = f"({S.lead('close', 20)} / nullif({S.lead('close', 1)}, 0) - 1)"
PANEL = f"""{S.WEEKLY},
pr as (select *, {S.pct("close", 1)} as ret from weekly),
p as (select *, {S.pct("close", 20)} as mom20, -{S.pct("close", 5)} as rev5, {S.std("ret", 20)} as vol20,
  {S.div(S.mean("volume", 5), S.mean("volume", 20))} as liq5_20, {FWD} as fwd from pr)"""
Z = f"""{PANEL}, {S.processed("z", "mom20", "p")}"""
IC = f"""{Z},
k as (select trade_date, symbol, mom20_z as x, fwd as y from z where fwd is not null),
ra as (select *, {S.average_rank("x")} as rx, {S.average_rank("y")} as ry from k),
ic as (select trade_date, count(*) as n, case when count(distinct x) < 2 or count(distinct y) < 2 or isnan(corr(rx, ry)) or corr(rx, ry) is null then 0.0 else corr(rx, ry) end as rank_ic
  from ra group by trade_date having count(*) >= 2)"""
CAL = "cal as (select trade_date, row_number() over (order by trade_date) - 1 as day_no from (select distinct trade_date from {bars}))"
UNIVERSE = """{cal},
tr as (select symbol, day_no // 20 + 1 as period, sum(volume) as traded from {bars} join cal using (trade_date) group by all),
rk as (select *, row_number() over (partition by period order by traded desc, symbol) as r, count(*) over (partition by period) as n from tr),
ch as (select symbol, period, 1.0 / count(*) over (partition by period) as universe_weight from rk where r <= ceil(n * 0.6)),
uni as (select c.trade_date, symbol, universe_weight, ch.period as rebalance_id from cal c join ch on c.day_no // 20 = ch.period)"""
UNI = UNIVERSE.format(cal=CAL.format(bars="weekly"), bars="weekly")
TRADE = f"""tb as (select *, 100 * {S.pct("close", 1)} as pct_chg, min(trade_date) over (partition by symbol) as listed from weekly),
td as (select trade_date, symbol, volume > 0 as is_tradable, not coalesce(pct_chg >= 30, false) as can_buy, not coalesce(pct_chg <= -30, false) as can_sell,
  date_diff('day', listed, trade_date) < 60 as is_new_listing, symbol % 17 = 0 as is_st from tb)"""


def scored(spark, d):
    return X.processed(P.weekly_panel(spark, d), "mom20")


@query("daily_bar", f"with {S.DAILY} select symbol, trade_date, {r('open')} as open, {r('high')} as high, {r('low')} as low, {r('close')} as close, volume, amount from daily")
def daily_bar(spark, d):
    return rounded(market.daily_bar(spark, d))


@query("weekly_bar", f"with {S.WEEKLY} select symbol, trade_date, {r('open')} as open, {r('high')} as high, {r('low')} as low, {r('close')} as close, volume, amount from weekly")
def weekly_bar(spark, d):
    return rounded(market.weekly_bar(spark, d))


@query("trade_calendar", f"with {S.DAILY}, {CAL.format(bars='daily')} select trade_date, day_no, true as is_trading_day from cal")
def trade_calendar(spark, d):
    return market.trade_calendar(market.daily_bar(spark, d))


@query(
    "security_master",
    f"""with {S.DAILY} select s_suppkey as symbol, s_name as security_name, r_name as market, n_name as industry, listed_date, last_date
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
left join (select symbol, min(trade_date) as listed_date, max(trade_date) as last_date from daily group by symbol) f on f.symbol = s_suppkey""",
)
def security_master(spark, d):
    return market.security_master(spark, d)


@query("universe_membership", f"with {S.WEEKLY}, {UNI} select trade_date, symbol, {r('universe_weight')} as universe_weight, rebalance_id from uni")
def universe_membership(spark, d):
    return rounded(market.universe_membership(market.weekly_bar(spark, d)))


@query("tradability", f"with {S.WEEKLY}, {TRADE} select * from td")
def tradability(spark, d):
    return market.tradability(market.weekly_bar(spark, d))


@query(
    "corporate_actions",
    """select l_suppkey as symbol, cast(l_shipdate as date) as event_date, 'cash_dividend' as event_type, round(sum(0.01 * l_extendedprice / l_quantity) + 1e-9, 4) as event_value
from lineitem where l_discount >= 0.09 group by all""",
)
def corporate_actions(spark, d):
    x = market.table(spark, d, "lineitem").where("l_discount >= 0.09")
    value = F.sum(0.01 * F.col("l_extendedprice") / F.col("l_quantity"))
    return x.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("event_date")).agg(F.lit("cash_dividend").alias("event_type"), F.round(value + N, 4).alias("event_value"))


@query("cross_section_processing", f"with {Z} select trade_date, symbol, {r('mom20_w')} as winsorized, {r('mom20_f')} as filled, {r('mom20_z')} as zscored from z")
def cross_section_processing(spark, d):
    p = P.weekly_panel(spark, d).select("trade_date", "symbol", "mom20")
    out = p.withColumn("winsorized", X.winsorized("mom20")).withColumn("filled", X.median_filled("winsorized")).withColumn("zscored", X.zscored("filled"))
    return rounded(out.drop("mom20"))


@query(
    "neutralised",
    f"""with {PANEL}, m as (select s_suppkey as symbol, n_name as industry from supplier join nation on s_nationkey = n_nationkey),
j as (select p.trade_date, p.symbol, industry, mom20, ln(amount) as size from p join m using (symbol) where mom20 is not null)
select trade_date, symbol, {r("case when count(mom20) over (partition by trade_date, industry) >= 3 then mom20 - avg(mom20) over (partition by trade_date, industry) else mom20 end")} as mom20_industry,
  {r("case when regr_count(mom20, size) over (partition by trade_date) > 30 then mom20 - (regr_intercept(mom20, size) over (partition by trade_date) + regr_slope(mom20, size) over (partition by trade_date) * size) else mom20 end", 5)} as mom20_size
from j""",
)
def neutralised(spark, d):
    p = P.weekly_panel(spark, d).where("mom20 is not null").join(market.security_master(spark, d).select("symbol", "industry"), "symbol")
    return rounded(P.neutralised(p, "mom20").select("trade_date", "symbol", "mom20_industry", "mom20_size"), mom20_size=5)


@query(
    "rank_buckets",
    f"""with {PANEL}, k as (select trade_date, symbol, mom20, row_number() over (partition by trade_date order by mom20, symbol) as i, count(*) over (partition by trade_date) as n from p where mom20 is not null)
select trade_date, symbol, cast(greatest(1, least(5, ceil(i * 5.0 / n))) as int) as bucket, cast(greatest(1, ceil((i - 1) * 5.0 / greatest(n - 1, 1))) as int) as qcut,
  {r("(rank() over (partition by trade_date order by mom20) + (count(*) over (partition by trade_date, mom20) - 1) / 2.0) / n")} as pct_rank from k""",
)
def rank_buckets(spark, d):
    p = P.weekly_panel(spark, d).where("mom20 is not null")
    return rounded(p.select("trade_date", "symbol", X.bucket_of_rank("mom20", 5).alias("bucket"), X.equal_count_bucket("mom20", 5).alias("qcut"), X.percent_rank("mom20").alias("pct_rank")))


@query("rank_ic", f"with {IC} select trade_date, n, {r('rank_ic')} as rank_ic from ic")
def rank_ic(spark, d):
    return rounded(P.rank_ic(scored(spark, d), "mom20", "fwd"))


@query(
    "ic_summary",
    f"""with {IC} select count(*) as n_dates, {r("avg(rank_ic)")} as mean_ic, {r("stddev_pop(rank_ic)")} as std_ic, {r("avg(rank_ic) / nullif(stddev_pop(rank_ic), 0)")} as ir,
{r("avg(case when rank_ic > 1e-12 then 1.0 else 0.0 end)")} as positive_rate, {r("avg(abs(rank_ic))")} as mean_abs_ic from ic""",
)
def ic_summary(spark, d):
    return rounded(P.ic_summary(P.rank_ic(scored(spark, d), "mom20", "fwd")))


BUCKETS = f"""{PANEL}, k as (select trade_date, symbol, fwd, ceil(row_number() over (partition by trade_date order by mom20, symbol) * 5.0 / count(*) over (partition by trade_date)) as b
  from p where mom20 is not null and fwd is not null),
dm as (select trade_date, cast(greatest(1, least(5, b)) as int) as bucket, avg(fwd) as m from k group by all)"""


@query("quantile_returns", f"with {BUCKETS} select bucket, {r('avg(m)')} as mean_forward_return, {r('stddev_samp(m)')} as std_forward_return, count(*) as n_dates from dm group by bucket")
def quantile_returns(spark, d):
    return rounded(P.quantile_returns(P.weekly_panel(spark, d), "mom20", "fwd"))


@query("long_short", f"with {BUCKETS} select trade_date, {r('arg_max(m, bucket) - arg_min(m, bucket)')} as long_short from dm group by trade_date")
def long_short(spark, d):
    return rounded(P.long_short(P.weekly_panel(spark, d), "mom20", "fwd"))


RANKED = f"""{PANEL}, sr as (select *, row_number() over (partition by trade_date order by mom20 desc, symbol) as signal_rank from p where mom20 is not null)"""


@query("signal_ranks", f"with {RANKED} select trade_date, symbol, {r('mom20')} as score, signal_rank from sr")
def signal_ranks(spark, d):
    return rounded(P.signal_ranks(P.weekly_panel(spark, d), "mom20").select("trade_date", "symbol", F.col("mom20").alias("score"), "signal_rank"))


@query(
    "signal_stats",
    f"with {PANEL} select trade_date, count(*) as scored_count, {r('max(mom20)')} as top_score, {r('quantile_cont(mom20, 0.5)')} as median_score, {r('min(mom20)')} as bottom_score from p where mom20 is not null group by trade_date",
)
def signal_stats(spark, d):
    return rounded(P.signal_stats(P.weekly_panel(spark, d), "mom20"))


@query(
    "selection_turnover",
    f"""with {RANKED}, hd as (select trade_date, list(distinct symbol) as held from sr where signal_rank <= 15 group by trade_date),
hb as (select *, lag(held) over (order by trade_date) as before from hd)
select trade_date, len(held)::int as selected, {r("case when before is null then 0.0 else 1 - len(list_intersect(held, before)) / len(held)::double end")} as turnover from hb""",
)
def selection_turnover(spark, d):
    return rounded(P.selection_turnover(P.signal_ranks(P.weekly_panel(spark, d), "mom20"), 15))


@query(
    "signal_coverage",
    f"""with {PANEL}, {UNI} select u.trade_date, count(*) as candidates, count(mom20) as scored, count(fwd) as labelled, {r("count(mom20) / count(*)::double")} as scored_share
from uni u left join p on p.trade_date = u.trade_date and p.symbol = u.symbol group by u.trade_date""",
)
def signal_coverage(spark, d):
    u = market.universe_membership(market.weekly_bar(spark, d)).select("trade_date", "symbol")
    j = u.join(P.weekly_panel(spark, d), ["trade_date", "symbol"], "left").groupBy("trade_date")
    return rounded(
        j.agg(
            F.count(F.lit(1)).alias("candidates"), F.count("mom20").alias("scored"), F.count("fwd").alias("labelled"), (F.count("mom20") / F.count(F.lit(1))).alias("scored_share")
        )
    )


DATASET = f"""{PANEL}, {UNI}, {TRADE},
ds as (select u.trade_date, u.symbol, u.universe_weight, p.mom20, p.rev5, p.vol20, p.liq5_20, p.fwd, td.can_buy, td.can_sell, td.is_new_listing, td.is_st
  from uni u left join p on p.trade_date = u.trade_date and p.symbol = u.symbol left join td on td.trade_date = u.trade_date and td.symbol = u.symbol
  where mom20 is not null and rev5 is not null and vol20 is not null and liq5_20 is not null)"""


@query(
    "model_dataset",
    f"with {DATASET} select trade_date, symbol, {r('mom20')} as mom20, {r('rev5')} as rev5, {r('vol20')} as vol20, {r('liq5_20')} as liq5_20, {r('fwd')} as fwd, can_buy, is_new_listing from ds",
)
def model_dataset(spark, d):
    return rounded(P.model_dataset(spark, d).select("trade_date", "symbol", *P.FEATURES, "fwd", "can_buy", "is_new_listing"))


@query(
    "candidate_reasons",
    f"""with {PANEL}, {UNI}, {TRADE} select p.trade_date, p.symbol, case when not coalesce(can_buy, false) then 'temporarily_restricted' when coalesce(is_new_listing, false) then 'new_listing'
  when coalesce(is_st, false) then 'is_st' when universe_weight is null then 'not_in_universe' else '' end as reason
from p left join uni u on u.trade_date = p.trade_date and u.symbol = p.symbol left join td on td.trade_date = p.trade_date and td.symbol = p.symbol""",
)
def candidate_reasons(spark, d):
    bars = market.weekly_bar(spark, d)
    keys = ["trade_date", "symbol"]
    c = bars.select(*keys).join(market.universe_membership(bars), keys, "left").join(market.tradability(bars), keys, "left")
    return P.reasons(c).select(*keys, "reason")


NAVS = f"""{PANEL}, {UNI},
ur as (select u.trade_date, sum(universe_weight * coalesce(ret, 0)) as daily_return from uni u left join p on p.trade_date = u.trade_date and p.symbol = u.symbol group by u.trade_date),
nv as (select trade_date, daily_return, exp(sum(ln(1 + daily_return)) over (order by trade_date rows unbounded preceding)) as nav from ur),
dd as (select *, nav / max(nav) over (order by trade_date rows unbounded preceding) - 1 as drawdown from nv)"""


def navs(spark, d):
    bars = market.weekly_bar(spark, d)
    return E.nav(E.universe_returns(market.universe_membership(bars), bars.withColumn("ret", W.pct_change("close", 1))))


@query("benchmark_nav", f"with {NAVS} select trade_date, {r('daily_return')} as daily_return, {r('ln(nav)', 5)} as log_nav, {r('drawdown')} as drawdown from dd")
def benchmark_nav(spark, d):
    return rounded(E.drawdown(navs(spark, d)).select("trade_date", "daily_return", F.ln("nav").alias("log_nav"), "drawdown"), log_nav=5)


@query(
    "monthly_returns",
    f"""with {NAVS}, me as (select last_day(trade_date) as month_end, arg_max(nav, trade_date) as nav from nv group by 1)
select month_end, {r("coalesce(nav / lag(nav) over (order by month_end) - 1, 0)", 5)} as monthly_return from me""",
)
def monthly_returns(spark, d):
    return rounded(E.monthly(navs(spark, d)).select("month_end", "monthly_return"), monthly_return=5)


@query(
    "yearly_breakdown",
    f"with {NAVS} select cast(year(trade_date) as int) as year, count(*) as n_rows, {r('ln(arg_max(nav, trade_date) / arg_min(nav, trade_date))', 5)} as log_return, {r('stddev_samp(daily_return)')} as volatility, {r('min(drawdown)')} as max_drawdown from dd group by 1",
)
def yearly_breakdown(spark, d):
    y = E.yearly(navs(spark, d))
    return rounded(y.withColumn("log_return", F.log1p("total_return")).drop("total_return"), log_return=5)


@query(
    "performance",
    f"""with {NAVS} select count(*) as n_rows, {r("ln(arg_max(nav, trade_date))", 4)} as log_return, {r("ln(pow(arg_max(nav, trade_date), 52.0 / count(*)))", 4)} as annual_log_return, {r("stddev_pop(daily_return) * sqrt(52)", 5)} as annual_volatility,
{r("min(drawdown)")} as max_drawdown, {r("avg(daily_return) * sqrt(52) / stddev_samp(daily_return)", 5)} as sharpe, {r("avg(case when daily_return > 0 then 1.0 else 0.0 end)")} as win_rate from dd""",
)
def performance(spark, d):
    p = E.performance(navs(spark, d))
    p = p.withColumns({"log_return": F.log1p("total_return"), "annual_log_return": F.log1p("annual_return")}).drop("total_return", "annual_return")
    return rounded(p, log_return=4, annual_log_return=4, annual_volatility=5, sharpe=5)


@query(
    "regime_breakdown",
    f"""with {NAVS} select case when daily_return > 0.02 then 'bull' when daily_return < -0.02 then 'bear' else 'neutral' end as regime, count(*) as n_rows,
{r("avg(daily_return)")} as mean_return, {r("stddev_samp(daily_return)")} as volatility from ur group by 1""",
)
def regime_breakdown(spark, d):
    return rounded(E.regimes(navs(spark, d)))


@query(
    "cost_sensitivity",
    f"""with {NAVS}, c as (select unnest([0.5, 1.0, 1.5, 2.0]) as multiplier)
select cast(multiplier as double) as multiplier, {r("sum(daily_return - 0.001 * multiplier)", 5)} as net_return from ur, c group by 1""",
)
def cost_sensitivity(spark, d):
    grid = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,)], "multiplier double")
    out = navs(spark, d).crossJoin(F.broadcast(grid)).groupBy("multiplier").agg(F.sum(F.col("daily_return") - 0.001 * F.col("multiplier")).alias("net_return"))
    return rounded(out, net_return=5)


LADDER = f"""{NAVS}, lm as (select trade_date, nav, case when count(*) over (order by trade_date rows between 9 preceding and current row) = 10 then avg(nav) over (order by trade_date rows between 9 preceding and current row) end as s,
  case when count(*) over (order by trade_date rows between 29 preceding and current row) = 30 then avg(nav) over (order by trade_date rows between 29 preceding and current row) end as l,
  nav / lag(nav, 10) over (order by trade_date) - 1 as m from nv),
ld as (select trade_date, case when l is null or nav >= s then 1.0 when nav >= l then 0.7 when m < 0 then 0.2 else 0.4 end as gross_exposure from lm)"""


@query("exposure_ladder", f"with {LADDER} select trade_date, cast(gross_exposure as double) as gross_exposure from ld")
def exposure_ladder(spark, d):
    return E.ladder(navs(spark, d)).select("trade_date", "gross_exposure")


@query(
    "target_weights",
    f"""with {LADDER}, sr as (select trade_date, symbol, row_number() over (partition by trade_date order by mom20 desc, symbol) as i from p where mom20 is not null)
select sr.trade_date, symbol, i as signal_rank, {r("least(0.1, coalesce(gross_exposure, 1.0) / count(*) over (partition by sr.trade_date))")} as target_weight from sr left join ld using (trade_date) where i <= 15""",
)
def target_weights(spark, d):
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20")
    return rounded(B.top_n(ranked, 15, E.ladder(navs(spark, d))).select("trade_date", "symbol", "signal_rank", "target_weight"))


FICS = f"""{DATASET},
fx as (select trade_date, unnest(['mom20', 'rev5', 'vol20', 'liq5_20']) as feature, unnest([corr(mom20, fwd), corr(rev5, fwd), corr(vol20, fwd), corr(liq5_20, fwd)]) as c
  from ds where fwd is not null group by trade_date having count(*) >= 2),
fi as (select trade_date, feature, case when c is null or isnan(c) then 0.0 else c end as ic from fx)"""
FEAT = P.FEATURES


def weights_sql(mean: str, floor: float) -> str:
    return f"""{FICS}, fr as (select trade_date, feature, greatest(coalesce({mean}, {floor}), {floor}) as w from (select *, row_number() over (partition by feature order by trade_date) as k from fi)),
fw as (select trade_date, feature, w / sum(w) over (partition by trade_date) as weight from fr)"""


IC_W = weights_sql("avg(ic) over (partition by feature order by trade_date rows between 81 preceding and 22 preceding)", 0.001)


@query("feature_ics", f"with {FICS} select trade_date, feature, {r('ic')} as ic from fi")
def feature_ics(spark, d):
    return rounded(M.feature_ics(P.model_dataset(spark, d), FEAT, "fwd"))


@query("ic_weights", f"with {IC_W} select trade_date, feature, {r('weight')} as weight from fw")
def ic_weights(spark, d):
    return rounded(M.ic_weights(M.feature_ics(P.model_dataset(spark, d), FEAT, "fwd"), lookback=61 - 1))


_E = "exp(k * (ln(2.0) / 20.0))"
_F = "(partition by feature order by trade_date rows between 141 preceding and 22 preceding)"


@query("adaptive_ic_weights", f"with {weights_sql(f'sum(ic * {_E}) over {_F} / sum({_E}) over {_F}', 0.05)} select trade_date, feature, {r('weight', 5)} as weight from fw")
def adaptive_ic_weights(spark, d):
    return rounded(M.adaptive_weights(M.feature_ics(P.model_dataset(spark, d), FEAT, "fwd")), weight=5)


@query("simple_average", f"with {DATASET} select trade_date, symbol, {r('(mom20 + rev5 + vol20 + liq5_20) / 4')} as score from ds")
def simple_average(spark, d):
    return rounded(M.simple_average(P.model_dataset(spark, d), FEAT).select("trade_date", "symbol", "score"))


@query(
    "ic_weighted_scores",
    f"""with {IC_W}, pw as (select trade_date, max(case when feature = 'mom20' then weight end) as a, max(case when feature = 'rev5' then weight end) as b, max(case when feature = 'vol20' then weight end) as c,
  max(case when feature = 'liq5_20' then weight end) as d from fw group by trade_date)
select ds.trade_date, symbol, {r("mom20 * coalesce(a, 0.25) + rev5 * coalesce(b, 0.25) + vol20 * coalesce(c, 0.25) + liq5_20 * coalesce(d, 0.25)")} as score from ds left join pw using (trade_date)""",
)
def ic_weighted_scores(spark, d):
    ds = P.model_dataset(spark, d)
    return rounded(M.weighted_scores(ds, M.ic_weights(M.feature_ics(ds, FEAT, "fwd")), FEAT).select("trade_date", "symbol", "score"))


@query("ridge_scores", None)
def ridge_scores(spark, d):
    return rounded(M.ridge_scores(P.model_dataset(spark, d), FEAT, "fwd").select("trade_date", "symbol", "score", "fallback_used"))


@query(
    "ic_by_horizon",
    f"""with {PANEL}, hz as (select trade_date, mom20, {", ".join(f"({S.lead('close', h)} / nullif({S.lead('close', 1)}, 0) - 1) as y{h}" for h in (2, 5, 10, 20, 40))} from p),
hu as (select trade_date, unnest([2, 5, 10, 20, 40]) as horizon, unnest([{", ".join(f"corr(mom20, y{h})" for h in (2, 5, 10, 20, 40))}]) as ic,
  unnest([{", ".join(f"count(case when mom20 is not null then y{h} end)" for h in (2, 5, 10, 20, 40))}]) as n from hz group by trade_date)
select horizon, {r("avg(ic)")} as mean_ic, {r("stddev_samp(ic)")} as std_ic, count(*) as n_dates from hu where n >= 3 and ic is not null and not isnan(ic) group by horizon""",
)
def ic_by_horizon(spark, d):
    return rounded(R.ic_by_horizon(P.weekly_panel(spark, d), "mom20", (2, 5, 10, 20, 40)))


_PAIRS = [(a, b) for i, a in enumerate(FEAT) for b in FEAT[i + 1 :]]


@query(
    "factor_correlations",
    f"""with {PANEL} select unnest([{", ".join(f"'{a}'" for a, _ in _PAIRS)}]) as factor_a, unnest([{", ".join(f"'{b}'" for _, b in _PAIRS)}]) as factor_b, unnest([{", ".join(r(f"corr({a}, {b})") for a, b in _PAIRS)}]) as corr from p""",
)
def factor_correlations(spark, d):
    return rounded(R.correlations(P.weekly_panel(spark, d), FEAT))


REG = f"""{NAVS}, rg as (select trade_date, count(*) over w as k, stddev_samp(daily_return) over w as vol, avg(daily_return) over w * 52 as trend from ur window w as (order by trade_date rows between 19 preceding and current row)),
rn as (select trade_date, vol, trend, (case when trend > 0.02 then 'up' when trend < -0.02 then 'down' else 'flat' end) || '_' || (case when vol > 0.2 then 'high_vol' when vol < 0.1 then 'low_vol' else 'mid_vol' end) as regime from rg where k = 20)"""


@query("market_regimes", f"with {REG} select trade_date, {r('vol')} as vol, {r('trend')} as trend, regime from rn")
def market_regimes(spark, d):
    return rounded(R.market_regimes(navs(spark, d)))


@query(
    "factor_states",
    f"""with {FICS}, a as (select *, row_number() over (partition by feature order by trade_date) as i from fi), b as (select *, i - coalesce(max(case when not ic < -0.03 then i end) over (partition by feature order by trade_date), 0) as streak from a),
c as (select *, min(case when streak >= 15 then i end) over (partition by feature order by trade_date) as off_at from b), e as (select *, max(case when streak = 0 and off_at is not null then 1 else 0 end) over (partition by feature order by trade_date) as back from c)
select feature, trade_date, {r("ic")} as ic, streak, case when off_at is not null then case when back = 1 then 'RESERVE' else 'OFFLINE' end when streak >= 10 then 'REDUCED' when streak >= 5 then 'WATCH' else 'ACTIVE' end as state from e""",
)
def factor_states(spark, d):
    return rounded(R.factor_states(M.feature_ics(P.model_dataset(spark, d), FEAT, "fwd")))


@query(
    "realized_ic",
    f"""with {PANEL}, k as (select trade_date, symbol, mom20 as x, fwd as y from p where mom20 is not null and fwd is not null), ra as (select *, {S.average_rank("x")} as rx, {S.average_rank("y")} as ry from k),
ic as (select trade_date, case when count(distinct x) < 2 or count(distinct y) < 2 or isnan(corr(rx, ry)) then 0.0 else corr(rx, ry) end as rank_ic from ra group by trade_date having count(*) >= 2),
dl as (select trade_date, lag(trade_date, 21) over (order by trade_date) as signal_date from (select distinct trade_date from p))
select dl.trade_date, dl.signal_date, {r("rank_ic")} as realized_ic from dl join ic on ic.trade_date = dl.signal_date""",
)
def realized_ic(spark, d):
    return rounded(R.realized_ic(P.weekly_panel(spark, d), "mom20"))


@query(
    "concentration",
    f"""with {PANEL}, q as (select trade_date, volume as w, row_number() over (partition by trade_date order by volume desc, symbol) as i from p where volume > 0)
select trade_date, count(*) as n_names, {r("sum(w * w) / (sum(w) * sum(w))")} as herfindahl, {r("sum(case when i <= 10 then w end) / sum(w)")} as top10_share from q group by trade_date""",
)
def concentration(spark, d):
    return rounded(R.concentration(market.weekly_bar(spark, d).select("trade_date", "symbol", F.col("volume").alias("weight"))))


@query(
    "streaks",
    f"""with {PANEL}, y as (select symbol, trade_date, coalesce(ret > 0, false) as yes from p), g as (select *, coalesce((yes <> {S.lag("yes")})::int, 1) as change from y),
h as (select *, {S.running("change")} as run from g) select symbol, trade_date, yes, row_number() over (partition by symbol, run order by trade_date) as streak from h""",
)
def streaks(spark, d):
    b = market.weekly_bar(spark, d).withColumn("ret", W.pct_change("close", 1)).select("symbol", "trade_date", "ret")
    return R.streaks(b, F.col("ret") > 0).select("symbol", "trade_date", "yes", "streak")


@query(
    "pit_fundamentals",
    f"""with {S.WEEKLY}, m as (select s_suppkey as symbol, n_nationkey as nation, from_ from (select *, 1 as from_ from supplier join nation on s_nationkey = n_nationkey)),
fq as (select c_nationkey as nation, date_trunc('quarter', o_orderdate) as q, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey group by all),
fp as (select nation, cast(q + interval 3 month + interval 45 day as date) as pub_date, revenue from fq)
select w.symbol, w.trade_date, f.revenue from (select weekly.symbol, trade_date, nation from weekly join m using (symbol)) w asof left join fp f on w.nation = f.nation and w.trade_date >= f.pub_date""",
)
def pit_fundamentals(spark, d):
    o, c = market.table(spark, d, "orders"), market.table(spark, d, "customer")
    q = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    published = q.select("nation", F.date_add(F.add_months(F.to_date("q"), 3), 45).alias("trade_date"), "revenue")
    s = market.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("nation"))
    names = market.weekly_bar(spark, d).select("symbol", "trade_date").join(s, "symbol")
    return P.as_of(names, published, "nation", "trade_date", "revenue").select("symbol", "trade_date", "revenue")


@query(
    "rebalance_actions",
    f"""with {RANKED}, dt as (select trade_date, row_number() over (order by trade_date desc) as i from (select distinct trade_date from sr)),
c as (select symbol, volume / sum(volume) over () as w from sr join dt using (trade_date) where i = 10 and signal_rank <= 30), t as (select symbol, volume / sum(volume) over () as w from sr join dt using (trade_date) where i = 1 and signal_rank <= 30)
select coalesce(c.symbol, t.symbol) as symbol, {r("coalesce(c.w, 0)")} as current_weight, {r("coalesce(t.w, 0)")} as new_weight,
  case when abs(coalesce(t.w, 0) - coalesce(c.w, 0)) < 0.005 then 'hold' when coalesce(t.w, 0) > coalesce(c.w, 0) then 'buy' else 'sell' end as action from c full join t on c.symbol = t.symbol""",
)
def rebalance_actions(spark, d):
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20").select("trade_date", "symbol", "volume", "signal_rank")
    dates = ranked.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy(F.desc("trade_date"))))
    chosen = ranked.where("signal_rank <= 30").join(F.broadcast(dates), "trade_date")
    side = lambda i: chosen.where(F.col("i") == i).select("symbol", (F.col("volume") / F.sum("volume").over(Window.partitionBy("trade_date"))).alias("weight"))
    return rounded(B.rebalance(side(10), side(1)))


@query(
    "macd_line",
    f"""with {PANEL}, u as (select symbol, trade_date, close, greatest(close - {S.lag("close")}, 0) as up, greatest({S.lag("close")} - close, 0) as dn from p),
hl as (select symbol, list(trade_date order by trade_date) as ts, list(close order by trade_date) as xs from u group by symbol),
e as (select symbol, ts[i] as trade_date, list_reduce(xs[1:i], lambda y, x: y + (x - y) * (2.0 / 13)) as f, list_reduce(xs[1:i], lambda y, x: y + (x - y) * (2.0 / 27)) as s from (select *, unnest(range(1, len(ts) + 1)) as i from hl))
select symbol, trade_date, {r("f - s", 5)} as macd_diff from e""",
)
def macd_line(spark, d):
    e = W.ewm(market.weekly_bar(spark, d), "close", {"fast": 12, "slow": 26})
    return e.select("symbol", "trade_date", F.round(F.col("fast") - F.col("slow") + N, 5).alias("macd_diff"))


@query(
    "ts_rank_argmax",
    f"""with {PANEL}, w as (select symbol, trade_date, close, list(close) over {S.over(10)} as xs from p)
select symbol, trade_date, {r("case when len(xs) = 10 then (len(list_filter(xs, lambda x: x < close)) + (len(list_filter(xs, lambda x: x = close)) + 1) / 2.0) / 10 end")} as ts_rank10,
  case when len(xs) = 10 then list_position(xs, list_max(xs)) - 1 end::bigint as argmax10 from w""",
)
def ts_rank_argmax(spark, d):
    b = market.weekly_bar(spark, d)
    return rounded(b.select("symbol", "trade_date", W.ts_rank("close", 10).alias("ts_rank10"), W.argmax("close", 10).cast("bigint").alias("argmax10")))


@query("backtest_grid", None)
def backtest_grid(spark, d):
    bars = market.weekly_bar(spark, d)
    keys = ["trade_date", "symbol"]
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20")
    weights = B.top_n(ranked, 15).select(F.col("trade_date").alias("signal_date"), "symbol", F.col("target_weight").alias("weight"))
    days = B.schedule(bars.select("trade_date").distinct())
    orders = weights.join(F.broadcast(days), "signal_date").select(F.col("execution_date").alias("trade_date"), "symbol", "weight")
    dividends = market.corporate_actions(spark, d).groupBy("symbol", F.to_date(F.date_trunc("week", "event_date")).alias("trade_date")).agg((0.01 * F.sum("event_value")).alias("dividend"))
    rows = bars.select(*keys, "open", "close").join(market.tradability(bars).select(*keys, "can_buy", "can_sell"), keys).join(orders, keys, "left").join(dividends, keys, "left")
    grid = spark.createDataFrame([(f"cost{m}", 1e7, 100.0, 0.000075 * m, 0.0005 * m, 0.0005 * m, 5000.0) for m in (0, 1, 2, 4)], "scenario string, cash double, lot double, commission double, stamp double, slippage double, least_trade double")
    return B.backtest(rows, grid)


@query(
    "target_smoothing",
    f"""with {RANKED}, t as (select trade_date, symbol, least(0.1, 1.0 / count(*) over (partition by trade_date)) as w from sr where signal_rank <= 15),
dt as (select trade_date, sum(w) as gross, row_number() over (order by trade_date) as i from t group by trade_date), tj as (select symbol, w, i from t join dt using (trade_date)),
h as (select symbol, dt.trade_date, any_value(dt.gross) as gross, sum(w * 0.5 * pow(0.5, dt.i - tj.i)) as held from tj join dt on tj.i <= dt.i group by all), k as (select * from h where held >= 1e-4)
select trade_date, symbol, {r("held")} as held_weight, {r("held * gross / sum(held) over (partition by trade_date)")} as scaled_weight from k""",
)
def target_smoothing(spark, d):
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20")
    return rounded(B.smoothed(B.top_n(ranked, 15).select("trade_date", "symbol", "target_weight")))


@query(
    "constrained_weights",
    f"""with {RANKED}, t as (select trade_date, symbol, volume / sum(volume) over (partition by trade_date) as w from sr where signal_rank <= 20),
c as (select *, least(w, 0.08) as k, sum(w) over (partition by trade_date) as b from t) select trade_date, symbol, {r("k * least(1.0, b) / sum(k) over (partition by trade_date)")} as final_weight from c""",
)
def constrained_weights(spark, d):
    ranked = P.signal_ranks(P.weekly_panel(spark, d), "mom20").where("signal_rank <= 20")
    t = ranked.select("trade_date", "symbol", (F.col("volume") / F.sum("volume").over(Window.partitionBy("trade_date"))).alias("target_weight"))
    return rounded(B.constrained(t).select("trade_date", "symbol", "final_weight"))


@query(
    "execution_schedule",
    f"with {S.WEEKLY}, n as (select trade_date, row_number() over (order by trade_date) - 1 as i, lag(trade_date) over (order by trade_date) as s from (select distinct trade_date from weekly)) select s as signal_date, trade_date as execution_date from n where i % 4 = 0 and s is not null",
)
def execution_schedule(spark, d):
    return B.schedule(market.weekly_bar(spark, d).select("trade_date").distinct())


@query(
    "features_long",
    f"""with {PANEL} select symbol, trade_date, feature_name, {r("feature_value")} as feature_value from (select symbol, trade_date, unnest(['mom20', 'rev5', 'vol20', 'liq5_20']) as feature_name, unnest([mom20, rev5, vol20, liq5_20]) as feature_value from p) where feature_value is not null""",
)
def features_long(spark, d):
    p = P.weekly_panel(spark, d).select("symbol", "trade_date", *FEAT)
    return rounded(p.unpivot(["symbol", "trade_date"], FEAT, "feature_name", "feature_value").where("feature_value is not null"))


@query(
    "sql_passthrough",
    """select r_name, n_name, count(*) as n_suppliers, round(sum(s_acctbal) + 1e-9, 2) as balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, n_name)""",
)
def sql_passthrough(spark, d):
    for t in ("supplier", "nation", "region"):
        market.table(spark, d, t).createOrReplaceTempView(f"passthrough_{t}")
    return spark.sql(
        """select r_name, n_name, count(*) as n_suppliers, round(sum(s_acctbal) + 1e-9, 2) as balance from passthrough_supplier join passthrough_nation on s_nationkey = n_nationkey
        join passthrough_region on n_regionkey = r_regionkey group by cube (r_name, n_name)"""
    )
