"""Queries: decayed and regime-aware weights, walk-forward verdicts, risk checks over every rebalance date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import enhancer as E
from ..operators import evaluation as V
from ..operators import models as M
from ..operators import panel as P
from ..operators import validation as A
from ..sources import market
from ..stored import stored
from . import sql as S
from .panel import FEAT, FICS, PANEL, r, rounded
from .pool import candidates
from .registry import query

#: Which family each feature of the panel belongs to.
FAMILY = {"mom20": "momentum", "rev5": "reversal", "vol20": "quality", "liq5_20": "value"}


def ics(spark, d):
    return stored(M.feature_ics(stored(P.model_dataset(spark, d), "dataset"), FEAT, "fwd"), "ics")


_B = "(partition by feature order by trade_date rows between {} preceding and {} preceding)"
DECAY = f"""{FICS}, d1 as (select *, row_number() over (partition by feature order by trade_date) as i from fi),
d2 as (select *, i - coalesce(max(case when not ic < 0 then i end) over (partition by feature order by trade_date), 0) as down from d1),
d3 as (select *, max(case when down >= 5 then 1 else 0 end) over {_B.format(55, 0)} as bad, min(ic) over {_B.format(59, 40)} >= 0 as steady, avg(case when ic > 0 then 1.0 else 0.0 end) over {_B.format(59, 0)} as share from d2),
d4 as (select *, case when i < 60 then 'active' when ic < -0.03 then 'offline' when bad = 1 then 'reduced' when steady then 'active' when share < 0.35 then 'reduced' else 'active' end as status from d3)"""


@query("factor_decay_status", f"with {DECAY} select trade_date, feature, status, case status when 'offline' then 0.0 when 'reduced' then 0.5 else 1.0 end::double as multiplier from d4")
def factor_decay_status(spark, d):
    return A.decay_status(ics(spark, d))


_E = "exp(k * (ln(2.0) / 20.0))"
_F = _B.format(141, 22)


@query(
    "decayed_weights",
    f"""with {DECAY}, e1 as (select *, i as k, lag(status, 22) over (partition by feature order by trade_date) as known from d4),
e2 as (select *, greatest(coalesce(sum(ic * {_E}) over {_F} / sum({_E}) over {_F}, 0.001), 0.001) * case coalesce(known, 'active') when 'offline' then 0.0 when 'reduced' then 0.5 else 1.0 end as w from e1), e3 as (select *, greatest(w, 0.05) as g from e2)
select trade_date, feature, {r("g / sum(g) over (partition by trade_date)", 5)} as weight, coalesce(known, 'active') as status from e3""",
)
def decayed_weights(spark, d):
    return rounded(A.decayed_weights(ics(spark, d)), 5)


@query("regime_aware_weights", None)
def regime_aware_weights(spark, d):
    p = stored(P.weekly_panel(spark, d), "panel")
    nav = V.nav(V.universe_returns(market.universe_membership(p.select(*market.BAR)), p))
    return rounded(A.decayed_weights(ics(spark, d), regimes=A.simple_regimes(nav), families=FAMILY))


WALK = f"""{PANEL}, wl as (select trade_date, symbol, mom20 as x, fwd as y from p where mom20 is not null and fwd is not null),
wr as (select *, {S.average_rank("x")} as rx, {S.average_rank("y")} as ry, row_number() over (partition by trade_date order by x desc, symbol) as i from wl),
wd as (select trade_date, case when isnan(corr(rx, ry)) then null else corr(rx, ry) end as ic, sum(case when i <= 40 then y end) / 40 - 0.02 * 15.75e-4 as ret from wr group by trade_date),
wi as (select *, row_number() over (order by trade_date) - 1 as i from wd), wn as (select unnest(range(0, greatest(0, (max(i) + 1 - 120) // 20 + 1))) as w from wi),
tr as (select w, count(*) as n_train, avg(ic) as is_ic, exp(sum(ln(1 + greatest(ret, -0.999999)))) - 1 as is_return from wi, wn where i < 100 + w * 20 group by w),
t1 as (select w, trade_date, ic, ret, exp(sum(ln(1 + greatest(ret, -0.999999))) over (partition by w order by trade_date)) as nav from wi, wn where i >= 100 + w * 20 and i < 120 + w * 20),
t2 as (select *, nav / max(nav) over (partition by w order by trade_date) - 1 as dd from t1),
te as (select w, count(*) as n_test, min(trade_date) as test_start, max(trade_date) as test_end, avg(ic) as oos_ic, avg(ic) / nullif(stddev_samp(ic), 0) as oos_ic_ir, exp(sum(ln(1 + greatest(ret, -0.999999)))) - 1 as oos_return,
  coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 0) as oos_sharpe, min(dd) as oos_drawdown, avg(case when ret > 0 then 1.0 else 0.0 end) as oos_hits from t2 group by w),
wf as (select * from te join tr using (w))"""


@query(
    "walk_forward_report",
    f"with {WALK} select w::int as fold, test_start, test_end, n_test, n_train, {', '.join(f'{r(c)} as {c}' for c in ('oos_ic', 'oos_ic_ir', 'oos_sharpe', 'oos_drawdown', 'oos_hits', 'is_ic'))}, {r('ln(1 + oos_return)', 4)} as oos_log_return, {r('ln(1 + is_return)', 4)} as is_log_return from wf",
)
def walk_forward_report(spark, d):
    x = A.walk_forward(P.weekly_panel(spark, d), "mom20", "fwd")
    x = x.withColumns({"oos_log_return": F.log1p("oos_return"), "is_log_return": F.log1p("is_return")}).drop("oos_return", "is_return")
    return rounded(x, oos_log_return=4, is_log_return=4)


@query("walk_forward_verdict", None)
def walk_forward_verdict(spark, d):
    return A.walk_forward_verdict(A.walk_forward(P.weekly_panel(spark, d), "mom20", "fwd"))


def held(spark, d):
    """What each strategy of `enhanced_portfolio` holds after each rebalance, with what the risk checks look at."""
    at = stored(candidates(spark, d), "candidates")
    rules = E.Rules(lot=1, least_trade=10.0)
    made = stored(E.enhanced(at, rules)[0], "decisions")
    keys = ["strategy", "execution_date"]
    prices = at.select(*keys, "symbol", "price").withColumn("later", F.lead("price").over(Window.partitionBy("strategy", "symbol").orderBy("execution_date")))
    grown = made.join(prices, [*keys, "symbol"], "left").withColumn("gain", F.col("final_weight") * F.coalesce(F.col("later") / F.col("price") - 1, F.lit(0.0)))
    by = grown.groupBy(*keys).agg(F.sum("gain").alias("gain"), F.sum("cost").alias("cost"), F.sum(F.abs(F.col("final_weight") - F.col("held_before"))).alias("turnover"))
    order = Window.partitionBy("strategy").orderBy("execution_date")
    by = by.withColumn("nav", F.exp(F.coalesce(F.sum(F.log1p(F.greatest("gain", F.lit(-0.999999)))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    seen = at.groupBy(*keys).agg((F.max("score") - F.min("score")).alias("spread"), F.avg(F.col("score").isNotNull().cast("double")).alias("coverage"))
    s, n = market.table(spark, d, "supplier"), market.table(spark, d, "nation")
    industry = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"))
    value = market.weekly_bar(spark, d).groupBy("symbol").agg(F.avg("amount").alias("daily_value"))
    rows = made.where("final_weight > 0").select(*keys, "symbol", F.col("final_weight").alias("weight")).join(by, keys).join(seen, keys).join(industry, "symbol").join(value, "symbol")
    return rows.withColumns({"ic": F.lit(0.0), "account": F.lit(rules.equity), "cost": F.col("cost") / rules.equity})


@query("risk_checks", None)
def risk_checks(spark, d):
    return rounded(A.risk_checks(held(spark, d)))


@query("risk_levels", None)
def risk_levels(spark, d):
    """By strategy and check: how often at which level, and on how many dates the emergency mode held."""
    x = A.risk_checks(held(spark, d))
    return x.groupBy("strategy", "check", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("emergency").alias("n_emergency"))
