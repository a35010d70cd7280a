"""Queries over the factor pool, the enhancer, style neutralisation, boosted trees, responses and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cross as X
from ..functions import windows as W
from ..operators import boosting as G
from ..operators import enhancer as E
from ..operators import evaluation as V
from ..operators import neutral as N
from ..operators import panel as P
from ..operators import pool as K
from ..operators import portfolio as B
from ..operators import research as R
from ..operators import responses as Q
from ..sources import market
from ..stored import stored
from . import sql as S
from .panel import PANEL, r, rounded
from .registry import query

#: mom5 is rev5 the other way round: a collinear pair on purpose.
WIDE = [*P.FEATURES, "mom5", "mom10", "size", "span"]
WIDE_SQL = f"""{PANEL}, w as (select *, {S.pct("close", 5)} as mom5, {S.pct("close", 10)} as mom10, ln(amount) as size, (high - low) / nullif(close, 0) as span from p)"""


def wide(spark, d):
    """The panel with eight features, stored: what follows reads the order lines no more."""
    p = P.weekly_panel(spark, d, (5, 10)).withColumns({"size": F.ln("amount"), "span": W.ratio(F.col("high") - F.col("low"), F.col("close"))})
    return stored(p, "wide")


_FILLED = ", ".join(f"coalesce(case when isfinite({f}) then {f} end, 0) as {f}" for f in WIDE)
_EACH = lambda select: " union all ".join(select(f) for f in WIDE)
INCREMENTAL = f"""{WIDE_SQL}, cl as (select fwd, {_FILLED} from w where fwd is not null and isfinite(fwd)),
gr as (select {", ".join(f"rank() over (order by {f}) + (count(*) over (partition by {f}) - 1) / 2.0 as r_{f}" for f in (*WIDE, "fwd"))} from cl),
gi as ({_EACH(lambda f: f"select '{f}' as factor, corr(r_{f}, r_fwd) as ic from gr")}),
inc as (select factor, ic, row_number() over (order by ic desc nulls last, factor) as position, ic > 0 and row_number() over (order by ic desc nulls last, factor) <= 5 as selected from gi)"""


@query("incremental_factors", f"with {INCREMENTAL} select factor, {r('ic')} as ic, cast(position as int) as position, selected from inc")
def incremental_factors(spark, d):
    return rounded(K.incremental(wide(spark, d), WIDE, "fwd"))


@query("forward_selection", None)
def forward_selection(spark, d):
    return rounded(K.forward_selection(wide(spark, d), WIDE, "fwd", least_gain=1e-9))


STATUSES = f"""{WIDE_SQL}, un as (select symbol, trade_date, fwd as y, factor, x from (select symbol, trade_date, fwd, {", ".join(WIDE)} from w) unpivot (x for factor in ({", ".join(WIDE)}))),
tk as (select *, row_number() over (partition by factor, trade_date order by x desc, symbol) as i from un), th as (select factor, trade_date, list(symbol) as held from tk where i <= 15 group by all),
tb as (select *, lag(held) over (partition by factor order by trade_date) as before from th), tt as (select factor, avg(case when before is null then 0.0 else 1 - len(list_intersect(held, before)) / len(held)::double end) as turnover from tb group by factor),
kn as (select * from un where y is not null), kr as (select *, {S.average_rank("x", "factor, trade_date")} as rx, {S.average_rank("y", "factor, trade_date")} as ry,
  row_number() over (partition by factor, trade_date order by x, symbol) as i, count(*) over (partition by factor, trade_date) as n from kn),
kb as (select factor, trade_date, greatest(1, least(5, ceil(i * 5.0 / n)))::int as bucket, avg(y) as m from kr group by all), km as (select factor, bucket, avg(m) as m from kb group by all), ko as (select factor, corr(bucket, m) as monotonicity from km group by factor),
ki as (select factor, trade_date, case when isnan(corr(rx, ry)) then 0 else coalesce(corr(rx, ry), 0) end as ic from kr group by all having count(*) >= 2),
ks as (select factor, avg(ic) as mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) as ir, avg((ic > 1e-12)::int) as positive from ki group by factor),
kc as (select *, coalesce(mean_ic >= 0.02, false)::int + coalesce(ir >= 0.15, false)::int + coalesce(positive >= 0.5, false)::int + coalesce(monotonicity >= 0.6, false)::int + coalesce(turnover <= 0.5, false)::int as n_passed from ks join ko using (factor) join tt using (factor)),
sta as (select *, case when n_passed = 5 then 'pass' when n_passed * 3 >= 10 then 'conditional' else 'fail' end as status from kc)"""


@query("factor_statuses", f"with {STATUSES} select factor, {', '.join(f'{r(c)} as {c}' for c in ('mean_ic', 'ir', 'positive', 'monotonicity', 'turnover'))}, n_passed, status from sta")
def factor_statuses(spark, d):
    return rounded(K.statuses(wide(spark, d), WIDE, "fwd"))


_OVER = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]]
REDUNDANCY = "pa as (" + " union all ".join(f"select '{a}' as factor_a, '{b}' as factor_b, corr({a}, {b}) as corr from w" for a, b in _OVER) + ")"
_REST = STATUSES.split(f"{WIDE_SQL}, ")[1]


@query(
    "final_pool",
    f"""with {INCREMENTAL}, {_REST}, {REDUNDANCY}, hi as (select distinct case when coalesce(x.ic, 0) < coalesce(y.ic, 0) then factor_a else factor_b end as factor from pa left join inc x on x.factor = factor_a left join inc y on y.factor = factor_b where pa.corr > 0.9)
select inc.factor, {r("inc.ic")} as ic, case when selected and status = 'conditional' then 'both' when selected then 'selected' else 'conditional' end as source from inc join sta on inc.factor = sta.factor where (selected or status = 'conditional') and inc.factor not in (select factor from hi)""",
)
def final_pool(spark, d):
    w = wide(spark, d)
    return rounded(K.final_pool(K.statuses(w, WIDE, "fwd"), K.incremental(w, WIDE, "fwd"), R.correlations(w, WIDE)))


@query(
    "pool_score",
    f"""with {STATUSES}, {REDUNDANCY}, a as (select count(*) filter (where status <> 'fail') as n_passed, avg(case when mean_ic > 0 then mean_ic end) as mean_ic from sta), b as (select count(*) filter (where abs(corr) > 0.8) as n_redundant from pa)
select n_passed, {r("mean_ic")} as mean_ic, n_redundant, {r("n_passed * 10 + coalesce(mean_ic, 0) * 100 - n_redundant * 0.1")} as score from a, b""",
)
def pool_score(spark, d):
    w = wide(spark, d)
    return rounded(K.pool_score(K.statuses(w, WIDE, "fwd"), R.correlations(w, WIDE)))


STYLES = ["size", "vol20", "liq5_20"]
#: The same residual by another road: styles made orthogonal one after the other, then taken off one by one.
_DAY = "over (partition by trade_date)"
_OFF = lambda x, e: f"{x} - coalesce(sum({x} * {e}) {_DAY} / nullif(sum({e} * {e}) {_DAY}, 0), 0) * {e}"
NEUTRAL = f"""{WIDE_SQL}, n0 as (select trade_date, symbol, mom20, {", ".join(f"{c} - avg({c}) {_DAY} as c{i}" for i, c in enumerate((*STYLES, "mom20")))}, count(*) {_DAY} as n from w where {" and ".join(f"{c} is not null" for c in (*STYLES, "mom20"))}),
n1 as (select *, {_OFF("c1", "c0")} as e1, {_OFF("c2", "c0")} as d2, {_OFF("c3", "c0")} as y1 from n0), n2 as (select *, {_OFF("d2", "e1")} as e2, {_OFF("y1", "e1")} as y2 from n1), n3 as (select trade_date, symbol, n, {_OFF("y2", "e2")} as rest from n2)"""


@query("style_neutral", f"with {NEUTRAL} select w.trade_date, w.symbol, {r('case when n >= 50 then rest else mom20 end', 4)} as mom20_neutral from w left join n3 on w.trade_date = n3.trade_date and w.symbol = n3.symbol where w.mom20 is not null")
def style_neutral(spark, d):
    out = N.style_neutral(wide(spark, d).where("mom20 is not null"), "mom20", STYLES)
    return rounded(out.select("trade_date", "symbol", "mom20_neutral"), 4)


@query("style_coefficients", None)
def style_coefficients(spark, d):
    return N.style_coefficients(wide(spark, d), "mom20", [c for c in WIDE if c != "mom20"])


@query(
    "bucket_calibration",
    f"""with {PANEL}, k as (select mom20 as x, fwd as y from p where mom20 is not null and fwd is not null), e as (select quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as q from k),
b as (select 1 + len(list_filter(list_distinct(q), lambda z: x > z)) as bucket, y from k, e) select cast(bucket as int) as bucket, {r("avg(y)")} as mean_return, count(*) as n from b group by bucket""",
)
def bucket_calibration(spark, d):
    return rounded(E.calibrated(stored(P.weekly_panel(spark, d), "panel"), "mom20", "fwd"))


def candidates(spark, d, n: int = 15, every: int = 4):
    """Each feature is a strategy: every fourth date the names by its score of the date before, the n best wanted in equal weights."""
    p = stored(P.weekly_panel(spark, d), "panel")
    uni = market.universe_membership(p.select(*market.BAR))
    nav = V.nav(V.universe_returns(uni, p))
    exposure = E.market_exposure(nav, 10, 30)
    long = p.select("trade_date", "symbol", *P.FEATURES).unpivot(["trade_date", "symbol"], P.FEATURES, "strategy", "score").where("score is not null")
    day = Window.partitionBy("strategy", "trade_date")
    ranked = long.withColumns({"rank": F.row_number().over(day.orderBy(F.desc("score"), "symbol")), "n": F.count(F.lit(1)).over(day)})
    ranked = ranked.withColumn("share", 1 - (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    dates = B.schedule(p.select("trade_date").distinct(), every)
    at = ranked.withColumnRenamed("trade_date", "signal_date").join(dates, "signal_date").join(p.select(F.col("trade_date").alias("execution_date"), "symbol", F.col("open").alias("price")), ["execution_date", "symbol"], "left")
    at = at.join(exposure.select(F.col("trade_date").alias("signal_date"), "exposure"), "signal_date", "left")
    return at.withColumns({"target_weight": F.when(F.col("rank") <= n, F.lit(0.95 / n)), "gross": F.lit(0.95)})


@query("enhanced_portfolio", None)
def enhanced_portfolio(spark, d):
    return rounded(E.enhanced(candidates(spark, d), E.Rules(lot=1, least_trade=10.0))[0])


@query("enhanced_trades", None)
def enhanced_trades(spark, d):
    return rounded(E.trade_summary(E.enhanced(candidates(spark, d), E.Rules(lot=1, least_trade=10.0))[0]))


def boosted(spark, d) -> G.Boosted:
    """Every 60th date with a year of dates before it is scored."""
    p = wide(spark, d)
    dates = sorted(x["trade_date"] for x in p.select("trade_date").distinct().collect())  # a row a date
    return G.walk_forward(p, WIDE, "fwd", dates[160::60], train=100, valid=20, settings=G.Settings(rounds=8, bins=16, patience=3))


@query("boosted_scores", None)
def boosted_scores(spark, d):
    return rounded(boosted(spark, d).scores)


@query("boosted_importance", None)
def boosted_importance(spark, d):
    return rounded(boosted(spark, d).importance)


@query("boosted_validation", None)
def boosted_validation(spark, d):
    return rounded(boosted(spark, d).metrics)


def realised(spark, d, horizon: int = 20, delay: int = 1):
    """factor, trade_date, signal_date, ic: each feature's rank IC, known when its label is."""
    p = stored(P.weekly_panel(spark, d), "panel")
    dates = p.select("trade_date").distinct().withColumn("known_at", F.lead("trade_date", horizon + delay).over(Window.orderBy("trade_date")))  # one row a date
    long = p.select("trade_date", "symbol", "fwd", *P.FEATURES).unpivot(["trade_date", "symbol", "fwd"], P.FEATURES, "factor", "x").where("x is not null and fwd is not null")
    by = ("factor", "trade_date")
    ic = long.withColumns({"rx": X.average_rank("x", by), "ry": X.average_rank("fwd", by)}).groupBy(*by).agg(W.pair_corr("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 50")
    return ic.join(dates, "trade_date").where("known_at is not null").select("factor", F.col("known_at").alias("trade_date"), F.col("trade_date").alias("signal_date"), "ic")


@query("factor_responses", None)
def factor_responses(spark, d):
    return rounded(Q.factor_responses(realised(spark, d))[0])


