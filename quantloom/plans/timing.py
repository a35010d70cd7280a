"""Queries over fundamentals in two times, ages, leaks, redundancy with exposures, degradation, and ranks with average ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import fundamentals as U
from ..operators import panel as P
from ..operators import reports as T
from ..sources import market
from ..stored import stored
from .panel import PANEL, r, rounded
from .rebuilt import FEAT, named, panel, quarters, ranked
from .registry import query
from .study import MASTER, QUARTERS, STATUTORY

REPORTS = """rl as (select c_nationkey as nation, date_trunc('quarter', o_orderdate)::date as quarter, l_shipdate::date as shipped, l_extendedprice as gross, l_extendedprice * (1 - l_discount) as revenue, l_quantity as units
  from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey),
rd as (select *, case month(quarter) when 1 then make_date(year(quarter), 4, 30) when 4 then make_date(year(quarter), 8, 31) when 7 then make_date(year(quarter), 10, 31) else make_date(year(quarter) + 1, 4, 30) end as due from rl),
rp as (select nation, quarter, due as published, 1 as version, round(sum(gross), 4) as gross, round(sum(revenue), 4) as revenue, round(sum(units), 4) as units from rd where shipped <= due group by all
  union all select nation, quarter, (due + interval 6 month)::date, 2, round(sum(gross), 4), round(sum(revenue), 4), round(sum(units), 4) from rd group by nation, quarter, due)"""


def reports(spark, d):
    return stored(U.reports(*(market.table(spark, d, t) for t in ("orders", "customer", "lineitem"))), "reports")


@query("report_versions", f"with {REPORTS} select nation, quarter, published, version, gross, revenue, units::double as units from rp")
def report_versions(spark, d):
    return reports(spark, d).withColumn("units", F.col("units").cast("double"))


@query(
    "financial_ratios",
    f"""with {REPORTS}, k as (select a.nation, a.quarter, a.version, a.published, a.gross, a.revenue, a.units, b.revenue as before, b.units as units_before, row_number() over (partition by a.nation, a.quarter, a.version order by b.published desc nulls last) as i
  from rp a left join rp b on b.nation = a.nation and b.quarter = (a.quarter - interval 12 month)::date and b.published <= a.published)
select nation, quarter, version, {r("revenue / nullif(gross, 0)")} as margin, {r("gross / nullif(units, 0)", 4)} as price, {r("revenue / nullif(before, 0) - 1")} as revenue_growth, {r("units / nullif(units_before, 0) - 1")} as units_growth from k where i = 1""",
)
def financial_ratios(spark, d):
    return rounded(U.calculated(reports(spark, d)).select("nation", "quarter", "version", "margin", "price", "revenue_growth", "units_growth"), price=4)


_NAMED = f"nm as (select p.symbol, p.trade_date, nation from p join m on p.symbol = m.symbol)"


@query(
    "known_fundamentals",
    f"""with {PANEL}, {MASTER}, {REPORTS}, {_NAMED}, k as (select symbol, trade_date, quarter, version, published, revenue, row_number() over (partition by symbol, trade_date order by quarter desc, version desc) as i from nm join rp on nm.nation = rp.nation and published <= trade_date)
select symbol, trade_date, quarter, version, revenue, trade_date - published as age from k where i = 1""",
)
def known_fundamentals(spark, d):
    x = U.known_on(named(spark, d), reports(spark, d), "nation", "trade_date", ["revenue"]).where("quarter is not null")
    return x.select("symbol", "trade_date", "quarter", "version", "revenue", A.age_in_days("trade_date", "published").cast("bigint").alias("age"))


@query(
    "timing_audit",
    f"""with {PANEL}, {MASTER}, {REPORTS}, {_NAMED}, f as (select nation, quarter, max_by(revenue, version) as v, max_by(published, version) as out, min(published) as first_out from rp group by all),
n as (select nm.*, f.quarter, v, out, first_out from nm join f on nm.nation = f.nation and f.quarter = date_trunc('quarter', trade_date)::date),
k as (select n.symbol, n.trade_date, n.quarter as naive_quarter, v, out, first_out, rp.quarter, rp.revenue, row_number() over (partition by n.symbol, n.trade_date order by rp.quarter desc nulls last, rp.version desc) as i from n left join rp on n.nation = rp.nation and rp.published <= n.trade_date)
select symbol, trade_date, naive_quarter, v as naive_value, quarter as known_quarter, revenue as known_value, case when trade_date < first_out then 'not_out' when trade_date < out then 'restated' end as leak, greatest(0, out - trade_date)::int as days_early from k where i = 1""",
)
def timing_audit(spark, d):
    return U.timing_audit(named(spark, d), reports(spark, d), "nation", "trade_date", "revenue").drop("nation")


@query(
    "fundamental_age",
    f"""with {PANEL}, {MASTER}, {QUARTERS}, du as (select nation, {STATUTORY} as due from fq), {_NAMED}, k as (select symbol, trade_date, max(due) as due from nm join du on nm.nation = du.nation and due <= trade_date group by all)
select symbol, trade_date, (trade_date - due)::int as age, case when trade_date - due <= 120 then 'use_lagged' else 'skip' end as action, trade_date - due > 120 as is_stale from k""",
)
def fundamental_age(spark, d):
    """Days, as a calendar counts them, since the newest report was out."""
    x = A.as_of(named(spark, d), quarters(spark, d).withColumn("since", F.col("due")), "nation", "trade_date", ["since"], "due").where("since is not null")
    age = A.age_in_days("trade_date", "since")
    return x.select("symbol", "trade_date", age.alias("age"), F.when(age <= 120, "use_lagged").otherwise("skip").alias("action"), (age > 120).alias("is_stale"))


@query("universe_at", f"with {PANEL}, iv as (select symbol, min(trade_date) as since from p group by symbol), q as (select symbol, (date_trunc('year', since) + interval 1 year)::date as lo, (date_trunc('year', since) + interval 4 year)::date as hi from iv) select p.symbol, p.trade_date, year(lo) as entered from p join q on p.symbol = q.symbol and p.trade_date >= lo and p.trade_date < hi")
def universe_at(spark, d):
    """Names between the first and the fourth year after their listing: an interval join by key."""
    p = panel(spark, d).select("symbol", "trade_date")
    since = p.groupBy("symbol").agg(F.date_trunc("year", F.min("trade_date")).alias("y"))
    spans = since.select("symbol", F.to_date(F.add_months("y", 12)).alias("lo"), F.to_date(F.add_months("y", 48)).alias("hi"), F.year(F.add_months("y", 12)).cast("bigint").alias("entered"))
    return A.in_interval(p, spans, "symbol", "trade_date", "lo", "hi", ["entered"])


_LONG = "lo as (" + " union all ".join(f"select symbol, trade_date, fwd as y, '{f}' as factor, {f} as x from p where {f} is not null and fwd is not null" for f in FEAT) + ")"
RANKED = f"""{PANEL}, {MASTER}, {_LONG}, lr as (select *, rank() over (partition by factor, trade_date order by x) + (count(*) over (partition by factor, trade_date, x) - 1) / 2.0 as rx, rank() over (partition by factor, trade_date order by y) + (count(*) over (partition by factor, trade_date, y) - 1) / 2.0 as ry,
  row_number() over (partition by factor, trade_date order by x, symbol) as i, count(*) over (partition by factor, trade_date) as n from lo),
ic as (select * from (select factor, trade_date, corr(rx, ry) as ic from lr where n >= 20 group by all) where ic is not null and not isnan(ic))"""
_PAIRS = [(a, b) for i, a in enumerate(FEAT) for b in FEAT[i + 1 :]]
THREE = f"""{RANKED}, iw as (pivot ic on factor in ({", ".join(f"'{f}'" for f in FEAT)}) using first(ic) group by trade_date), me as (select m.industry, {", ".join(f"avg({f}) as {f}" for f in FEAT)} from p join m on p.symbol = m.symbol group by m.industry),
rr as ({" union all ".join(f"select '{a}' as factor_a, '{b}' as factor_b, (select corr({a}, {b}) from p) as v, (select case when count(*) filter (where {a} is not null and {b} is not null) > 10 then corr({a}, {b}) end from iw) as c, (select case when count(*) > 5 then corr({a}, {b}) end from me) as e" for a, b in _PAIRS)}),
ra as (select *, (coalesce(abs(v), 0) + coalesce(abs(c), 0) + coalesce(abs(e), 0)) / ((v is not null)::int + (c is not null)::int + (e is not null)::int) as mean_abs from rr)"""


def three(spark, d):
    """The panel with industries, ICs, and pairs by three kinds of likeness, each stored."""
    s, n = market.table(spark, d, "supplier"), market.table(spark, d, "nation")
    master = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"))
    p = stored(P.weekly_panel(spark, d).join(master, "symbol"), "panel")
    ic = stored(T.ics(T.ranked(p, FEAT)), "ics")
    return ic, stored(T.redundancy(p, ic, FEAT, "industry"), "pairs")


@query("redundancy_by_three", f"with {THREE} select factor_a, factor_b, {r('v')} as value_corr, {r('c')} as ic_corr, {r('e')} as exposure_corr, {r('mean_abs')} as mean_abs, mean_abs > 0.7 as redundant from ra")
def redundancy_by_three(spark, d):
    return rounded(three(spark, d)[1])


@query(
    "factor_groups",
    f"""with recursive {THREE}, ed as (select factor_a as a, factor_b as b from ra where mean_abs > 0.3 union select factor_b, factor_a from ra where mean_abs > 0.3), st as (select factor, avg(ic) as m from ic group by factor),
re(a, b) as (select factor, factor from st union select re.a, ed.b from re join ed on re.b = ed.a), gr as (select a as factor, min(b) as group_id from re group by a)
select gr.factor, group_id, count(*) over (partition by group_id) as group_size, case when row_number() over (partition by group_id order by abs(m) desc, gr.factor) = 1 then 'keep' else 'remove' end as advice from gr join st using (factor)""",
)
def factor_groups(spark, d):
    ic, pairs = three(spark, d)
    return T.groups(pairs, T.summary(ic).select("factor", "ic_mean"), 0.3)


@query(
    "degradation_report",
    f"""with {RANKED}, st as (select factor, avg(ic) as m, avg(ic) / nullif(stddev_samp(ic), 0) as ir from ic group by factor), yr as (select factor, year(trade_date) as y, avg(ic) as ic from ic group by all),
yy as (select factor, max_by(ic, y) - min_by(ic, y) as trend, count(*) as n, avg(ic) filter (where y >= 1998) as recent, max(ic) / nullif(sum(ic), 0) as share from yr group by factor),
bu as (select factor, trade_date, greatest(1, ceil((i - 1) * 5.0 / greatest(n - 1, 1)))::int as b, y from lr), bm as (select factor, trade_date, b, avg(y) as y from bu group by all), bb as (select factor, b, avg(y) as y from bm group by all),
sp as (select factor, max_by(y, b) - min_by(y, b) - 0.0015 as net, corr(b, y) as mono from bb group by factor), dl as (select factor, trade_date, max(y) filter (where b = 5) - max(y) filter (where b = 1) as ls from bm group by all),
wi as (select factor, avg((ls > 0)::int) as win from dl where ls is not null group by factor),
al as (select *, coalesce(m > 0.02 and net < 0, false) as i1, coalesce(recent < 0 and m > 0, false) as i2, coalesce(n >= 3 and trend < -0.02, false) as i3, coalesce(mono < 0.6, false) as i4 from st join yy using (factor) join sp using (factor) join wi using (factor)),
sc as (select *, 30 * i1::int + 25 * i2::int + 40 * i3::int + 20 * i4::int as score from al), ki as (select *, case when score >= 60 then 'economic_decay' when score >= 40 then 'trading_decay' when score >= 20 then 'expression_decay' when m > 0 and ir > 0 then 'healthy' else 'dead' end as kind from sc)
select factor, {r("m")} as ic_mean, {r("ir")} as ic_ir, {r("mono")} as monotonicity, {r("trend")} as ic_trend, {r("recent")} as recent_ic, {r("net")} as net_return, {r("win")} as spread_win_rate, {r("share", 4)} as best_year_share,
  concat_ws(',', case when i1 then 'trading' end, case when i2 then 'expression' end, case when i3 then 'mechanism' end, case when i4 then 'monotonicity' end) as issues, score::int as score, kind,
  case kind when 'healthy' then 'keep' when 'expression_decay' then 'reformulate' when 'trading_decay' then 'reduce_weight' else 'offline' end as action, case kind when 'healthy' then 1.0 when 'expression_decay' then 0.5 when 'trading_decay' then 0.3 else 0.0 end::double as target_weight from ki""",
)
def degradation_report(spark, d):
    return rounded(T.degradation(ranked(spark, d), 1998), best_year_share=4)
