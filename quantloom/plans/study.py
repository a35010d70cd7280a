"""Research, construction and timing queries said once in SQL that Spark and the checking engine both read.

Spark's side reads a stored panel, so a statement that names it many times doesn't derive it again; those that share the ranked table find that
stored too. Where an operator of the library answers a query (rebuilt.py), it takes the place of the statement's Spark side.

A statement selects from `p`, the weekly panel (bars, ret, four features, fwd), and from what else it names in `uses`: `m` (master),
`uni` (universe), `ur` (the universe's return by date). Spark gets these as DataFrames and plans each statement as a whole.
"""

from __future__ import annotations

from ..operators import evaluation as E
from ..operators import panel as P
from ..operators import reports as T
from ..sources import market
from ..stored import stored
from . import sql as S
from .panel import NAVS, PANEL, UNI, r, rounded  # noqa: F401
from .registry import query

FEAT = P.FEATURES
MASTER = "m as (select s_suppkey as symbol, s_name as security_name, n_name as industry, n_nationkey as nation from supplier join nation on s_nationkey = n_nationkey)"
QUARTERS = "fq as (select c_nationkey as nation, cast(date_trunc('quarter', o_orderdate) as date) as quarter, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey group by c_nationkey, date_trunc('quarter', o_orderdate))"
NAMED = {"m": MASTER, "uni": UNI, "ur": NAVS.split("nv as")[0].split(f"{PANEL}, ")[1].strip().rstrip(","), "fq": QUARTERS, "sup": "sup as (select * from supplier)"}


def frames(spark, d) -> dict:
    """What statements may select from; nothing is computed before it is used."""
    supplier, nation = market.table(spark, d, "supplier"), market.table(spark, d, "nation")
    panel = []

    def p():
        if not panel:
            panel.append(stored(P.weekly_panel(spark, d), "panel"))
        return panel[0]
    named = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)

    def returns():
        return E.universe_returns(market.universe_membership(p()), p())

    return {
        "p": p,
        "m": lambda: named.selectExpr("s_suppkey as symbol", "s_name as security_name", "n_name as industry", "n_nationkey as nation"),
        "sup": lambda: supplier,
        "uni": lambda: market.universe_membership(p()),
        "ur": returns,
        "fq": lambda: spark.sql(QUARTERS.split(" as ", 1)[1].strip()[1:-1].replace("from orders join customer", "from {orders} join {customer}"), orders=market.table(spark, d, "orders"), customer=market.table(spark, d, "customer")),
    }


def both(name: str, text: str, uses: tuple[str, ...] = ()) -> None:
    """Register a statement: named tables first (`a as (...), b as (...)`), then `select`."""
    extra = "".join(f", {NAMED[u]}" for u in uses if u != "uni" or "ur" not in uses)  # `ur` brings `uni`

    def run(spark, d):
        known = frames(spark, d)
        own, body = {u: known[u]() for u in ("p", *uses)}, text
        if "ur" in own:
            own["ur"] = stored(own["ur"], "returns")
        if text.startswith(RANKED):
            own["lr"] = stored(T.ranked(own["p"], FEAT).withColumnRenamed("y", "fwd"), "ranked")
            own["ic"] = stored(spark.sql(f"with lr as (select * from {{lr}}), {IC_OF} select * from ic", lr=own["lr"]), "ics")
            body = text.removeprefix(RANKED).removeprefix(f", {IC_OF}").lstrip(", \n")
        tables = ", ".join(f"{u} as (select * from {{{u}}})" for u in own)
        return spark.sql(f"with {tables}, {body}" if not body.startswith("select") else f"with {tables} {body}", **own)

    query(name, f"with {PANEL}{extra}{' ' if text.startswith('select') else ', '}{text}")(run)


def pearson(x: str, y: str, over: str = "") -> str:
    """Null without spread; over rows where both are known."""
    a, b = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    return f"(covar_pop({a}, {b}){over} / nullif(stddev_pop({a}){over} * stddev_pop({b}){over}, 0))"


def rank_of(x: str, by: str) -> str:
    """Average rank, all in one partitioning."""
    return f"((rank() over (partition by {by} order by {x}) + count(*) over (partition by {by}) + 1 - rank() over (partition by {by} order by {x} desc)) / 2)"


LONG = "lo as (" + " union all ".join(f"select symbol, trade_date, fwd, '{f}' as factor, {f} as x from p" for f in FEAT) + ")"
RANKED = f"""{LONG}, lk as (select * from lo where x is not null and fwd is not null),
lr as (select *, {rank_of("x", "factor, trade_date")} as rx, {rank_of("fwd", "factor, trade_date")} as ry, count(*) over (partition by factor, trade_date) as n,
  row_number() over (partition by factor, trade_date order by x, symbol) as i from lk)"""
IC_OF = f"""li as (select factor, trade_date, {pearson("rx", "ry")} as ic from lr where n >= 20 group by factor, trade_date),
ic as (select * from li where ic is not null)"""
RANKS = f"""{RANKED}, {IC_OF},
lb as (select factor, trade_date, greatest(1, cast(ceil((i - 1) * 5.0 / greatest(n - 1, 1)) as int)) as bucket, avg(fwd) as y from lr group by 1, 2, 3),
bk as (select factor, bucket, avg(y) as y from lb group by factor, bucket),
ls as (select factor, max_by(y, bucket) - min_by(y, bucket) as long_short, {pearson("cast(bucket as double)", "y")} as monotonicity from bk group by factor),
yr as (select factor, year(trade_date) as year, avg(ic) as ic from ic group by factor, year(trade_date)),
yc as (select factor, sum(case when ic > 0 then 1 else 0 end) as positive_years, sum(case when ic <= 0 then 1 else 0 end) as negative_years from yr group by factor),
st as (select factor, count(*) as n_dates, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(ic) / nullif(stddev_samp(ic), 0) as ic_ir, avg(case when ic > 0 then 1e0 else 0e0 end) as win_rate from ic group by factor)"""

both(
    "factor_report",
    f"""{RANKS} select st.factor, n_dates, {r("ic_mean")} as ic_mean, {r("ic_std")} as ic_std, {r("ic_ir")} as ic_ir, {r("win_rate")} as win_rate, positive_years, negative_years, {r("long_short")} as long_short,
{", ".join(f"{r(f'long_short - {c}e-4')} as net_{c}bp" for c in (5, 10, 20, 30, 50))},
case when ic_mean > 0.005 and ic_ir > 0.1 and positive_years >= 4 then 'keep_strong' when ic_mean > 0.002 and ic_ir > 0.05 and positive_years >= 3 then 'keep_moderate'
  when ic_mean > 0 and positive_years >= 2 then 'keep_weak' when long_short > 0.005 then 'marginal_long_short' else 'reject' end as recommendation
from st join yc on st.factor = yc.factor join ls on st.factor = ls.factor""",
)

both(
    "signal_research",
    f"""{RANKS}, yd as (select factor, ic - lag(ic) over (partition by factor order by year) as d1, ic - lag(ic, 2) over (partition by factor order by year) as d2, row_number() over (partition by factor order by year desc) as i from yr),
sc as (select st.factor, ic_mean, ic_ir, ic_mean / nullif(ic_std / sqrt(n_dates), 0) as t_stat, monotonicity, long_short, coalesce(d1, 0) as d1, coalesce(d2, 0) as d2,
  least(40, greatest(0, ic_mean * 1000 + 10)) + least(20, greatest(0, ic_ir * 50 + 10)) + least(20, greatest(0, monotonicity * 20)) + case when coalesce(d1, 0) > -0.02 then 20 else greatest(0, 20 + d1 * 500) end as composite
  from st join ls on st.factor = ls.factor join yd on st.factor = yd.factor where yd.i = 1)
select factor, {r("t_stat", 4)} as t_stat, {r("monotonicity")} as monotonicity, {r("d1")} as ic_decay_1y, {r("d2")} as ic_decay_2y, {r("composite", 4)} as composite,
case when composite >= 60 and ic_mean > 0 then 'strong' when composite >= 40 and ic_mean > 0 then 'moderate' when composite >= 20 and ic_mean > 0 then 'weak' when long_short > 0.002 then 'marginal' else 'reject' end as recommendation from sc""",
)

both(
    "decay_diagnosis",
    f"""{RANKS}, h as (select *, row_number() over (partition by factor order by trade_date) * 2 > count(*) over (partition by factor) as late from ic),
g as (select factor, avg(case when not late then ic end) as early_ic, avg(case when late then ic end) as late_ic, stddev_samp(case when late then ic end) as late_std from h group by factor)
select factor, {r("early_ic")} as early_ic, {r("late_ic")} as late_ic, {r("late_ic / nullif(early_ic, 0)", 4)} as retention,
case when early_ic * late_ic < 0 then 'reversed' when abs(late_ic) < 0.5 * abs(early_ic) then 'decayed' when late_std > 3 * abs(late_ic) then 'unstable' else 'stable' end as degradation from g""",
)

both(
    "health_snapshot",
    f"""{RANKS}, k as (select *, row_number() over (partition by factor order by trade_date desc) as i from ic)
select factor, {", ".join(f"{r(f'avg(case when i <= {n} then ic end)')} as mean_{n}, {r(f'stddev_pop(case when i <= {n} then ic end)')} as std_{n}" for n in (5, 20, 60))} from k group by factor""",
)

both("ic_monitor", f"""{RANKS}, twice as (select * from ic union all select * from ic where ic > 0), one as (select factor, trade_date, max(ic) as ic from twice group by factor, trade_date)
select factor, trade_date, {r("ic")} as ic, {r("avg(ic) over (partition by factor order by trade_date rows between 19 preceding and current row)")} as mean_20 from one""")

both("pooled_ic", f"""{LONG}, lk as (select * from lo where x is not null and fwd is not null), lr as (select *, {rank_of("x", "factor")} as rx, {rank_of("fwd", "factor")} as ry from lk)
select factor, count(*) as n_rows, {r(pearson("x", "fwd"))} as pearson_ic, {r(pearson("rx", "ry"))} as spearman_ic from lr group by factor having count(*) >= 30""")

both(
    "clipped_ic",
    f"""q as (select trade_date, percentile_cont(0.02) within group (order by liq5_20) as lo, percentile_cont(0.98) within group (order by liq5_20) as hi from p where liq5_20 is not null and fwd is not null group by trade_date),
c as (select p.trade_date, symbol, fwd, least(greatest(liq5_20, lo), hi) as x from p join q on p.trade_date = q.trade_date where liq5_20 is not null and fwd is not null),
z as (select *, (x - avg(x) over (partition by trade_date)) / nullif(stddev_samp(x) over (partition by trade_date), 0) as z from c), k as (select * from z where z is not null),
lr as (select *, {rank_of("z", "trade_date")} as rx, {rank_of("fwd", "trade_date")} as ry from k), ics as (select trade_date, {pearson("z", "fwd")} as a, {pearson("rx", "ry")} as b from lr group by trade_date having count(*) >= 5)
select count(*) as n_dates, {r("avg(a)")} as pearson_ic, {r("avg(b)")} as spearman_ic, {r("avg(b) / nullif(stddev_samp(b), 0)")} as ir from ics""",
)

_PAIRS = [(a, b) for i, a in enumerate(FEAT) for b in FEAT[i + 1 :]]
REDUNDANT = f"""{RANKS}, sp as ({" union all ".join(f"select '{a}' as factor_a, '{b}' as factor_b, {pearson(a, b)} as value_corr from p" for a, b in _PAIRS)}),
sr as (select a.factor as factor_a, b.factor as factor_b, {pearson("a.ic", "b.ic")} as ic_corr from ic a join ic b on a.trade_date = b.trade_date and a.factor < b.factor group by a.factor, b.factor),
rd as (select sp.factor_a, sp.factor_b, value_corr, ic_corr, (abs(value_corr) + abs(ic_corr)) / 2 as mean_abs from sp join sr on least(sp.factor_a, sp.factor_b) = sr.factor_a and greatest(sp.factor_a, sp.factor_b) = sr.factor_b)"""
both("redundancy", f"{REDUNDANT} select factor_a, factor_b, {r('value_corr')} as value_corr, {r('ic_corr')} as ic_corr, mean_abs > 0.7 as redundant from rd")

both(
    "redundancy_groups",
    f"""{REDUNDANT}, e as (select factor_a as a, factor_b as b from rd where mean_abs > 0.2 union all select factor_b, factor_a from rd where mean_abs > 0.2 union all select factor, factor from st),
e2 as (select distinct x.a, y.b from e x join e y on x.b = y.a), e4 as (select distinct x.a, y.b from e2 x join e2 y on x.b = y.a), g as (select a as factor, min(b) as group_id from e4 group by a),
k as (select g.factor, group_id, ic_ir, row_number() over (partition by group_id order by abs(ic_mean) desc, g.factor) as i, count(*) over (partition by group_id) as n from g join st on g.factor = st.factor)
select factor, group_id, n as group_size, case when i = 1 then 'keep' else 'remove' end as advice from k""",
)

_Z = {f: f"(({f} - avg({f}) over (partition by trade_date)) / nullif(stddev_pop({f}) over (partition by trade_date), 0))" for f in FEAT}
_MEAN = lambda fs: "(" + " + ".join(f"z_{f}" for f in fs) + f") / {len(fs)}"
_OTHERS = {f: [g for g in FEAT if g != f] for f in FEAT}
both(
    "marginal_contribution",
    f"""zz as (select trade_date, symbol, fwd, {", ".join(f"{z} as z_{f}" for f, z in _Z.items())} from p where {" and ".join(f"{f} is not null" for f in FEAT)} and fwd is not null),
po as ({" union all ".join(f"select '{f}' as factor, trade_date, symbol, fwd, {_MEAN(FEAT)} as whole, {_MEAN(_OTHERS[f])} as without, z_{f} as own from zz" for f in FEAT)}),
kn as (select * from po where whole is not null and without is not null),
rk as (select *, {rank_of("whole", "factor, trade_date")} as rw, {rank_of("without", "factor, trade_date")} as ro, {rank_of("fwd", "factor, trade_date")} as ry,
  abs(own - lag(own) over (partition by factor, symbol order by trade_date)) as moved from kn),
dy as (select factor, trade_date, {pearson("rw", "ry")} as iw, {pearson("ro", "ry")} as io from rk group by factor, trade_date), ics as (select factor, avg(iw) as iw, avg(io) as io from dy group by factor),
tu as (select factor, avg(moved) as turnover from rk group by factor), pt as (select avg(turnover) as pool from tu),
cr as (select {", ".join(f"abs({pearson('z_' + a, 'z_' + b)}) as c_{a}_{b}" for a, b in _PAIRS)} from zz),
dv as ({" union all ".join(f"select '{f}' as factor, ({' + '.join(f'c_{a}_{b}' for a, b in _PAIRS if f not in (a, b))}) / 3 - ({' + '.join(f'c_{a}_{b}' for a, b in _PAIRS)}) / 6 as diversity from cr" for f in FEAT)}),
sc as (select ics.factor, iw - io as ic_change, diversity, (turnover - pool) / 100 as turnover_change, 10 * (iw - io) + 5 * diversity - (turnover - pool) as score from ics join dv on ics.factor = dv.factor join tu on ics.factor = tu.factor cross join pt)
select factor, {r("ic_change")} as ic_change, {r("diversity")} as diversity_change, {r("turnover_change")} as turnover_change, {r("score", 5)} as score,
case when score > 0.5 then 'ADD' when score > 0 then 'CONDITIONAL_ADD' when score > -0.5 then 'WATCH' else 'REJECT' end as recommendation from sc""",
)

INDEX = "ix as (select trade_date, daily_return as x, exp(sum(ln(1 + daily_return)) over (order by trade_date rows between unbounded preceding and current row)) as nav from ur)"
VOLUME = "vo as (select trade_date, sum(volume) as v from p group by trade_date)"
REGIMES = f"""{INDEX}, {VOLUME}, w as (select ix.trade_date, x, v, count(*) over (order by ix.trade_date rows between 19 preceding and current row) as k, stddev_samp(x) over (order by ix.trade_date rows between 19 preceding and current row) * sqrt(52) as vol,
  avg(x) over (order by ix.trade_date rows between 19 preceding and current row) * 52 as trend, v / avg(v) over (order by ix.trade_date rows between 19 preceding and current row) as liq from ix join vo on ix.trade_date = vo.trade_date),
f as (select *, cume_dist() over (order by vol) as q from w where k = 20),
rg as (select trade_date, vol, trend, liq, q, case when q >= 0.8 then 'high' when q <= 0.2 then 'low' else 'normal' end as vol_regime, case when trend > 0.02 then 'uptrend' when trend < -0.02 then 'downtrend' else 'neutral' end as trend_regime,
  case when liq > 1.2 then 'easy' when liq < 0.8 then 'tight' else 'normal' end as liq_regime from f)"""
both("regime_composite", f"{REGIMES} select trade_date, {r('trend')} as trend, {r('liq')} as volume_ratio, concat(vol_regime, '_', trend_regime, '_', liq_regime) as regime from rg", ("ur",))

both(
    "factor_by_regime",
    f"""{REGIMES}, {LONG}, j as (select lo.*, trend_regime from lo join rg on lo.trade_date = rg.trade_date where x is not null and fwd is not null),
k as (select *, {rank_of("x", "factor, trend_regime")} as rx, {rank_of("fwd", "factor, trend_regime")} as ry from j)
select factor, trend_regime, count(*) as n_rows, {r(pearson("rx", "ry"))} as spearman from k group by factor, trend_regime having count(*) > 50""",
    ("ur",),
)

both(
    "factor_roles",
    f"""{REDUNDANT}, {REGIMES}, hc as (select distinct factor_b as factor from rd where mean_abs > 0.7),
br as (select factor, avg(case when trend_regime = 'uptrend' then ic end) as up, avg(case when trend_regime = 'downtrend' then ic end) as down from ic join rg on ic.trade_date = rg.trade_date group by factor)
select st.factor, {r("ic_mean")} as ic_mean, {r("up")} as ic_up, {r("down")} as ic_down, case when hc.factor is not null then 'REDUNDANT' when (up > 0.02 and down < 0) or (down > 0.02 and up < 0) then 'CONDITIONAL'
  when ic_ir > 0.3 and ic_mean > 0.02 then 'PRIMARY' when ic_ir > 0.1 or ic_mean > 0.01 then 'AUXILIARY' else 'UNCLASSIFIED' end as role
from st left join hc on st.factor = hc.factor join br on st.factor = br.factor""",
    ("ur",),
)

both(
    "market_states",
    f"""{INDEX}, w as (select trade_date, nav, row_number() over (order by trade_date) as i, avg(nav) over (order by trade_date rows between 9 preceding and current row) as s, avg(nav) over (order by trade_date rows between 29 preceding and current row) as l from ix),
k as (select trade_date, i, nav / nullif(l, 0) - 1 as position, s / nullif(l, 0) - 1 as slope from w),
c as (select *, case when i < 40 then 'RANGING' when position > 0.03 and slope > 0.005 then 'BULL' when position < -0.03 or (position < 0 and slope < -0.005) then 'BEAR' when abs(position) < 0.03 then 'RANGING' else 'TRENDING' end as state from k)
select trade_date, {r("position", 5)} as position, {r("slope", 5)} as slope, state, case state when 'BULL' then 1e0 when 'BEAR' then 0e0 when 'TRENDING' then 1e0 else 0.3e0 end as multiplier,
case when position > 0.05 then 'up' when position < -0.05 then 'down' else 'flat' end as simple_state from c""",
    ("ur",),
)

both("two_tier_exposure", f"""{INDEX}, k as (select trade_date, nav / lag(nav, 20) over (order by trade_date) - 1 as change from ix)
select trade_date, {r("ln(1 + change)", 5)} as log_change, case when change is null or change >= 0 then 1e0 else 0.5e0 end as gross_exposure from k""", ("ur",))

NEUTRAL = f"""nu as (select p.trade_date, p.symbol, industry, fwd, mom20 as x, ln(amount) as size, vol20 from p join m on p.symbol = m.symbol where mom20 is not null),
nb as (select *, least(5, cast(ceil(row_number() over (partition by trade_date order by size, symbol) * 5.0 / count(*) over (partition by trade_date)) as int)) as size_bucket,
  x - avg(x) over (partition by trade_date, industry) as by_industry from nu),
nd as (select *, x - avg(x) over (partition by trade_date, size_bucket) as by_size, by_industry - avg(by_industry) over (partition by trade_date, size_bucket) as by_both from nb),
nk as (select * from nd where vol20 is not null),
nm as (select *, count(*) over w as n, covar_pop(x, size) over w as c1, covar_pop(x, vol20) over w as c2, var_pop(size) over w as v1, var_pop(vol20) over w as v2, covar_pop(size, vol20) over w as v12,
  avg(x) over w as mx, avg(size) over w as m1, avg(vol20) over w as m2 from nk window w as (partition by trade_date)),
ns as (select *, case when n >= 50 and v1 * v2 - v12 * v12 > 1e-12 then x - mx - (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) * (size - m1) - (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) * (vol20 - m2) else x end as by_styles from nm)"""
both("neutralised_more", f"{NEUTRAL} select trade_date, symbol, size_bucket, {r('by_size', 5)} as by_size, {r('by_both', 5)} as by_both, {r('by_styles', 4)} as by_styles from ns", ("m",))

both(
    "neutralization_report",
    f"""{NEUTRAL}, va as ({" union all ".join(f"select '{v}' as variant, trade_date, symbol, fwd, {c} as x from ns" for v, c in (("raw", "x"), ("industry", "by_industry"), ("size", "by_size"), ("both", "by_both")))}),
vk as (select *, {rank_of("round(x, 9)", "variant, trade_date")} as rx, {rank_of("fwd", "variant, trade_date")} as ry from va where fwd is not null), vi as (select variant, trade_date, {pearson("rx", "ry")} as ic from vk group by variant, trade_date having count(*) >= 3)
select variant, count(ic) as n_dates, {r("avg(ic)", 5)} as mean_ic, {r("avg(ic) / nullif(stddev_samp(ic), 0)", 4)} as ir from vi group by variant""",
    ("m",),
)

both("rank_turnover", f"""k as (select trade_date, symbol, {rank_of("mom20", "trade_date")} / count(*) over (partition by trade_date) as q from p where mom20 is not null), d as (select trade_date, abs(q - lag(q) over (partition by symbol order by trade_date)) as moved from k)
select trade_date, {r("5 * avg(moved)")} as turnover_proxy from d group by trade_date""")

both("tail_returns", f"""k as (select trade_date, fwd, row_number() over (partition by trade_date order by mom20 desc, symbol) as i, row_number() over (partition by trade_date order by mom20, symbol desc) as j, count(*) over (partition by trade_date) as n from p where mom20 is not null and fwd is not null)
select trade_date, {r("avg(case when i <= greatest(1, floor(0.1e0 * n)) then fwd end)")} as top_decile, {r("avg(case when j <= greatest(1, floor(0.1e0 * n)) then fwd end)")} as bottom_decile from k group by trade_date""")

both("value_buckets", f"""q as (select trade_date, {", ".join(f"percentile_cont({k / 4}) within group (order by mom20) as e{k}" for k in (1, 2, 3))} from p where mom20 is not null group by trade_date)
select p.trade_date, symbol, case when mom20 <= e1 then 1 when mom20 <= e2 then 2 when mom20 <= e3 then 3 else 4 end as bucket from p join q on p.trade_date = q.trade_date where mom20 is not null""")

both("score_ranks", f"select trade_date, symbol, cast(rank() over (partition by trade_date order by mom20 desc) as bigint) as min_rank, {r(rank_of("mom20", "trade_date") + " / count(*) over (partition by trade_date)")} as share from p where mom20 is not null")

both("normality", f"""k as (select ret, avg(ret) over () as mu from p where ret is not null), s as (select count(*) as n, avg(pow(ret - mu, 2)) as m2, avg(pow(ret - mu, 3)) as m3, avg(pow(ret - mu, 4)) as m4 from k)
select n, {r("m3 / pow(m2, 1.5e0)", 4)} as skew, {r("m4 / (m2 * m2) - 3", 4)} as excess_kurtosis, n / 6e0 * (pow(m3 / pow(m2, 1.5e0), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) < 5.99 as normal from s""")

both("market_beta", f"""k as (select symbol, ret, avg(ret) over (partition by trade_date) as mret from p where ret is not null)
select symbol, {r("covar_samp(ret, mret)")} as cov, {r("covar_samp(ret, mret) / nullif(var_samp(mret), 0)")} as beta from k group by symbol""")

both("price_index", f"select trade_date, {r('avg(close)', 4)} as mean_price, count(*) as n_names from p group by trade_date")

both("rank_correlations", f"""k as (select {", ".join(f"{rank_of(f, '1')} as r_{f}" for f in FEAT)} from p where {" and ".join(f"{f} is not null" for f in FEAT)})
{" union all ".join(f"select '{a}' as factor_a, '{b}' as factor_b, {r(pearson('r_' + a, 'r_' + b))} as spearman from k" for a, b in _PAIRS)}""")

both("contribution_share", f"""k as (select trade_date, symbol, volume * ret / sum(volume) over (partition by trade_date) as c from p where ret is not null), o as (select *, row_number() over (partition by trade_date order by abs(c) desc, symbol) as i from k)
select trade_date, {r("sum(c)")} as total, {r("sum(case when i <= 10 then abs(c) end) / nullif(sum(abs(c)), 0)")} as top10_share from o group by trade_date""")

TOP = "tp as (select *, row_number() over (partition by trade_date order by mom20 desc, symbol) as i from p where mom20 is not null)"
both(
    "position_buffer",
    f"""{TOP}, mk as (select *, max(case when i <= 15 then trade_date end) over (partition by symbol order by trade_date) as entered, max(case when i > 25 then trade_date end) over (partition by symbol order by trade_date) as left_ from tp)
select trade_date, symbol, i as signal_rank, i > 15 as retained from mk where entered is not null and (left_ is null or entered > left_)""",
)

_SIDES = f"""{TOP}, dt as (select trade_date, row_number() over (order by trade_date desc) as k from (select distinct trade_date from tp) x),
cw as (select symbol, volume / sum(volume) over () as w, close from tp join dt on tp.trade_date = dt.trade_date where k = 10 and i <= 30), tw as (select symbol, volume / sum(volume) over () as w, close, i from tp join dt on tp.trade_date = dt.trade_date where k = 1 and i <= 30),
bo as (select coalesce(cw.symbol, tw.symbol) as symbol, coalesce(cw.w, 0) as cur, coalesce(tw.w, 0) as tgt, coalesce(tw.close, cw.close) as price, coalesce(tw.i, 31) as i from cw full join tw on cw.symbol = tw.symbol)"""
both(
    "cost_alpha_filter",
    f"""{_SIDES}, x as (select *, tgt - cur as d, floor(abs(tgt - cur) * 1e6 / price / 10) * 10 * price as value, case when i <= 6 then 0.02e0 when i <= 12 then 0.01e0 when i <= 18 then 0.005e0 when i <= 24 then 0e0 else -0.005e0 end as expected from bo),
y as (select *, value * (0.75 + 5.0) / 10000 + case when d < 0 then value * 10.0 / 10000 else 0 end as cost, expected * abs(d) * 1e6 as alpha from x)
select symbol, {r("cost", 4)} as cost, {r("alpha", 4)} as alpha, case when abs(d) < 0.001 then 'SKIP_TOO_SMALL' when not price > 0 then 'SKIP_NO_PRICE' when value < 2000 then 'SKIP_MIN_TRADE' when d > 0 and alpha <= 0 then 'SKIP_LOW_ALPHA'
  when d > 0 and cost / greatest(alpha, 1) > 0.3 then 'SKIP_HIGH_COST' when d > 0 then 'BUY' else 'SELL' end as direction from y""",
)

both(
    "constraint_engine",
    f"""{_SIDES}, k as (select symbol, cur, case when row_number() over (order by tgt desc, symbol) <= 20 then least(tgt, 0.08) else 0 end as w from bo), g as (select *, sum(w) over () as gross from k),
s as (select symbol, cur, w * least(1.0, 0.95 / nullif(gross, 0)) as w from g), t as (select *, sum(abs(w - cur)) over () / 2 as turnover from s)
select symbol, {r("cur")} as current_weight, {r("cur + (w - cur) * least(1.0, 0.3 / nullif(turnover, 0))")} as final_weight, {r("turnover")} as wanted_turnover from t""",
)

both("decision_packet", f"""{_SIDES}, t as (select *, case when abs(tgt - cur) < 0.005 then cur else tgt end as w from bo), l as (select *, sum(abs(w - cur)) over () as l1 from t)
select symbol, {r("w - cur")} as delta, {r("l1")} as l1_turnover, case when l1 < 0.1 then 'hold' else 'rebalance' end as decision from l""")

both("review_gap", f"""{_SIDES}, f as (select symbol, tgt, case when symbol % 3 = 0 then cur else tgt end as actual from bo)
select symbol, {r("tgt")} as target_weight, {r("actual")} as actual_weight, {r("actual - tgt")} as gap, abs(actual - tgt) > 0.01 as needs_review from f""")

STRATEGY = f"""{TOP}, hd as (select trade_date, symbol from tp where i <= 15), nx as (select symbol, trade_date, lead(ret) over (partition by symbol order by trade_date) as nret, lead(trade_date) over (partition by symbol order by trade_date) as ndate from p),
sr as (select hd.trade_date, avg(coalesce(nret, 0)) as sret from hd join nx on hd.symbol = nx.symbol and hd.trade_date = nx.trade_date group by hd.trade_date),
br as (select trade_date, lead(daily_return) over (order by trade_date) as bret from ur),
sb as (select sr.trade_date, sret, bret, sret - bret as active from sr join br on sr.trade_date = br.trade_date where bret is not null)"""
both("against_benchmark", f"""{STRATEGY} select count(*) as n_dates, {r("sum(ln(1 + sret))", 4)} as log_return, {r("sum(ln(1 + bret))", 4)} as benchmark_log_return, {r("avg(active) * 52", 5)} as annual_excess,
{r("stddev_samp(active) * sqrt(52)", 5)} as tracking_error, {r("avg(active) / nullif(stddev_samp(active), 0) * sqrt(52)", 4)} as information_ratio, {r("avg(case when active > 0 then 1e0 else 0e0 end)")} as beat_rate, {r("covar_samp(sret, bret) / var_samp(bret)", 5)} as beta from sb""", ("ur",))

both("window_trim", f"""{STRATEGY}, b as (select min(trade_date) as first, max(trade_date) as last from sb) select p.trade_date, count(*) as n_names from p cross join b where p.trade_date between b.first and b.last group by p.trade_date""", ("ur",))

both("yearly_strategy", f"""{STRATEGY} select year(trade_date) as year, count(*) as n_dates, {r("sum(ln(1 + sret))", 4)} as log_return, {r("avg(active)")} as mean_active, {r("stddev_samp(sret)")} as volatility from sb group by year(trade_date) having count(*) >= 20""", ("ur",))

both("parameter_sensitivity", f"""{TOP}, g as (select 10 as n_names union all select 15 union all select 20 union all select 30) select n_names, {r("avg(fwd)")} as mean_forward_return, {r("stddev_samp(fwd)")} as std_forward_return, count(fwd) as n_rows from tp cross join g where i <= n_names group by n_names""")

both("baseline_comparison", f"""{TOP}, a as (select trade_date, avg(case when i <= 15 then fwd end) as strategy, avg(fwd) as baseline from tp group by trade_date)
select count(strategy) as n_dates, {r("avg(strategy)")} as strategy, {r("avg(baseline)")} as baseline, {r("avg(strategy - baseline)")} as improvement, avg(strategy - baseline) > 0 as better from a""")

both("latest_signal", f"""{TOP}, l as (select max(trade_date) as last from tp) select tp.trade_date, tp.symbol, security_name, industry, {r("mom20")} as score, i as signal_rank from tp join l on tp.trade_date = l.last left join m on tp.symbol = m.symbol""", ("m",))

both("linear_fallback", f"""{", ".join([f"zz as (select trade_date, symbol, {', '.join(f'{z} as z_{f}' for f, z in _Z.items())} from p where {' and '.join(f'{f} is not null' for f in FEAT)})"])} select trade_date, symbol, {r("0.4 * coalesce(z_mom20, 0) + 0.2 * coalesce(z_rev5, 0) - 0.2 * coalesce(z_vol20, 0) + 0.2 * coalesce(z_liq5_20, 0)", 5)} as score from zz""")

both("model_validation", f"""sc as (select trade_date, symbol, (mom20 + rev5 + vol20 + liq5_20) / 4 as score, fwd from p where mom20 is not null and rev5 is not null and vol20 is not null and liq5_20 is not null and fwd is not null),
k as (select *, {rank_of("score", "trade_date")} as rx, {rank_of("fwd", "trade_date")} as ry from sc), di as (select trade_date, {pearson("rx", "ry")} as ic, avg(pow(score - fwd, 2)) as mse, count(*) as n from k group by trade_date)
select count(*) as n_dates, {r("avg(ic)")} as valid_rank_ic, {r("sqrt(sum(mse * n) / sum(n))", 5)} as rmse from di""")

both("feature_importance", f"""{RANKS} select factor, {r("avg(abs(ic))")} as mean_abs_ic, {r("avg(abs(ic)) / sum(avg(abs(ic))) over ()")} as share from ic group by factor""")

both("train_fill", f"""cut as (select percentile_cont(0.6) within group (order by datediff_(trade_date)) as upto from p), tr as (select percentile_cont(0.5) within group (order by mom20) as med, avg(vol20) as mu from p cross join cut where datediff_(trade_date) <= upto)
select trade_date, symbol, {r("coalesce(mom20, med)")} as mom20, mom20 is null as mom20_missing, {r("coalesce(vol20, mu)")} as vol20, vol20 is null as vol20_missing from p cross join tr""".replace("datediff_(trade_date)", "(year(trade_date) * 372 + month(trade_date) * 31 + day(trade_date))"))

both("support_factors", f"""s as (select stddev_pop(mom20) as sd, avg(mom20) as mu from p), z as (select trade_date, symbol, mom20 * liq5_20 as product, mom20 / (vol20 + 1e-8) as ratio, mom20 - rev5 as difference, (mom20 - mu) / nullif(sd, 0) as z,
  case when vol20 > 0.3 then rev5 else mom20 end as switch from p cross join s where mom20 is not null and rev5 is not null and vol20 is not null and liq5_20 is not null)
select trade_date, symbol, {r("product")} as product, {r("ratio", 4)} as ratio, {r("difference")} as difference, {r(rank_of("z", "1") + " / count(*) over ()")} as zscore_rank, {r("switch")} as regime_switch from z""")

both("guards", f"""k as (select trade_date, symbol, open, high, close, case when volume < 50 then -1e0 when volume < 100 then 0e0 else close end as a, case when volume % 7 = 0 then 0e0 else open end as b, cast('Infinity' as double) as inf from p)
select trade_date, symbol, {r("coalesce(case when a > 0 then a end, case when b > 0 then b end, case when high > 0 then high end)")} as first_valid, {r("case when abs(case when a = 0 then inf else a end) < inf then a end")} as finite, coalesce(a > 0, false) as priced from k""")

both("board_limits", f"""k as (select trade_date, symbol, lpad(cast(symbol as varchar(10)), 6, '0') as code from p)
select trade_date, symbol, upper(concat(code, case when symbol % 2 = 0 then '.sz' else '.sh' end)) as ticker, replace(code, '0', '') as stripped, case when symbol % 5 = 0 then 29.8e0 when symbol % 3 = 0 then case when trade_date >= date '1996-08-24' then 19.8e0 else 9.8e0 end when symbol % 17 = 0 then 4.8e0 else 9.8e0 end as limit_pct from k""")

both("demo_momentum", f"""k as (select symbol, trade_date, close / lag(close, 19) over (partition by symbol order by trade_date) - 1 as m20, close / lag(close, 59) over (partition by symbol order by trade_date) - 1 as m60, vol20, ret from p),
s as (select *, 0.65 * m20 + 0.35 * m60 - 0.15 * vol20 as score from k where m20 is not null and m60 is not null and vol20 is not null), dn as (select trade_date, row_number() over (order by trade_date) - 1 as n from (select distinct trade_date from s) x),
q as (select s.*, n, row_number() over (partition by s.trade_date order by score desc, symbol) as i from s join dn on s.trade_date = dn.trade_date)
select trade_date, symbol, {r("score", 5)} as score, 0.1e0 as weight from q where n % 20 = 0 and i <= 10""")

both("snapshot_members", f"""f as (select min(trade_date) as first from p), mem as (select distinct symbol from p join f on p.trade_date = f.first), ds as (select distinct trade_date from p)
select ds.trade_date, mem.symbol, p.close is not null as trades from ds cross join mem left join p on p.trade_date = ds.trade_date and p.symbol = mem.symbol""")

both("benchmark_filled", f"""{INDEX}, g as (select trade_date, case when (year(trade_date) * 372 + month(trade_date) * 31 + day(trade_date)) % 5 <> 0 then nav end as b, nav from ix), c as (select *, count(b) over (order by trade_date) as up, count(b) over (order by trade_date desc) as down from g)
select trade_date, {r("ln(coalesce(max(b) over (partition by up), max(b) over (partition by down)))", 5)} as log_benchmark from c""".replace("max(b) over (partition by up)", "case when up > 0 then max(b) over (partition by up) end"), ("ur",))

both("run_invariants", f"""{TOP}, c as (
select 'duplicate_keys' as invariant, count(*) - count(distinct concat(cast(trade_date as varchar(10)), '|', cast(symbol as varchar(10)))) as n_bad from p union all select 'price_not_positive', count(*) from p where not close > 0 union all
select 'high_below_low', count(*) from p where high < low union all select 'close_outside_range', count(*) from p where close > high or close < low union all select 'rank_gap', count(*) from (select trade_date from tp group by trade_date having max(i) <> count(*)) x union all
select 'empty_date', count(*) from (select trade_date from p group by trade_date having count(close) = 0) y union all select 'negative_volume', count(*) from p where volume < 0)
select invariant, n_bad, n_bad = 0 as holds from c""")

STATUTORY = "case when month(quarter) = 1 then make_date(year(quarter), 4, 30) when month(quarter) = 4 then make_date(year(quarter), 8, 31) when month(quarter) = 7 then make_date(year(quarter), 10, 31) else make_date(year(quarter) + 1, 4, 30) end"
both("statutory_dates", f"select nation, quarter, revenue, {STATUTORY} as due_date, case when month(quarter) = 1 then 'Q1' when month(quarter) = 4 then 'H1' when month(quarter) = 7 then 'Q3' else 'FY' end as report from fq", ("fq",))

_ASOF = f"""du as (select nation, quarter, revenue, {STATUTORY} as due from fq), de as (select *, lead(due) over (partition by nation order by quarter) as next_due, lag(revenue) over (partition by nation order by quarter) as before from du),
nm as (select p.symbol, p.trade_date, nation from p join m on p.symbol = m.symbol), aj as (select nm.symbol, nm.trade_date, de.quarter, de.due, de.revenue, de.before, row_number() over (partition by nm.symbol, nm.trade_date order by de.quarter desc) as k from nm join de on nm.nation = de.nation and de.due <= nm.trade_date)"""
both("lagged_fundamentals", f"{_ASOF} select symbol, trade_date, revenue, before as revenue_before, {r('revenue / nullif(before, 0) - 1', 5)} as growth from aj where k = 1", ("m", "fq"))

both("staleness", f"""{_ASOF}, s as (select symbol, trade_date, cast(trade_date - due as int) as age from aj where k = 1)
select symbol, trade_date, age, case when age <= 120 then 'fresh' when age <= 240 then 'stale' else 'expired' end as state, age > 240 as must_refresh from s""", ("m", "fq"))

both("leakage_check", f"""du as (select nation, quarter, revenue, {STATUTORY} as due from fq), nm as (select p.symbol, p.trade_date, nation from p join m on p.symbol = m.symbol),
na as (select nm.trade_date, du.due from nm join du on nm.nation = du.nation and du.quarter = cast(date_trunc('quarter', nm.trade_date) as date)) select count(*) as n_rows, sum(case when due > trade_date then 1 else 0 end) as n_leaking, {r("avg(case when due > trade_date then 1e0 else 0e0 end)")} as leaking_share from na""", ("m", "fq"))

both(
    "full_gate",
    f"""{RANKS}, {STRATEGY}, sv as (select trade_date, sret, sum(ln(1 + sret)) over (order by trade_date rows between unbounded preceding and current row) as ln_nav from sb),
sd as (select ln_nav - max(ln_nav) over (order by trade_date rows between unbounded preceding and current row) as ln_dd from sv), dn as (select trade_date, row_number() over (order by trade_date) as k from (select distinct trade_date from hd) x),
hk as (select symbol, k from hd join dn on hd.trade_date = dn.trade_date), tu as (select a.k, avg(case when b.symbol is null then 1e0 else 0e0 end) as t from hk a left join hk b on a.symbol = b.symbol and b.k = a.k - 1 where a.k > 1 group by a.k),
ye as (select year(trade_date) as y, sum(active) as a from sb group by year(trade_date)), va as (
select 'trade_count' as name, cast(count(*) as double) as value, 20e0 as threshold, 1 as sign from sb union all select 'ic', max(ic_mean), 0.02e0, 1 from st where factor = 'mom20' union all select 'ir', max(ic_ir), 0.15e0, 1 from st where factor = 'mom20' union all
select 'monotonicity', max(monotonicity), 0.6e0, 1 from ls where factor = 'mom20' union all select 'excess', avg(active) * 52, 0e0, 1 from sb union all select 'max_drawdown', 1 - exp(min(ln_dd)), 0.3e0, -1 from sd union all
select 'turnover', avg(t), 0.5e0, -1 from tu union all select 'yearly_wins', avg(case when a > 0 then 1e0 else 0e0 end), 0.6e0, 1 from ye union all select 'sharpe_increment', avg(sret) / nullif(stddev_samp(sret), 0) - avg(bret) / nullif(stddev_samp(bret), 0), 0e0, 1 from sb)
select name, {r("value", 5)} as value, threshold, coalesce(sign * value >= sign * threshold, false) as passed, value is null as skipped from va""",
    ("ur",),
)

both(
    "enhanced_risk",
    f"""{TOP}, w as (select tp.trade_date, tp.symbol, industry, volume, amount, 1e0 / 15 as w from tp join m on tp.symbol = m.symbol where i <= 15), g as (select trade_date, industry, sum(w) as iw from w group by trade_date, industry),
a as (select trade_date, count(*) as n, sum(w) as gross, sum(w * w) as hhi, min(amount) as thinnest from w group by trade_date), b as (select trade_date, max(iw) as top_industry from g group by trade_date),
c as (select a.*, top_industry, (case when n < 10 then 1 else 0 end) + (case when gross > 1.0001 then 1 else 0 end) + (case when hhi > 0.12 then 1 else 0 end) + (case when top_industry > 0.3 then 1 else 0 end) + (case when thinnest < 5000 then 1 else 0 end) as n_breaches from a join b on a.trade_date = b.trade_date)
select trade_date, n as n_names, {r("gross")} as gross, {r("hhi")} as concentration, {r("top_industry")} as top_industry, {r("thinnest", 2)} as thinnest, n_breaches, case when n_breaches = 0 then 'ok' when n_breaches <= 2 then 'warn' else 'critical' end as level, n_breaches >= 4 as emergency from c""",
    ("m",),
)

both("hashes", "select s_suppkey as symbol, s_name as security_name, md5(s_name) as name_md5, length(s_name) as n_characters from sup", ("sup",))

both(
    "adjusted_prices",
    """ev as (select symbol, trade_date, 1 + 0.01 * (volume % 3) as step from p where volume % 50 = 0), fa as (select symbol, trade_date, exp(sum(ln(step)) over (partition by symbol order by trade_date)) as factor from ev),
j as (select p.symbol, p.trade_date, p.close, fa.factor, row_number() over (partition by p.symbol, p.trade_date order by fa.trade_date desc) as k from p left join fa on p.symbol = fa.symbol and fa.trade_date <= p.trade_date)
select symbol, trade_date, round(coalesce(factor, 1e0) + 1e-9, 6) as adjust_factor, round(close * coalesce(factor, 1e0) + 1e-9, 4) as adjusted_close from j where k = 1""",
)

both("latest_known", """k as (select symbol, max_by(close, trade_date) as last_close, max(trade_date) as last_date from p group by symbol) select p.symbol, p.trade_date, round(p.close / k.last_close + 1e-9, 6) as of_last from p join k on p.symbol = k.symbol""")

both("month_spine", """mo as (select cast(date_trunc('month', trade_date) as date) as month, symbol, max_by(close, trade_date) as close from p group by 1, 2), sp as (select month from mo group by month), sy as (select symbol from mo group by symbol),
g as (select sy.symbol, sp.month, mo.close from sy cross join sp left join mo on mo.symbol = sy.symbol and mo.month = sp.month), c as (select *, count(close) over (partition by symbol order by month) as k from g)
select symbol, month, close is null as no_trade, round(max(close) over (partition by symbol, k) + 1e-9, 6) as month_end_close from c where k > 0""")
