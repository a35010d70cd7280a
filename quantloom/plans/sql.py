"""The same derivations in plain SQL, from which the statements that check the queries are built."""

from __future__ import annotations

DAILY = """lines as (
  select l_suppkey as symbol, cast(l_shipdate as date) as trade_date, l_extendedprice / l_quantity as p, l_quantity as q, l_extendedprice as x,
    row_number() over (partition by l_suppkey, cast(l_shipdate as date) order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as i,
    row_number() over (partition by l_suppkey, cast(l_shipdate as date) order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc, l_quantity desc) as j
  from lineitem),
daily as (
  select symbol, trade_date, max(case when i = 1 then p end) as open, max(p) as high, min(p) as low, max(case when j = 1 then p end) as close,
    sum(q) as volume, round(sum(x), 2) as amount
  from lines group by symbol, trade_date)"""

WEEKLY = (
    DAILY
    + """,
weeks as (
  select *, cast(date_trunc('week', trade_date) as date) as week,
    row_number() over (partition by symbol, date_trunc('week', trade_date) order by trade_date) as i,
    row_number() over (partition by symbol, date_trunc('week', trade_date) order by trade_date desc) as j
  from daily),
weekly as (
  select symbol, week as trade_date, max(case when i = 1 then open end) as open, max(high) as high, min(low) as low,
    max(case when j = 1 then close end) as close, sum(volume) as volume, round(sum(amount), 2) as amount
  from weeks group by symbol, week)"""
)


def bars(grain: str) -> str:
    return DAILY if grain == "daily" else WEEKLY


def over(n: int) -> str:
    return f"(partition by symbol order by trade_date rows between {n - 1} preceding and current row)"


ORDER = "(partition by symbol order by trade_date)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over {ORDER}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) over {ORDER}"


def full(n: int, x: str, agg: str) -> str:
    """agg is a call with its argument, e.g. avg(c)."""
    return f"(case when count({x}) over {over(n)} = {n} then {agg} over {over(n)} end)"


def mean(x: str, n: int) -> str:
    return full(n, x, f"avg({x})")


def std(x: str, n: int) -> str:
    return full(n, x, f"stddev_samp({x})")


def total(x: str, n: int) -> str:
    return full(n, x, f"sum({x})")


def highest(x: str, n: int) -> str:
    return full(n, x, f"max({x})")


def lowest(x: str, n: int) -> str:
    return full(n, x, f"min({x})")


def quantile(x: str, n: int, q: float) -> str:
    return full(n, x, f"quantile_cont({x}, {q})")


def pct(x: str, k: int) -> str:
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def running(x: str) -> str:
    return f"sum({x}) over (partition by symbol order by trade_date rows between unbounded preceding and current row)"


DAY = "(partition by trade_date)"


def average_rank(x: str, by: str = "trade_date") -> str:
    return f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0)"


def processed(name: str, x: str, source: str) -> str:
    """Three named tables: winsorized, filled, z-scored; the last is called `name`."""
    return f"""{name}_w as (
  select *, case when {x} is null or count({x}) over {DAY} < 3 then {x}
    else greatest(least({x}, quantile_cont({x}, 0.99) over {DAY}), quantile_cont({x}, 0.01) over {DAY}) end as {x}_w from {source}),
{name}_f as (select *, coalesce({x}_w, quantile_cont({x}_w, 0.5) over {DAY}, 0.0) as {x}_f from {name}_w),
{name} as (select *, case when coalesce(stddev_pop({x}_f) over {DAY}, 0) <= 1e-12 then 0.0
    else ({x}_f - avg({x}_f) over {DAY}) / stddev_pop({x}_f) over {DAY} end as {x}_z from {name}_f)"""
