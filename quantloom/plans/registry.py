"""Every query of the reference's own operators, with the SQL that gives the same rows (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import factors
from ..sources import market

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None):
    def keep(f: Callable[..., DataFrame]):
        QUERIES[name] = (f, sql)
        return f

    return keep


for _category in ("momentum", "reversal", "volatility", "liquidity", "technical", "distribution", "pattern"):
    QUERIES[f"factors_{_category}"] = (
        lambda spark, d, category=_category: factors.family(market.daily_bar(spark, d), category),
        factors.family_sql(_category),
    )
