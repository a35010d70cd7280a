"""Exact ranks over a whole table, without a task that sees all of it.

Approximate quantiles cut each column's values into cells; how many rows lie in each cell is counted exactly, in one pass for all
columns, so a row's rank is what lies in the cells below plus its rank inside its cell. A value that fills cells by itself is a
cell of its own: its rows share one rank, which the counts give, and are dealt out at random. What the driver holds are the cells:
`parts` for each column, whatever the table's size.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def _cells(df: DataFrame, columns: list[str], parts: int, by: str | None) -> dict[str, list[tuple[object, list[float], set[float]]]]:
    """For each column, by group: the group, its different cuts, and those values that are more than one cut."""
    shares = [k / parts for k in range(1, parts)]
    rows = df.groupBy(*[by] * (by is not None)).agg(*[F.percentile_approx(c, shares, 100 * parts).alias(f"_{c}") for c in columns]).collect()
    out = {}
    for c in columns:
        of = [(r[by] if by else None, [x for x in r[f"_{c}"] or [] if x == x]) for r in rows]
        out[c] = [(g, sorted(set(cuts)), {x for x in cuts if cuts.count(x) > 1}) for g, cuts in of]
    return out


def _code(x: Column, cuts: list[float], hot: set[float]) -> Column:
    """Even codes are the values up to a cut, the odd one behind it is the cut itself where it is hot; codes ascend with values."""
    if not cuts:
        return F.when(x.isNotNull(), 0)
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < x))
    is_hot = x.isin(*hot) if hot else F.lit(False)
    return F.when(x.isNotNull(), 2 * below + F.when(is_hot, 1).otherwise(0))


def _coded(x: Column, kind: str, cells: list[tuple[object, list[float], set[float]]], by: str | None) -> Column:
    """Codes of all groups, one group's after the other's. Doubles are looked up in batches, which takes a fraction of the time."""
    if kind == "double":

        @F.pandas_udf("int")
        def looked_up(x: pd.Series, group: pd.Series) -> pd.Series:
            v, out, start = x.to_numpy(float), np.zeros(len(x), np.int32), 0
            for g, cuts, hot in cells:
                on = np.ones(len(v), bool) if by is None else (group.isna() if g is None else group == g).to_numpy(bool)
                below, ends = np.searchsorted(cuts, v[on]), np.array([*cuts, np.nan])
                is_hot = np.array([c in hot for c in cuts] + [False])
                out[on] = start + 2 * below + (is_hot[below] & (ends[below] == v[on]))
                start += 2 * len(cuts) + 2
            return pd.Series(out)

        return F.when(x.isNotNull(), looked_up(x, F.lit(0) if by is None else F.col(by)))
    out, start = F.lit(None).cast("int"), 0
    for g, cuts, hot in cells:
        code = _code(x, cuts, hot) + start
        out = code if by is None else F.when(F.col(by).eqNullSafe(F.lit(g)), code).otherwise(out)
        start += 2 * len(cuts) + 2
    return out


def global_ranks(df: DataFrame, columns: list[str], parts: int = PARTS, least: bool = False, by: str | None = None) -> DataFrame:
    """df with `<column>_rank`: from 1, ties averaged, null for nulls; and `<column>_least`, the least rank of a tie, if asked for.

    df is read three times: store it first where it is costly. Each column takes one exchange, of as many tasks as there are cells.
    by: ranks within each of a few large groups, each with cells of its own.
    """
    cells = _cells(df, columns, parts, by)
    codes = {c: _coded(F.col(c), df.schema[c].dataType.simpleString(), cells[c], by) for c in columns}
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), codes[c].alias("code")) for i, c in enumerate(columns)])).alias("z"))
    counted = {(r["i"], r["code"]): r["count"] for r in each.select("z.*").where("code is not null").groupBy("i", "code").count().collect()}
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    for i, c in enumerate(columns):
        n, before = [], []
        for _, cuts, _ in cells[c]:
            own = [counted.get((i, len(n) + k), 0) for k in range(2 * len(cuts) + 2)]
            n, before = n + own, before + [0, *accumulate(own)][:-1]
        of = lambda values, code: F.element_at(F.array(*map(F.lit, values)), code + 1)
        df = df.withColumn("_code", codes[c])
        alone = F.col("_code").isNull() | (F.col("_code") % 2 == 1)  # its rank needs no other row
        w = Window.partitionBy("_code", "_salt")
        df = df.withColumn("_salt", F.when(alone, salt).otherwise(F.lit(0)))
        up, down = F.rank().over(w.orderBy(c)), F.rank().over(w.orderBy(F.desc(c)))
        inside = F.when(alone, (of(n, F.col("_code")) + 1) / 2.0).otherwise((up + of(n, F.col("_code")) + 1 - down) / 2.0)
        found = {f"{c}_rank": F.when(F.col("_code").isNotNull(), of(before, F.col("_code")) + inside)}
        if least:
            found[f"{c}_least"] = F.when(F.col("_code").isNotNull(), of(before, F.col("_code")) + F.when(alone, F.lit(1)).otherwise(up))
        df = df.withColumns(found).drop("_code", "_salt")
    return df


def percentile(df: DataFrame, column: str, q: float, most: int = 1 << 16) -> float | None:
    """The exact interpolated percentile, as percentile_cont gives it. No task holds the column: approximate quantiles close in on the place
    until at most `most` rows lie between (or one value), which come to the driver. df is read a few times: store it first.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = x.count()
    if n == 0:
        return None
    place = (n - 1) * q
    i = int(place)
    wanted = [i, min(i + 1, n - 1)]
    below, inside, size = 0, x, n
    while size > most:
        at = [max(0.0, min(1.0, (w - below + d) / size)) for w, d in ((wanted[0], -0.0005 * size), (wanted[1], 0.0005 * size + 1))]
        lo, hi = inside.agg(F.percentile_approx("x", at, 10000)).first()[0]
        under, now = inside.agg(F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi))).first()
        if not below + under <= wanted[0] <= wanted[1] < below + under + now:
            raise ArithmeticError("approximate quantiles missed their place")
        if lo == hi:
            return lo
        if now == size:  # few values, most of them often: one row a value
            seen, values = below, []
            for r in inside.groupBy("x").count().orderBy("x").collect():
                values += [r["x"]] * sum(seen <= w < seen + r["count"] for w in dict.fromkeys(wanted))
                seen += r["count"]
            break
        inside, below, size = inside.where(F.col("x").between(lo, hi)), below + under, now
    else:
        rows = sorted(r["x"] for r in inside.collect())
        values = [rows[w - below] for w in dict.fromkeys(wanted)]
    return values[0] + (values[-1] - values[0]) * (place - i)


def value_bucket(least_rank: Column, n: int, q: int) -> Column:
    """1 to q: between which of the interpolated quantiles a value lies, upper ends included, told from its least rank alone.

    A quantile at place h = (n - 1) k / q lies between two values of the table in order; a value is above it if its place,
    from 0, is above h's whole part.
    """
    return F.lit(1) + sum((least_rank - 1 > F.lit((n - 1) * k // q)).cast("int") for k in range(1, q))
