"""Factors less what any number of styles explains of them on each date.

The normal equations of a date are summed up on Spark in one pass, for any width, and solved in Arrow batches of dates. Styles are
taken in by pivots, the one with the largest share of its own variance left first; one that the others explain is left out, so
collinear styles neither blow up nor depend on rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pool import moments


def solved(product: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, list[int]]:
    """Coefficients of the last column on the others from centred products, and which of them were taken in."""
    k = len(product) - 1
    scale = np.sqrt(np.maximum(np.diag(product)[:k], 0))
    scale[scale == 0] = 1.0
    g = product[:k, :k] / np.outer(scale, scale)
    left, rows, taken = np.diag(g).copy(), np.zeros((0, k)), []
    while len(taken) < k:
        i = int(np.argmax(np.where(np.isin(np.arange(k), taken), -1.0, left)))
        if left[i] <= tolerance:
            break
        row = (g[i] - rows[:, i] @ rows) / np.sqrt(left[i])
        rows, left = np.vstack([rows, row]), left - row**2
        taken.append(i)
    beta = np.zeros(k)
    if taken:
        lower = rows[:, taken].T  # g[taken, taken] = lower @ lower.T
        beta[taken] = np.linalg.solve(lower @ lower.T, product[taken, k] / scale[taken]) / scale[taken]
    return beta, sorted(taken)


def style_coefficients(df: DataFrame, y: str, styles: list[str], least: int = 50, by: str = "trade_date") -> DataFrame:
    """by, n, intercept, beta, taken (numbers of the styles that entered), for dates with at least `least` rows where all is finite."""
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    whole = df
    for c in (*styles, y):
        whole = whole.where(F.coalesce(finite(c), F.lit(False)))
    columns, k = [*styles, y], len(styles)
    sums = moments(whole.select(by, *[F.col(c).cast("double").alias(c) for c in columns]), columns, by).where(F.col("n") >= least)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for date, n, mean, product in zip(b[by], b["n"], b["mean"], b["product"], strict=True):
                beta, taken = solved(np.asarray(product).reshape(k + 1, k + 1))
                out.append((date, n, float(mean[k] - beta @ np.asarray(mean)[:k]), beta.tolist(), taken))
            yield pd.DataFrame(out, columns=[by, "n", "intercept", "beta", "taken"])

    return sums.mapInPandas(solve, f"{by} {df.schema[by].dataType.simpleString()}, n bigint, intercept double, beta array<double>, taken array<int>")


def style_neutral(df: DataFrame, y: str, styles: list[str], out: str | None = None, least: int = 50, by: str = "trade_date") -> DataFrame:
    """df with `out`: y less its fit on the date's styles. Rows with an unknown style, and dates with too few whole rows, keep y as it is."""
    fit = style_coefficients(df, y, styles, least, by).select(by, F.col("intercept").alias("_i"), F.col("beta").alias("_b"))
    explained = F.col("_i") + sum((F.col("_b")[i] * F.col(s) for i, s in enumerate(styles)), F.lit(0.0))
    rest = F.col(y) - explained
    return df.join(fit, by, "left").withColumn(out or f"{y}_neutral", F.when(F.abs(rest) < float("inf"), rest).otherwise(F.col(y))).drop("_i", "_b")
