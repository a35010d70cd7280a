"""Walk-forward scores. With i the number of a signal date and h the horizon, only dates before i - h may teach."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import pair_corr

def dates():
    return Window.partitionBy("feature").orderBy("trade_date")


def simple_average(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("score", sum(F.col(f) for f in features) / len(features))


def feature_ics(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Pearson by date and feature, in one pass over the panel; 0 without spread."""
    known = df.where(F.col(label).isNotNull())
    one = known.groupBy("trade_date").agg(*[pair_corr(f, label).alias(f) for f in features], F.count(F.lit(1)).alias("n")).where("n >= 2")
    long = one.unpivot(["trade_date"], features, "feature", "ic")
    return long.withColumn("ic", F.when(F.col("ic").isNull() | F.isnan("ic"), 0.0).otherwise(F.col("ic")))


def ic_weights(ics: DataFrame, horizon: int = 20, lookback: int = 60, floor: float = 0.001) -> DataFrame:
    """Mean IC over the `lookback` dates that end h + 2 dates before, floored and normalised by date."""
    w = dates().rowsBetween(-(horizon + 1 + lookback), -(horizon + 2))
    raw = ics.withColumn("w", F.greatest(F.coalesce(F.avg("ic").over(w), F.lit(floor)), F.lit(floor)))
    return raw.select("trade_date", "feature", (F.col("w") / F.sum("w").over(Window.partitionBy("trade_date"))).alias("weight"))


def adaptive_weights(ics: DataFrame, horizon: int = 20, lookback: int = 120, half_life: float = 20.0, floor: float = 0.05) -> DataFrame:
    """As above, with weights that halve every `half_life` dates."""
    w = dates().rowsBetween(-(horizon + 1 + lookback), -(horizon + 2))
    number = F.row_number().over(dates())
    rows = ics.withColumn("k", number).withColumn("e", F.exp(F.col("k") * (float(np.log(2.0)) / half_life)))
    mean = F.sum(F.col("ic") * F.col("e")).over(w) / F.sum("e").over(w)
    raw = rows.withColumn("w", F.greatest(F.coalesce(mean, F.lit(floor)), F.lit(floor)))
    return raw.select("trade_date", "feature", (F.col("w") / F.sum("w").over(Window.partitionBy("trade_date"))).alias("weight"))


def weighted_scores(df: DataFrame, weights: DataFrame, features: list[str]) -> DataFrame:
    """The dot product of features and the date's weights; a date without weights takes equal ones."""
    wide = weights.groupBy("trade_date").pivot("feature", features).agg(F.first("weight"))
    wide = wide.select("trade_date", *[F.col(f).alias(f"w_{f}") for f in features])
    score = sum(F.col(f) * F.coalesce(F.col(f"w_{f}"), F.lit(1.0 / len(features))) for f in features)
    return df.join(F.broadcast(wide), "trade_date", "left").withColumn("score", score).drop(*[f"w_{f}" for f in features])


def moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """By date: n, sums, and products of features and label. Training windows are sums of these; rows aren't read again."""
    cols = [*features, label]
    known = df.where(F.col(label).isNotNull())
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return known.groupBy("trade_date").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("s"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("p")
    )


def ridge_coefficients(df: DataFrame, features: list[str], label: str, horizon: int = 20, window: int = 120, alpha: float = 1.0, least: int = 50) -> DataFrame:
    """trade_date, intercept, beta (array, on raw features), n: ridge on standardised features by running moments."""
    per_date = moments(df, features, label).withColumn("day_no", F.row_number().over(Window.orderBy("trade_date")))
    w = Window.orderBy("trade_date").rowsBetween(-(horizon + window), -(horizon + 1))  # one row a date
    add = lambda c, k: F.array(*[F.sum(F.col(c)[i]).over(w) for i in range(k)])
    m = len(features) + 1
    summed = per_date.select("trade_date", F.sum("n").over(w).alias("n"), add("s", m).alias("s"), add("p", m * (m + 1) // 2).alias("p")).where(F.col("n") >= least)
    k = len(features)

    def solve(batches):
        for b in batches:
            out = []
            for t, n, s, p in zip(b["trade_date"], b["n"], b["s"], b["p"], strict=True):
                s, gram = np.asarray(s) / n, np.zeros((m, m))
                gram[np.triu_indices(m)] = np.asarray(p) / n
                gram = gram + np.triu(gram, 1).T - np.outer(s, s)
                sd = np.sqrt(np.maximum(np.diag(gram)[:k], 0)) + 1e-8
                z = gram[:k, :k] / np.outer(sd, sd) + np.eye(k) * alpha / n
                beta = np.linalg.solve(z, gram[:k, k] / sd) / sd
                out.append((t, float(s[k] - beta @ s[:k]), beta.tolist(), int(n)))
            yield pd.DataFrame(out, columns=["trade_date", "intercept", "beta", "n"])

    return summed.repartition("trade_date").mapInPandas(solve, "trade_date date, intercept double, beta array<double>, n bigint")


def ridge_scores(df: DataFrame, features: list[str], label: str, **how) -> DataFrame:
    """Scores by the date's ridge; the simple average where too few rows could teach, with fallback_used."""
    coef = ridge_coefficients(df, features, label, **how).drop("n")
    dot = sum(F.col(f) * F.col("beta")[i] for i, f in enumerate(features)) + F.col("intercept")
    out = df.join(F.broadcast(coef), "trade_date", "left").withColumn("fallback_used", F.col("beta").isNull())
    return out.withColumn("score", F.coalesce(dot, sum(F.col(f) for f in features) / len(features))).drop("beta", "intercept")
