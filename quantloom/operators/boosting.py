"""Gradient-boosted trees, walk-forward: all folds grow in step, one aggregation a level.

Rows are binned once by each fold's own training quantiles and stored. For each level of each round, a task runs the trees so far over
its rows, and adds up residuals and counts by fold, node, feature and bin; these sums, whose size doesn't depend on the rows, are
merged on Spark, and the best splits are chosen from them. Validation error comes with the same pass; a fold that hasn't improved for
some rounds grows no more, and its best round is kept. Squared loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cross as X
from ..stored import drop, stored
from . import panel as P

TRAIN, VALID, TEST = 0, 1, 2
#: A block of rows of one fold and role: labels, and codes feature after feature.
BLOCKS = "fold int, role int, y binary, codes binary"
#: Rows of a block, and blocks that travel at once.
BLOCK, AT_ONCE = 1 << 14, 32


@dataclass(frozen=True)
class Settings:
    rounds: int = 30
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    least_leaf: int = 20
    penalty: float = 1.0
    patience: int = 5
    least_rows: int = 200
    least_dates: int = 20


@dataclass
class Tree:
    """Node i has the children 2 i + 1 and 2 i + 2; feature is -1 in a leaf. Codes up to `cut` go left."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = (2 << self.depth) - 1
        self.feature, self.cut, self.value = np.full(n, -1), np.zeros(n, int), np.zeros(n)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """Where each row ends so far."""
        at = np.zeros(len(codes), np.min_scalar_type(len(self.feature)))
        for i in np.flatnonzero(self.feature >= 0).tolist():  # parents come before their children
            right = codes[:, self.feature[i]] > self.cut[i]
            at = np.where(at == i, right + at.dtype.type(2 * i + 1), at)
        return at


@dataclass
class Fold:
    base: float
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)  # of validation, with 0, 1, ... trees
    growing: bool = True

    def predicted(self, codes: np.ndarray, most: int | None = None) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for t in self.trees[:most]:
            out += t.value[t.nodes(codes)]
        return out

    def kept(self) -> int:
        """The round with the least validation error; all rounds where nothing validates."""
        return int(np.argmin(self.errors)) if self.errors else len(self.trees)


def best_split(count: np.ndarray, total: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """Gain, feature and cut from sums by feature and bin, the first of equals; None where no split gains."""
    n, g = count.sum(1)[:, None], total.sum(1)[:, None]
    nl, gl = np.cumsum(count, axis=1), np.cumsum(total, axis=1)
    nr, gr = n - nl, g - gl
    gain = gl**2 / (nl + s.penalty) + gr**2 / (nr + s.penalty) - g**2 / (n + s.penalty)
    gain = np.where((nl >= s.least_leaf) & (nr >= s.least_leaf), gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else None


def sums_of(rows: DataFrame, folds: dict[int, Fold], level: int, n_features: int, bins: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By fold: sums (2, nodes of the level, features, bins) of counts and residuals, and (squared errors, rows) of validation.

    The trees being grown are the last ones. Their size bounds what is sent and what comes back.
    """
    first, nodes = (1 << level) - 1, 1 << level
    size = 2 * nodes * n_features * bins

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, role, y, raw in b[["fold", "role", "y", "codes"]].itertuples(index=False):
                if fold not in folds:
                    continue
                model, y = folds[fold], np.frombuffer(y, float)
                codes = np.frombuffer(raw, np.uint8).reshape(n_features, len(y)).T
                into = held.setdefault(fold, np.zeros(size + 2))
                rest = y - model.predicted(codes, len(model.trees) - 1)
                if role == VALID:
                    into[-2:] += (rest**2).sum(), len(rest)
                    continue
                at = model.trees[-1].nodes(codes).astype(np.int64) - first
                if level:
                    here = at >= 0
                    at, rest, codes = at[here], rest[here], codes.T[:, here].T
                counts, totals = into[:size].reshape(2, nodes, n_features, bins)
                for i in range(n_features):
                    cell = at * bins + codes[:, i]
                    counts[:, i] += np.bincount(cell, minlength=nodes * bins).reshape(nodes, bins)
                    totals[:, i] += np.bincount(cell, rest, nodes * bins).reshape(nodes, bins)
        if held:
            yield pd.DataFrame({"fold": list(held), "sums": list(held.values())})

    # validation errors are asked for at the first level only
    parts = rows.where(F.col("role") <= (TRAIN if level else VALID)).mapInPandas(summed, "fold int, sums array<double>")
    merged = parts.groupBy("fold").applyInPandas(lambda g: pd.DataFrame({"fold": [g["fold"].iloc[0]], "sums": [np.sum(np.stack(g["sums"].to_numpy()), axis=0)]}), "fold int, sums array<double>")
    return {r["fold"]: (np.asarray(r["sums"][:-2]).reshape(2, nodes, n_features, bins), np.asarray(r["sums"][-2:])) for r in merged.collect()}


def grown(rows: DataFrame, bases: dict[int, float], n_features: int, s: Settings) -> tuple[dict[int, Fold], dict[int, np.ndarray]]:
    """Trees of each fold, and the gain of each feature in the rounds that are kept."""
    folds = {f: Fold(base) for f, base in bases.items()}
    gains: dict[int, list[np.ndarray]] = {f: [] for f in folds}
    for turn in range(s.rounds + 1):
        live = {f: m for f, m in folds.items() if m.growing}
        if not live:
            break
        for m in live.values():
            m.trees.append(Tree(s.depth))
        for f in live:
            gains[f].append(np.zeros(n_features))
        for level in range(s.depth):
            found = sums_of(rows, live, level, n_features, s.bins)
            for f, model in list(live.items()):
                if f not in found:
                    model.growing = False
                    continue
                (count, total), (errors, n_valid) = found[f]
                if level == 0 and n_valid:
                    model.errors.append(errors / n_valid)
                    model.growing = len(model.errors) - 1 - int(np.argmin(model.errors)) < s.patience
                if level == 0 and turn == s.rounds:
                    model.growing = False  # the last pass only validates
                if not model.growing:
                    model.trees.pop()
                    gains[f].pop()
                    del live[f]
                    continue
                tree, first = model.trees[-1], (1 << level) - 1
                for node in range(1 << level):
                    i = first + node
                    n, g = count[node, 0].sum(), total[node, 0].sum()
                    if n == 0:
                        continue
                    tree.value[i] = s.rate * g / (n + s.penalty)
                    split = best_split(count[node], total[node], s)
                    if split is None:
                        continue
                    gain, feature, cut = split
                    gains[f][-1][feature] += gain
                    tree.feature[i], tree.cut[i] = feature, cut
                    left = count[node, feature, : cut + 1].sum(), total[node, feature, : cut + 1].sum()
                    for child, (m, h) in ((2 * i + 1, left), (2 * i + 2, (n - left[0], g - left[1]))):
                        tree.value[child] = s.rate * h / (m + s.penalty)
            if not live:
                break
        for f, model in live.items():
            if (model.trees[-1].feature < 0).all():  # nothing gains any more
                model.growing = False
    return folds, {f: np.sum(gains[f][: m.kept()], axis=0) if gains[f][: m.kept()] else np.zeros(n_features) for f, m in folds.items()}


def fold_dates(dates: list, signals: list, train: int, valid: int, horizon: int, embargo: int = 0) -> list[tuple]:
    """(date, fold, role): a fold's label is known before its signal date, so training and validation end `horizon + embargo` dates before it."""
    place, out = {d: i for i, d in enumerate(dates)}, []
    for k, signal in enumerate(signals):
        end = place[signal] - horizon - embargo + 1
        if end <= 0:
            continue
        start = max(0, end - valid)
        out += [(d, k, TRAIN) for d in dates[max(0, start - train - (valid <= 0)) : start]]
        out += [(d, k, VALID) for d in dates[start:end]] + [(signal, k, TEST)]
    return out


@dataclass
class Boosted:
    """scores: trade_date, symbol, score, fallback_used. importance: factor, gain. metrics: a row a signal date. models: the trees by fold."""

    scores: DataFrame
    importance: DataFrame
    metrics: DataFrame
    models: dict[int, Fold]
    cuts: dict[int, list[list[float]]]


def walk_forward(df: DataFrame, features: list[str], label: str, signals: list, train: int = 120, valid: int = 20, horizon: int = 20, embargo: int = 0, fallback: str | None = None, settings: Settings = Settings()) -> Boosted:
    """df: trade_date, symbol, features, label. signals: the dates to score. Rows without a feature take no part; nor do those without a
    label in training and validation. Where too few rows or dates teach, or all scores of a date are equal, the z-score of `fallback` (the first feature)
    stands in. What the driver holds: dates, and for each fold its cuts, trees and sums.
    """
    spark, s = df.sparkSession, settings
    finite = [F.abs(F.col(f).cast("double")) < float("inf") for f in features]
    df = df.select("trade_date", "symbol", *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("y"))
    for c in finite:
        df = df.where(F.coalesce(c, F.lit(False)))
    df = stored(df, "dataset")
    dates = sorted(r["trade_date"] for r in df.select("trade_date").distinct().collect())  # a row a date
    signals = [d for d in signals if d in set(dates)]
    roles = spark.createDataFrame(fold_dates(dates, signals, train, valid, horizon, embargo), f"trade_date {df.schema['trade_date'].dataType.simpleString()}, fold int, role int")
    dealt = df.join(roles, "trade_date").where((F.col("role") == TEST) | (F.abs("y") < float("inf")))
    shares = [k / s.bins for k in range(1, s.bins)]
    training = dealt.where(F.col("role") == TRAIN)
    # by itself, as it would have the quantiles taken of each date first
    days = {r["fold"]: r["count"] for r in training.select("fold", "trade_date").distinct().groupBy("fold").count().collect()}
    of_fold = training.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base"), *[F.percentile_approx(f, shares, 10_000).alias(f"_{i}") for i, f in enumerate(features)]).collect()
    taught = {r["fold"]: r for r in of_fold if r["n"] >= s.least_rows and days[r["fold"]] >= s.least_dates}
    cuts = {f: [sorted(set(r[f"_{i}"])) for i in range(len(features))] for f, r in taught.items()}

    def codes_of(own: pd.DataFrame, fold: int) -> np.ndarray:
        """Feature after feature."""
        return np.stack([np.searchsorted(cuts[fold][i], own[f].to_numpy(float)) for i, f in enumerate(features)]).astype(np.uint8)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple[int, int], int] = {}

        def block(key: tuple[int, int]) -> pd.DataFrame:
            y, codes = zip(*held.pop(key), strict=True)
            del sizes[key]
            return pd.DataFrame({"fold": [key[0]], "role": [key[1]], "y": [np.concatenate(y).tobytes()], "codes": [np.concatenate(codes, axis=1).tobytes()]})

        for b in batches:
            for (fold, role), own in b.groupby(["fold", "role"]):
                if fold in cuts:
                    held.setdefault((fold, role), []).append((own["y"].to_numpy(float), codes_of(own, fold)))
                    sizes[fold, role] = sizes.get((fold, role), 0) + len(own)
            over = sum(sizes.values()) > 16 * BLOCK
            for key in [k for k, n in sizes.items() if over or n >= BLOCK]:
                yield block(key)
        for key in list(held):
            yield block(key)

    keys = f"trade_date {df.schema['trade_date'].dataType.simpleString()}, symbol {df.schema['symbol'].dataType.simpleString()}"
    rows = stored(dealt.where(F.col("role") < TEST).select("fold", "role", "y", *features).mapInPandas(blocks, BLOCKS), "binned", block=8 << 20)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(AT_ONCE))
    try:
        models, gains = grown(rows, {f: r["base"] for f, r in taught.items()}, len(features), s)
    finally:
        spark.conf.set(name, before)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["fold"].isin(list(cuts))].reset_index(drop=True)
            score = np.zeros(len(b))
            for fold, own in b.groupby("fold"):
                score[own.index] = models[fold].predicted(codes_of(own, fold).T, models[fold].kept())
            yield b[["trade_date", "symbol", "fold", "role", "y"]].assign(score=score)

    told = stored(dealt.where(F.col("role") > TRAIN).mapInPandas(scored, f"{keys}, fold int, role int, y double, score double"), "scored")
    drop(rows)
    test = told.where(F.col("role") == TEST)
    spread = test.groupBy("fold").agg((F.max("score") > F.min("score")).alias("spread")).where("spread").select("fold")
    signal_folds = roles.where(F.col("role") == TEST).select("trade_date", "fold")
    plain = df.join(signal_folds, "trade_date").withColumn("f", X.zscored(fallback or features[0])).select("trade_date", "symbol", "fold", "f")
    good = test.join(spread, "fold", "left_semi").select("trade_date", "symbol", "score")
    scores = plain.join(good, ["trade_date", "symbol"], "left")
    scores = scores.select("trade_date", "symbol", F.coalesce("score", "f").alias("score"), F.col("score").isNull().alias("fallback_used"))
    checked = told.where(F.col("role") == VALID).withColumn("trade_date", F.col("fold"))  # one pool of rows a fold, as its IC is
    ic = P.rank_ic(checked, "score", "y").select(F.col("trade_date").alias("fold"), F.col("rank_ic").alias("valid_rank_ic"))
    error = checked.groupBy("fold").agg(F.count(F.lit(1)).alias("valid_rows"), F.sqrt(F.avg((F.col("y") - F.col("score")) ** 2)).alias("valid_rmse"))
    size = spark.createDataFrame([(r["fold"], r["n"], r["fold"] not in taught) for r in of_fold], "fold int, train_rows bigint, fallback_used boolean")
    kept = spark.createDataFrame([(f, m.kept()) for f, m in models.items()], "fold int, rounds int")
    metrics = signal_folds.join(size, "fold", "left").join(kept, "fold", "left").join(error, "fold", "left").join(ic, "fold", "left")
    metrics = metrics.select(F.col("trade_date").alias("signal_date"), F.coalesce("train_rows", F.lit(0)).alias("train_rows"), "rounds", "valid_rows", "valid_rank_ic", "valid_rmse", F.coalesce("fallback_used", F.lit(True)).alias("fallback_used"))
    mean = np.mean(list(gains.values()), axis=0) if gains else np.zeros(len(features))
    importance = spark.createDataFrame([(f, float(g)) for f, g in zip(features, mean, strict=True)], "factor string, gain double")
    return Boosted(scores, importance, metrics, models, cuts)


def tree_text(model: Fold, cuts: list[list[float]], features: list[str]) -> list[str]:
    """The kept trees in words, for a report."""
    out = []
    for k, t in enumerate(model.trees[: model.kept()]):
        for i in np.flatnonzero(t.feature >= 0):
            edges = cuts[t.feature[i]]
            at = edges[t.cut[i]] if t.cut[i] < len(edges) else float("inf")
            out.append(f"tree {k} node {i}: {features[t.feature[i]]} <= {at:.6g}")
    return out


