"""Reports on a list of factors, all from one ranked table: a row a factor, date and name where factor and label are known.

`ranked` is the costly part; store it, and each report is an aggregation or two over it. What comes behind the first aggregation has a
row a factor and date at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross as X
from ..functions import rolling as V
from ..functions import windows as W
from ..functions.graphs import components
from ..functions.ranks import PARTS, global_ranks
from ..stored import stored
from . import research as R


def ranked(p: DataFrame, features: list[str], label: str = "fwd", kept: tuple[str, ...] = ()) -> DataFrame:
    """factor, trade_date, symbol, x, y, rx, ry (average ranks), i (first rank), n."""
    def body(t: V.Rows) -> dict[str, V.Vec]:
        y, made = t.col(label), {}
        for f in features:
            x = t.only(t.col(f), y)
            made[f"x|{f}"], (made[f"rx|{f}"], made[f"i|{f}"], made[f"n|{f}"]) = x, t.key_ranks(x)
            made[f"ry|{f}"] = t.key_ranks(t.only(y, x))[0]
        return made | {"y": y}

    names = ["y", *[f"{c}|{f}" for f in features for c in ("x", "rx", "ry", "i", "n")]]
    wide = V.over_rows(p, [*features, label], names, body, None, "trade_date", "symbol")  # a date's rows are sorted and ranked once, in one task
    each = [F.struct(F.lit(f).alias("factor"), *[F.col(f"`{c}|{f}`").alias(c) for c in ("x", "rx", "ry")], F.col(f"`i|{f}`").cast("int").alias("i"), F.col(f"`n|{f}`").cast("bigint").alias("n")) for f in features]
    long = wide.select("trade_date", "symbol", "y", F.explode(F.array(*each)).alias("z")).select("trade_date", "symbol", "y", "z.*").where("x is not null")
    return long.join(p.select("trade_date", "symbol", *kept), ["trade_date", "symbol"]) if kept else long


def ics(lr: DataFrame, least: int = 20) -> DataFrame:
    """factor, trade_date, ic on dates with enough names; dates without spread are out."""
    return lr.where(F.col("n") >= least).groupBy("factor", "trade_date").agg(W.pair_corr("rx", "ry").alias("ic")).where("ic is not null")


def by_bucket(lr: DataFrame, q: int = 5) -> DataFrame:
    """factor, bucket, y: the mean over dates of the buckets' mean labels."""
    bucket = F.greatest(F.lit(1), F.ceil((F.col("i") - 1) * float(q) / F.greatest(F.col("n") - 1, F.lit(1))).cast("int"))
    return lr.groupBy("factor", "trade_date", bucket.alias("bucket")).agg(F.avg("y").alias("y")).groupBy("factor", "bucket").agg(F.avg("y").alias("y"))


def spreads(lr: DataFrame, q: int = 5) -> DataFrame:
    return by_bucket(lr, q).groupBy("factor").agg((F.max_by("y", "bucket") - F.min_by("y", "bucket")).alias("long_short"), W.pair_corr(F.col("bucket").cast("double"), "y").alias("monotonicity"))


def summary(ic: DataFrame) -> DataFrame:
    x = F.col("ic")
    return ic.groupBy("factor").agg(
        F.count(x).alias("n_dates"), F.avg(x).alias("ic_mean"), F.stddev_samp(x).alias("ic_std"), W.ratio(F.avg(x), F.stddev_samp(x)).alias("ic_ir"), F.avg((x > 0).cast("double")).alias("win_rate")
    )


def yearly(ic: DataFrame) -> DataFrame:
    return ic.groupBy("factor", F.year("trade_date").alias("year")).agg(F.avg("ic").alias("ic"))


def factor_report(lr: DataFrame, costs: tuple[int, ...] = (5, 10, 20, 30, 50)) -> DataFrame:
    """Statistics of the IC, years, the spread before and after costs (basis points), and what to do with the factor."""
    ic = ics(lr)
    years = yearly(ic).groupBy("factor").agg(F.sum((F.col("ic") > 0).cast("int")).cast("bigint").alias("positive_years"), F.sum((F.col("ic") <= 0).cast("int")).cast("bigint").alias("negative_years"))
    x = summary(ic).join(years, "factor").join(spreads(lr), "factor")
    m, r, p = F.col("ic_mean"), F.col("ic_ir"), F.col("positive_years")
    advice = (
        F.when((m > 0.005) & (r > 0.1) & (p >= 4), "keep_strong").when((m > 0.002) & (r > 0.05) & (p >= 3), "keep_moderate").when((m > 0) & (p >= 2), "keep_weak")
        .when(F.col("long_short") > 0.005, "marginal_long_short").otherwise("reject")
    )
    return x.select("factor", "n_dates", "ic_mean", "ic_std", "ic_ir", "win_rate", "positive_years", "negative_years", "long_short", *[(F.col("long_short") - c * 1e-4).alias(f"net_{c}bp") for c in costs], advice.alias("recommendation"))


def signal_research(lr: DataFrame) -> DataFrame:
    """t, monotonicity, change of the yearly IC over one and two years, and a score from 0 to 100 with its name."""
    ic = ics(lr)
    w = Window.partitionBy("factor").orderBy("year")
    last = yearly(ic).withColumns({"d1": F.col("ic") - F.lag("ic").over(w), "d2": F.col("ic") - F.lag("ic", 2).over(w)}).groupBy("factor").agg(F.max_by("d1", "year").alias("d1"), F.max_by("d2", "year").alias("d2"))
    x = summary(ic).join(spreads(lr), "factor").join(last, "factor").fillna(0.0, ["d1", "d2"])
    between = lambda c, top: F.least(F.lit(float(top)), F.greatest(F.lit(0.0), c))
    m = F.col("ic_mean")
    score = between(m * 1000 + 10, 40) + between(F.col("ic_ir") * 50 + 10, 20) + between(F.col("monotonicity") * 20, 20) + F.when(F.col("d1") > -0.02, 20.0).otherwise(F.greatest(F.lit(0.0), 20 + F.col("d1") * 500))
    x = x.withColumns({"composite": score, "t_stat": W.ratio(m, F.col("ic_std") / F.sqrt("n_dates"))})
    advice = F.when((F.col("composite") >= 60) & (m > 0), "strong").when((F.col("composite") >= 40) & (m > 0), "moderate").when((F.col("composite") >= 20) & (m > 0), "weak").when(F.col("long_short") > 0.002, "marginal").otherwise("reject")
    return x.select("factor", "t_stat", "monotonicity", F.col("d1").alias("ic_decay_1y"), F.col("d2").alias("ic_decay_2y"), "composite", advice.alias("recommendation"))


def halves(lr: DataFrame) -> DataFrame:
    """The IC of the earlier and the later half of the dates."""
    w = Window.partitionBy("factor")
    late = F.row_number().over(w.orderBy("trade_date")) * 2 > F.count(F.lit(1)).over(w)
    x = ics(lr).withColumn("late", late).groupBy("factor").agg(F.avg(F.when(~F.col("late"), F.col("ic"))).alias("early_ic"), F.avg(F.when(F.col("late"), F.col("ic"))).alias("late_ic"), F.stddev_samp(F.when(F.col("late"), F.col("ic"))).alias("late_std"))
    e, a = F.col("early_ic"), F.col("late_ic")
    name = F.when(e * a < 0, "reversed").when(F.abs(a) < 0.5 * F.abs(e), "decayed").when(F.col("late_std") > 3 * F.abs(a), "unstable").otherwise("stable")
    return x.select("factor", "early_ic", "late_ic", W.ratio(a, e).alias("retention"), name.alias("degradation"))


def degradation(lr: DataFrame, since: int, cost: float = 0.0015, least_ic: float = 0.02, least_monotonicity: float = 0.6) -> DataFrame:
    """Three layers and their diagnosis. Signal: IC, its years, monotonicity. Portfolio: spread after cost, share of dates on which it is above 0.
    Exposure: the largest share of one year in the sum of yearly ICs. Each issue adds to a score, whose size names the kind of decay and what to do.
    `since`: years from this one on are the recent ones.
    """
    ic = ics(lr)
    y = yearly(ic)
    w = F.struct("year", "ic")
    years = y.groupBy("factor").agg(
        F.min(w).alias("first"), F.max(w).alias("last"), F.count(F.lit(1)).alias("n_years"), F.avg(F.when(F.col("year") >= since, F.col("ic"))).alias("recent_ic"), F.sum("ic").alias("total"), F.max("ic").alias("best")
    )
    bucket = F.greatest(F.lit(1), F.ceil((F.col("i") - 1) * 5.0 / F.greatest(F.col("n") - 1, F.lit(1))).cast("int"))
    daily = lr.withColumn("b", bucket).groupBy("factor", "trade_date").agg((F.avg(F.when(F.col("b") == 5, F.col("y"))) - F.avg(F.when(F.col("b") == 1, F.col("y")))).alias("ls"))
    wins = daily.where("ls is not null").groupBy("factor").agg(F.avg((F.col("ls") > 0).cast("double")).alias("spread_win_rate"))
    x = summary(ic).join(spreads(lr), "factor").join(years, "factor").join(wins, "factor", "left")
    m, net, trend = F.col("ic_mean"), F.col("long_short") - cost, F.col("last.ic") - F.col("first.ic")
    issues = {
        "trading": ((m > least_ic) & (net < 0), 30),
        "expression": ((F.col("recent_ic") < 0) & (m > 0), 25),
        "mechanism": ((F.col("n_years") >= 3) & (trend < -0.02), 40),
        "monotonicity": (F.col("monotonicity") < least_monotonicity, 20),
    }
    held = {k: F.coalesce(c, F.lit(False)) for k, (c, _) in issues.items()}
    score = sum(F.when(held[k], n).otherwise(0) for k, (_, n) in issues.items())
    kind = F.when(score >= 60, "economic_decay").when(score >= 40, "trading_decay").when(score >= 20, "expression_decay").when((m > 0) & (F.col("ic_ir") > 0), "healthy").otherwise("dead")
    x = x.withColumns({"net_return": net, "ic_trend": trend, "best_year_share": W.ratio(F.col("best"), F.col("total")), "score": score, "kind": kind, "issues": F.array_join(F.array_compact(F.array(*[F.when(h, k) for k, h in held.items()])), ",")})
    action = {"healthy": "keep", "expression_decay": "reformulate", "trading_decay": "reduce_weight", "economic_decay": "offline", "dead": "offline"}
    weight = {"healthy": 1.0, "expression_decay": 0.5, "trading_decay": 0.3, "economic_decay": 0.0, "dead": 0.0}
    of = lambda d: F.element_at(F.create_map(*[F.lit(v) for pair in d.items() for v in pair]), F.col("kind"))
    return x.select("factor", "ic_mean", "ic_ir", "monotonicity", "ic_trend", "recent_ic", "net_return", "spread_win_rate", "best_year_share", "issues", "score", "kind", of(action).alias("action"), of(weight).alias("target_weight"))


def snapshot(lr: DataFrame, spans: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Mean and population deviation of the last ICs."""
    x = ics(lr).withColumn("i", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("trade_date"))))
    last = lambda n: F.when(F.col("i") <= n, F.col("ic"))
    return x.groupBy("factor").agg(*[c for n in spans for c in (F.avg(last(n)).alias(f"mean_{n}"), F.stddev_pop(last(n)).alias(f"std_{n}"))])


def redundancy(p: DataFrame, ic: DataFrame, features: list[str], industry: str | None = None, threshold: float = 0.7, least_dates: int = 10, least_groups: int = 5) -> DataFrame:
    """factor_a, factor_b, value_corr, ic_corr, exposure_corr, mean_abs, redundant: how alike two factors are in values, in ICs over dates, and in their means by industry.

    One pass over the panel for all pairs of each kind. A correlation over too few dates or industries isn't known, and the mean is over those known.
    """
    value = R.correlations(p, features).withColumnRenamed("corr", "value_corr")
    wide = ic.groupBy("trade_date").pivot("factor", features).agg(F.first("ic"))
    known = {(a, b): F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) for i, a in enumerate(features) for b in features[i + 1 :]}
    over = R.correlations(wide, features).withColumnRenamed("corr", "ic_corr")
    n = wide.agg(*[c.alias(f"{a}|{b}") for (a, b), c in known.items()]).select(F.explode(F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"`{a}|{b}`").alias("n")) for a, b in known])).alias("z")).select("z.*")
    keys = ["factor_a", "factor_b"]
    both = value.join(over.join(n, keys), keys).withColumn("ic_corr", F.when(F.col("n") > least_dates, F.col("ic_corr")))
    if industry is not None:
        means = p.where(F.col(industry).isNotNull()).groupBy(industry).agg(*[F.avg(f).alias(f) for f in features])  # a row an industry
        enough = means.agg(F.count(F.lit(1)).alias("_g"))
        exposure = R.correlations(means, features).withColumnRenamed("corr", "exposure_corr").crossJoin(enough)
        both = both.join(exposure, keys).withColumn("exposure_corr", F.when(F.col("_g") > least_groups, F.col("exposure_corr")))
    else:
        both = both.withColumn("exposure_corr", F.lit(None).cast("double"))
    parts = [F.abs(c) for c in ("value_corr", "ic_corr", "exposure_corr")]
    mean = W.ratio(sum(F.coalesce(c, F.lit(0.0)) for c in parts), sum(c.isNotNull().cast("int") for c in parts).cast("double"))
    return both.select(*keys, "value_corr", "ic_corr", "exposure_corr", mean.alias("mean_abs"), F.coalesce(mean > threshold, F.lit(False)).alias("redundant"))


def groups(pairs: DataFrame, metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """factor, group_id, group_size, advice: factors tied by pairs over the threshold, however long the chain; each group keeps one.

    pairs: factor_a, factor_b, mean_abs. metrics: factor, ic_mean, and turnover where it counts: the least sum of the ranks of both stays, else the
    largest absolute IC; ties by name.
    """
    tied = components(pairs.where(F.col("mean_abs") > threshold), "factor_a", "factor_b").withColumnsRenamed({"node": "factor", "label": "group_id"})
    x = metrics.join(tied, "factor", "left").withColumn("group_id", F.coalesce("group_id", "factor"))
    w = Window.partitionBy("group_id")
    if "turnover" in metrics.columns:
        x = x.withColumn("_ic", -F.col("ic_mean")).withColumn("_order", X.average_rank("_ic", ("group_id",)) + X.average_rank("turnover", ("group_id",)))
    else:
        x = x.withColumn("_order", -F.abs("ic_mean"))
    best = F.row_number().over(w.orderBy("_order", "factor"))
    return x.select("factor", "group_id", F.count(F.lit(1)).over(w).alias("group_size"), F.when(best == 1, "keep").otherwise("remove").alias("advice"))


def pooled_ics(p: DataFrame, features: list[str], label: str, least: int = 30, parts: int = PARTS) -> DataFrame:
    """factor, n_rows, pearson_ic, spearman_ic over all rows where factor and label are known."""
    out = None
    for f in features:
        both = global_ranks(p.select(F.col(f).alias("x"), F.col(label).alias("y")).dropna(), ["x", "y"], parts)
        one = both.agg(F.lit(f).alias("factor"), F.count(F.lit(1)).alias("n_rows"), W.pair_corr("x", "y").alias("pearson_ic"), W.pair_corr("x_rank", "y_rank").alias("spearman_ic"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("n_rows") >= least)


def rank_correlations(p: DataFrame, features: list[str], parts: int = PARTS) -> DataFrame:
    """factor_a, factor_b, spearman over the rows where all factors are known."""
    x = global_ranks(p.select(*features).dropna(), features, parts)
    return R.correlations(x.select(*[F.col(f"{f}_rank").alias(f) for f in features]), features).withColumnRenamed("corr", "spearman")


def normality(df: DataFrame, column: str, limit: float = 5.99) -> DataFrame:
    """n, skew, excess_kurtosis and whether a Jarque-Bera test lets the column pass for normal: one row, from one aggregation."""
    x = df.where(F.col(column).isNotNull()).agg(F.count(column).alias("n"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("excess_kurtosis"))
    return x.withColumn("normal", F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("excess_kurtosis") ** 2 / 4) < limit)


def by_regime(p: DataFrame, regimes: DataFrame, features: list[str], label: str, regime: str = "trend_regime", least: int = 50, parts: int = PARTS) -> DataFrame:
    """factor, the regime, n_rows, spearman over all rows of the regime's dates; those of more than `least` rows. regimes: trade_date and its regime, of few."""
    both = stored(p.select("trade_date", *features, label).where(F.col(label).isNotNull()).join(regimes, "trade_date").select(regime, *features, F.col(label).alias("y")), "regimes")
    out = None
    for f in features:  # two columns travel for each, not all of them
        x = global_ranks(both.select(regime, F.col(f).alias("x"), "y").where("x is not null"), ["x", "y"], parts, by=regime)
        one = x.groupBy(regime).agg(F.count(F.lit(1)).alias("n_rows"), W.pair_corr("x_rank", "y_rank").alias("spearman")).select(F.lit(f).alias("factor"), regime, "n_rows", "spearman")
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("n_rows") > least)


def marginal(p: DataFrame, features: list[str], label: str) -> DataFrame:
    """factor, ic_change (of the mean of all z-scores against that of the others), diversity_change, turnover_change, score, recommendation.

    A date's rows are ranked once, in the task that has them; they are read again by name, for what a factor moves.
    """
    k = len(features)

    def body(t: V.Rows) -> dict[str, V.Vec]:
        z = {f: t.key_zscore(f) for f in features}
        whole = sum(z[f] for f in features) / k
        y = t.key_ranks(t.only(t.col(label), whole))[0]
        made = {f"z_{f}": z[f] for f in features} | {"iw": t.key_corr(t.key_ranks(whole)[0], y)}
        for f in features:
            without = t.only(sum(z[g] for g in features if g != f) / (k - 1), whole)
            made[f"io_{f}"] = t.key_corr(t.key_ranks(without)[0], y)
        return made

    known = p.where(" and ".join(f"{c} is not null" for c in (*features, label)))
    rows = stored(V.over_rows(known, [*features, label], ["iw", *[f"{c}_{f}" for f in features for c in ("z", "io")]], body, None, "trade_date", "symbol"), "zscored")
    of = lambda c: F.array(*[F.struct(F.lit(f).alias("factor"), c(f)) for f in features])
    ics = rows.agg(F.avg("iw").alias("iw"), *[F.avg(f"io_{f}").alias(f"io_{f}") for f in features]).select("iw", F.explode(of(lambda f: F.col(f"io_{f}").alias("io"))).alias("z"))
    name = Window.partitionBy("symbol").orderBy("trade_date")
    whole = rows.where(" and ".join(f"z_{f} is not null" for f in features))
    moved = whole.select(*[F.abs(F.col(f"z_{f}") - F.lag(f"z_{f}").over(name)).alias(f"m_{f}") for f in features]).agg(*[F.avg(f"m_{f}").alias(f"m_{f}") for f in features])
    moved = moved.select(F.explode(of(lambda f: F.col(f"m_{f}").alias("turnover"))).alias("z")).select("z.*")
    pool = moved.agg(F.avg("turnover").alias("pool"))
    corr = R.correlations(rows.select(*[F.col(f"z_{f}").alias(f) for f in features]), features)
    pairs = stored(corr.select("factor_a", "factor_b", F.abs("corr").alias("c")), "pairs")  # a row a pair
    names = rows.sparkSession.createDataFrame([(f,) for f in features], "factor string")
    mean = lambda c, n: F.when(F.count(c) == n, F.sum(c) / n)
    out = (F.col("factor") != F.col("factor_a")) & (F.col("factor") != F.col("factor_b"))
    diversity = names.crossJoin(pairs).groupBy("factor").agg((mean(F.when(out, F.col("c")), (k - 1) * (k - 2) // 2) - mean(F.col("c"), k * (k - 1) // 2)).alias("diversity"))
    all_of = ics.select("z.factor", (F.col("iw") - F.col("z.io")).alias("ic_change")).join(diversity, "factor").join(moved, "factor").crossJoin(pool)  # a row a factor
    more = F.col("turnover") - F.col("pool")
    score = 10 * F.col("ic_change") + 5 * F.col("diversity") - more
    advice = F.when(score > 0.5, "ADD").when(score > 0, "CONDITIONAL_ADD").when(score > -0.5, "WATCH").otherwise("REJECT")
    return all_of.select("factor", "ic_change", F.col("diversity").alias("diversity_change"), (more / 100).alias("turnover_change"), score.alias("score"), advice.alias("recommendation"))


def neutral_variants(p: DataFrame, x: str, label: str, industry: str, size: str, other: str, q: int = 5, least: int = 3) -> DataFrame:
    """variant, n_dates, mean_ic, ir of x as it is, and less its date's means by industry (a number from 0), by size bucket, by both. Means and buckets are of all rows
    with x, rank ICs of those with `other` and the label. A date's rows are worked on once, in the task that has them."""
    variants = ["raw", "industry", "size", "both"]

    def body(t: V.Rows, dates: pa.Array, symbols: pa.Array) -> list[pa.Array]:
        v, s = t.col(x), t.col(size)
        _, first, n = t.key_ranks(V.Vec(np.where(s.ok, s.v, -np.inf), np.ones(len(s.ok), bool)))  # unknown sizes come first
        bucket = np.minimum(q, np.ceil(first.v * float(q) / n.v)).astype(np.int64) - 1
        by_industry = v - t.key_mean(v, t.col(industry).v.astype(np.int64))
        made = [v, by_industry, v - t.key_mean(v, bucket), by_industry - t.key_mean(by_industry, bucket)]
        y = t.only(t.col(label), t.col(other))
        ry = t.key_ranks(y)[0]
        ics = [t.key_corr(t.key_ranks(t.only(t.rounded(m, 9), y))[0], ry, least) for m in made]
        rows = np.bincount(t.numbers(), y.ok)
        at = t.begins[rows >= least]
        take = lambda ic: pa.array(ic.v[at], pa.float64(), mask=~ic.ok[at])
        return [dates.take(pa.array(at)), *map(take, ics)]

    kind = p.schema["trade_date"].dataType.simpleString()
    schema = f"trade_date {kind}, " + ", ".join(f"`{c}` double" for c in variants)
    rows = V.over_rows(p.where(F.col(x).isNotNull()), [x, label, industry, size, other], ["trade_date", *variants], body, None, "trade_date", "symbol", schema=schema)
    ic = rows.unpivot(["trade_date"], variants, "variant", "ic")
    return ic.groupBy("variant").agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("mean_ic"), W.ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ir"))
