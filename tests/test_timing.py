"""As-of and interval joins, fundamentals in two times, components, files by symbol, rolling sums, and what plans read."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import windows as W
from quantloom.functions.graphs import components
from quantloom.operators import asof, fundamentals, reports
from quantloom.plans import all_queries
from quantloom.sources import files

# as-of


def day(i):
    return (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date()


@pytest.mark.parametrize(("cut", "strict"), [("month", False), ("year", True), ("week", False)])
def test_as_of_equals_a_search(spark, cut, strict):
    g = random.Random(cut)
    right = [("hot" if g.random() < 0.7 else f"k{g.randrange(4)}", day(g.randrange(900)), g.randrange(100), g.randrange(10)) for _ in range(120)] + [("k0", None, 5, 1), (None, day(3), 5, 1)]
    left = [(i, "hot" if g.random() < 0.7 else f"k{g.randrange(5)}", day(g.randrange(900))) for i in range(400)] + [(400, None, day(5)), (401, "hot", None)]
    l, r = spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "k string, d date, v int, o int")
    got = {x["i"]: x["v"] for x in asof.as_of(l, r, "k", "d", ["v"], cut=cut, order=["o", "v"], strict=strict).collect()}
    assert len(got) == len(left)
    for i, k, d in left:
        known = [(t, o, v) for key, t, v, o in right if k is not None and d is not None and key == k and t is not None and (t < d if strict else t <= d)]
        assert got[i] == (max(known)[2] if known else None)
    assert asof.as_of(l.limit(0), r, "k", "d", ["v"]).count() == 0 and asof.as_of(l, r.limit(0), "k", "d", ["v"]).where("v is null").count() == len(left)


def test_as_of_has_no_inequality_join_and_splits_a_key(spark):
    l = spark.range(100).select(F.lit("hot").alias("k"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("d"))
    r = l.withColumn("v", F.lit(1))
    plan = asof.as_of(l, r, "k", "d", ["v"], cut="month")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan
    assert "_stretch" in plan


def test_intervals(spark):
    spans = spark.createDataFrame([("a", day(10), day(20), 1), ("a", day(20), day(30), 2), ("a", day(400), None, 3), ("b", day(5), day(6), 4)], "k string, lo date, hi date, n int")
    left = spark.createDataFrame([(k, day(i)) for k in "abc" for i in (0, 5, 6, 10, 19, 20, 29, 30, 399, 400, 900)], "k string, d date")
    got = sorted((r["k"], r["d"], r["n"]) for r in asof.in_interval(left, spans, "k", "d", "lo", "hi", ["n"]).collect())
    assert got == [("a", day(10), 1), ("a", day(19), 1), ("a", day(20), 2), ("a", day(29), 2), ("a", day(400), 3), ("a", day(900), 3), ("b", day(5), 4)]


# fundamentals


def versions(spark):
    q1, q2 = pd.Timestamp("2020-01-01").date(), pd.Timestamp("2020-04-01").date()
    rows = [(1, q1, day(119), 1, 10.0), (1, q1, day(300), 2, 14.0), (1, q2, day(243), 1, 20.0), (1, q2, day(320), 2, 26.0)]
    return spark.createDataFrame(rows, "nation int, quarter date, published date, version int, revenue double")


def test_known_on_a_day(spark):
    asked = spark.createDataFrame([(1, day(i)) for i in (0, 118, 119, 242, 243, 300, 319, 320, 900)] + [(2, day(900))], "nation int, d date")
    got = {(r["nation"], r["d"]): (r["revenue"], r["version"]) for r in fundamentals.known_on(asked, versions(spark), "nation", "d", ["revenue"]).collect()}
    want = {0: None, 118: None, 119: 10.0, 242: 10.0, 243: 20.0, 300: 20.0, 319: 20.0, 320: 26.0, 900: 26.0}
    assert {d: got[1, day(d)][0] for d in want} == want and got[2, day(900)] == (None, None)
    late = fundamentals.known_on(asked, versions(spark), "nation", "d", ["revenue"], lag=5)
    assert {r["d"]: r["revenue"] for r in late.where("nation = 1").collect()}[day(119)] is None


def test_audit_shows_what_a_naive_join_leaks(spark):
    asked = spark.createDataFrame([(1, day(i)) for i in (5, 100, 150)], "nation int, d date")
    got = {r["d"]: r for r in fundamentals.timing_audit(asked, versions(spark), "nation", "d", "revenue").collect()}
    assert (got[day(5)]["leak"], got[day(5)]["naive_value"], got[day(5)]["known_value"], got[day(5)]["days_early"]) == ("not_out", 14.0, None, 295)
    assert (got[day(100)]["leak"], got[day(100)]["naive_value"]) == ("not_out", 26.0)
    assert (got[day(150)]["leak"], got[day(150)]["known_value"]) == ("not_out", 10.0)
    q = spark.createDataFrame([(1, pd.Timestamp("2020-01-01").date(), day(20), 1, 1.0), (1, pd.Timestamp("2020-01-01").date(), day(60), 2, 2.0)], "nation int, quarter date, published date, version int, revenue double")
    leaks = {r["d"]: r["leak"] for r in fundamentals.timing_audit(spark.createDataFrame([(1, day(i)) for i in (10, 30, 60)], "nation int, d date"), q, "nation", "d", "revenue").collect()}
    assert leaks == {day(10): "not_out", day(30): "restated", day(60): None}


# components


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_stars_and_random_graphs(spark, seed):
    g = random.Random(seed)
    names = list(range(300))
    g.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[100], names[i]) for i in range(101, 140)] + [(g.choice(names[150:]), g.choice(names[150:])) for _ in range(90)] + [(names[5], None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_a_chain_of_twenty_factors_is_one_group(spark):
    pairs = spark.createDataFrame([(f"f{i:02}", f"f{i + 1:02}", 0.9) for i in range(19)] + [("g", "h", 0.5)], "factor_a string, factor_b string, mean_abs double")
    metrics = spark.createDataFrame([(f"f{i:02}", 0.01 * i, 1.0) for i in range(20)] + [("g", 0.0, 1.0), ("h", 0.5, 2.0)], "factor string, ic_mean double, turnover double")
    got = {r["factor"]: (r["group_id"], r["group_size"], r["advice"]) for r in reports.groups(pairs, metrics.drop("turnover")).collect()}
    assert all(got[f"f{i:02}"] == ("f00", 20, "keep" if i == 19 else "remove") for i in range(20)) and got["g"] == ("g", 1, "keep")
    by_both = reports.groups(pairs, metrics.withColumn("turnover", F.when(F.col("factor") == "f18", 0.0).otherwise(F.lit(1.0))))
    assert {r["factor"] for r in by_both.where("group_size = 20 and advice = 'keep'").collect()} == {"f18"}
    assert reports.groups(pairs.limit(0), metrics).where("advice = 'keep'").count() == 22


# files


def test_files_by_symbol_with_a_torn_and_a_wider_one(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for name, frame in {
        "sz_1_indicator": pd.DataFrame({"pub_date": ["2020-01-01"], "eps": [1.0]}),
        "sh_600000": pd.DataFrame({"pub_date": ["2020-01-02"], "eps": [2.0], "roe": [0.1]}),
        "plain": pd.DataFrame({"pub_date": ["x"], "eps": [9.0]}),
    }.items():
        frame.to_parquet(d / f"{name}.parquet")
    whole = (d / "sh_600000.parquet").read_bytes()
    (d / "sz_2_indicator.parquet").write_bytes(whole[: len(whole) // 2])
    (d / "sz_3.parquet").write_bytes(b"")
    rows, bad = files.symbol_files(spark, str(d))
    got = {r["symbol"]: (r["eps"], r["roe"], r["source_file"].rsplit("/", 1)[1]) for r in rows.collect()}
    assert got == {"000001.SZ": (1.0, None, "sz_1_indicator.parquet"), "600000.SH": (2.0, 0.1, "sh_600000.parquet")}
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in bad.collect()}
    assert problems.keys() == {"plain.parquet", "sz_2_indicator.parquet", "sz_3.parquet"} and problems["plain.parquet"] == "no symbol in the file's name"
    (d / "sh_600000.parquet").unlink()
    (d / "sz_1_indicator.parquet").unlink()
    rows, bad = files.symbol_files(spark, str(d))
    assert rows.count() == 0 and bad.count() == 3


# rolling sums


@pytest.mark.parametrize("odd", [1e17, float("inf"), float("nan")])
def test_a_large_or_infinite_value_leaves_nothing_behind(spark, odd):
    x = [1.0, odd, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(1, day(i), v) for i, v in enumerate(x)], "symbol int, trade_date date, x double")
    got = df.select("trade_date", W.mean("x", 2).alias("m"), W.total("x", 3).alias("t"), W.std("x", 2).alias("s")).orderBy("trade_date").collect()
    assert [r["m"] for r in got[3:]] == [1.0] * 3 and [r["t"] for r in got[4:]] == [3.0] * 2 and [r["s"] for r in got[3:]] == [0.0] * 3
    assert got[0]["m"] is None and got[1]["t"] is None


# plans


@pytest.mark.parametrize("name", ["redundancy_groups", "full_gate", "factor_roles", "factor_report", "marginal_contribution", "redundancy", "signal_research", "factor_groups"])
def test_no_query_scans_the_order_lines_more_than_three_times(spark, sf, name):
    plan = all_queries()[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 3


@pytest.mark.parametrize("name", ["rank_correlations", "pooled_ic", "support_factors", "normality", "incremental_factors"])
def test_no_task_sees_the_whole_panel(spark, sf, name):
    """A single partition may follow a partial aggregation only: then it holds a row a task."""
    plan = all_queries()[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(plan):
        if "SinglePartition" in line:
            assert any("partial_" in x or "Aggregate" in x for x in plan[i + 1 : i + 5]), plan[i : i + 5]


def test_medians_and_ages_are_in_days(spark):
    df = spark.createDataFrame([(pd.Timestamp("2021-02-28").date(), pd.Timestamp("2021-03-01").date())], "a date, b date")
    assert df.select(asof.age_in_days("b", "a")).first()[0] == 1
