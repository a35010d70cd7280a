"""Fundamentals in two times: the period that a figure is of, and the day from which it was known, restatements included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ratio
from .asof import as_of


def statutory(quarter: str | Column) -> Column:
    """The day by which the report of a quarter (its first day) must be out."""
    q = F.col(quarter) if isinstance(quarter, str) else quarter
    m, y = F.month(q), F.year(q)
    return F.when(m == 1, F.make_date(y, F.lit(4), F.lit(30))).when(m == 4, F.make_date(y, F.lit(8), F.lit(31))).when(m == 7, F.make_date(y, F.lit(10), F.lit(31))).otherwise(F.make_date(y + 1, F.lit(4), F.lit(30)))


def reports(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """nation, quarter, published, version and figures, from orders: what a nation's customers ordered in a quarter.

    The first version is out on the statutory day and holds what had been shipped by then; what is shipped later is a restatement half a year after it. So a
    figure that is known today wasn't known then.
    """
    o = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("nation"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter"))
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("shipped")).agg(F.sum("l_extendedprice").alias("gross"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.sum("l_quantity").alias("units"))
    x = o.join(lines, "o_orderkey").withColumn("due", statutory("quarter"))
    first = F.col("shipped") <= F.col("due")
    figures = lambda c, name: [F.sum(F.when(first, F.col(c))).alias(f"{name}_1"), F.sum(c).alias(f"{name}_2")]
    by = x.groupBy("nation", "quarter").agg(F.max("due").alias("due"), *figures("gross", "gross"), *figures("net", "revenue"), *figures("units", "units"))
    version = lambda i, published: by.select("nation", "quarter", published.alias("published"), F.lit(i).alias("version"), *[F.round(f"{c}_{i}", 4).alias(c) for c in ("gross", "revenue", "units")])
    one, two = version(1, F.col("due")), version(2, F.add_months("due", 6))
    return one.unionByName(two).where("revenue is not null")


def calculated(reported: DataFrame) -> DataFrame:
    """Margins and growth of each version, growth against the year before as it was known when the version came out."""
    margins = reported.withColumns({"margin": ratio(F.col("revenue"), F.col("gross")), "price": ratio(F.col("gross"), F.col("units")), "_of": F.add_months("quarter", -12)})
    earlier = reported.select("nation", F.col("quarter").alias("_of"), "published", F.col("revenue").alias("revenue_before"), F.col("units").alias("units_before"))
    both = as_of(margins, earlier, ["nation", "_of"], "published", ["revenue_before", "units_before"], cut="year")
    return both.withColumns({"revenue_growth": ratio(F.col("revenue"), F.col("revenue_before")) - 1, "units_growth": ratio(F.col("units"), F.col("units_before")) - 1}).drop("_of")


def known_on(left: DataFrame, reported: DataFrame, by: str, at: str, values: list[str], lag: int = 0) -> DataFrame:
    """left with the figures of the newest quarter that was out `lag` days before its date, in the version that was out by then.

    Versions that came out before a newer quarter's first, or bring an older quarter after it, are passed over for the newer quarter.
    """
    out = reported.withColumn("_out", F.date_add("published", lag))
    # of what is out on a day, the newest quarter counts, then the newest version: a running maximum by publication, one row a version
    w = Window.partitionBy(by).orderBy("_out", "quarter", "version").rowsBetween(Window.unboundedPreceding, 0)
    best = out.withColumn("_best", F.max(F.struct("quarter", "version", "published", *values)).over(w))
    newest = best.groupBy(by, "_out").agg(F.max("_best").alias("_best")).select(by, "_out", *[F.col("_best")[c].alias(c) for c in ("quarter", "version", "published", *values)])
    return as_of(left, newest, by, at, ["quarter", "version", "published", *values], "_out", cut="year")


def timing_audit(left: DataFrame, reported: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """What a naive join on the quarter of the date would leak: each such row, with what was known instead.

    leak: `not_out` (no version of that quarter was out), `restated` (out, but the value joined is a later version's), or null where nothing leaks.
    """
    final = reported.groupBy(by, "quarter").agg(F.max_by(F.struct(F.col(value).alias("v"), F.col("published").alias("p")), "version").alias("_last"), F.min("published").alias("first_out"))
    naive = left.withColumn("quarter", F.to_date(F.date_trunc("quarter", at))).join(final, [by, "quarter"]).select(*left.columns, "quarter", F.col("_last.v").alias("naive_value"), F.col("_last.p").alias("naive_out"), "first_out")
    held = known_on(naive.withColumnRenamed("quarter", "naive_quarter"), reported, by, at, [value]).withColumnsRenamed({"quarter": "known_quarter", value: "known_value"})
    leak = F.when(F.col(at) < F.col("first_out"), "not_out").when(F.col(at) < F.col("naive_out"), "restated")
    return held.select(*left.columns, "naive_quarter", "naive_value", "known_quarter", "known_value", leak.alias("leak"), F.greatest(F.lit(0), F.datediff("naive_out", at)).alias("days_early"))
