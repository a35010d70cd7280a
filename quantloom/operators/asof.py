"""As-of and interval joins by union and carry: no inequality join, and no key whose history must fit one task.

Both sides are put one after the other, dealt by key and stretch of time. Inside a stretch the last value that is known goes forward; what is known at
the end of each stretch is a table of one row a key and stretch, from which a stretch takes what came before it. A key with very many rows so
lies in as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str | list[str], at: str, values: list[str], right_at: str | None = None, cut: str = "quarter", order: list[str] | None = None, strict: bool = False) -> DataFrame:
    """left with `values` of the latest row of right at or before (strict: before) its date, by key; null where there is none.

    Of right's rows with one key and date the last by `order` counts. Rows of left with a null key or date find nothing. `cut` is the stretch, as date_trunc
    takes it: the shorter it is, the more tasks a key may take.
    """
    keys, right_at = [by] if isinstance(by, str) else by, right_at or at
    known = right.where(F.col(right_at).isNotNull())
    last = F.struct(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(order or [])], *[F.col(v) for v in values])
    known = known.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.max(last).alias("_known")) if order else known.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.any_value(last).alias("_known"))
    stretch = lambda c: F.date_trunc(cut, c)
    # what is known when a stretch begins: the last of the stretches before it
    ends = known.groupBy(*keys, stretch("_at").alias("_stretch")).agg(F.max_by("_known", "_at").alias("_end"))
    asked = left.select(*keys, stretch(F.col(at)).alias("_stretch")).distinct()
    spans = asked.join(ends, [*keys, "_stretch"], "full")
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    start = spans.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    side = F.lit(1 if strict else 0)
    both = left.withColumns({"_at": F.col(at), "_side": F.lit(0 if strict else 1), "_asks": F.lit(True)}).unionByName(
        known.select(*keys, "_at", "_known").withColumns({"_side": side, "_asks": F.lit(False)}), allowMissingColumns=True
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_stretch", stretch("_at")).withColumn("_known", F.last("_known", ignorenulls=True).over(inside)).where("_asks")
    told = told.join(start, [*keys, "_stretch"], "left").withColumn("_known", F.coalesce("_known", "_start"))
    known_key = F.col(at).isNotNull()
    for k in keys:
        known_key = known_key & F.col(k).isNotNull()
    return told.select(*left.columns, *[F.when(known_key, F.col("_known")[v]).alias(v) for v in values])


def in_interval(left: DataFrame, intervals: DataFrame, by: str | list[str], at: str, start: str, end: str, values: list[str], cut: str = "quarter") -> DataFrame:
    """left's rows whose date lies in [start, end) of an interval of their key, with its values. A key's intervals must not overlap; an open end is null."""
    found = as_of(left, intervals.select(*([by] if isinstance(by, str) else by), F.col(start).alias("_from"), F.col(end).alias("_to"), *values).withColumn("_in", F.lit(True)), by, at, [*values, "_to", "_in"], "_from", cut)
    return found.where(F.col("_in") & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))).drop("_to", "_in")


def age_in_days(at: str | Column, since: str | Column) -> Column:
    return F.datediff(at, since)
