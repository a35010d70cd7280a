"""Packing by optimal length buckets.

A histogram of all lengths is counted by Spark. Dynamic programming over it chooses `n_buckets` upper bounds that minimise
the padding when every row is padded to its bucket's bound. Inside a bucket, batches hold as many rows as the token
budget allows at the padded length; a row longer than the budget is a batch of its own.

The driver holds one number for each different length and no more: texts of D different lengths have D * (D - 1) / 2 words at
least, so D is below 7 million even for 2e13 words. The dynamic program runs over all of them, and takes D steps for a bucket.

Defined results: a null text has length 0. Rows of length 0 are packed like any other (a bucket bound is at least 1).
Rows with the same key are ranked by all of (hash, key, length) and each gets a place of its own. No rows give no batches.
Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, written


def n_words(text: Column) -> Column:
    """Words of the text: non-empty parts between blanks."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return F.size(F.array_remove(parts, "")).cast("bigint")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds, ascending, of the buckets with the least padding in total. lengths: ascending, all different.

    A bucket of lengths[i:j] pads lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i]). For each i that is a line
    in lengths[j - 1] with slope -rows[i], so the best i for every j comes from a hull of lines whose slopes fall and whose
    queries rise.
    """
    n = len(lengths)
    if n == 0:
        return []
    length = [int(x) for x in lengths]
    rows, tokens = [0], [0]
    for x, c in zip(length, counts.tolist(), strict=True):
        rows.append(rows[-1] + c)
        tokens.append(tokens[-1] + c * x)
    best: list[int | None] = [0] + [None] * n  # least padding of the first j lengths in as many buckets as rounds so far
    cuts = []
    for _ in range(min(n_buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        at, cut = 0, [0] * (n + 1)
        new: list[int | None] = [0] + [None] * n
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-rows[i], best[i] + tokens[i], i)
                while len(hull) > 1 and crosses_first(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = length[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - tokens[j]
            cut[j] = hull[at][2]
        cuts.append(cut)
        best = new
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(length[j - 1])
        j = cut[j]
        if j == 0:
            break
    return sorted(bounds)


def crosses_first(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether c is below a before b is: then b is never the lowest. Slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All different lengths, ascending, and how many rows have each."""
    got = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("length")
    return got["length"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def pack(
    docs: DataFrame, length: Column, key: str = "doc_id", n_buckets: int = 16, token_budget: int = 65536, shard_rows: int = 20000
) -> DataFrame:
    """key, length, bucket, padded_length, batch_id ("bucket:number"), slot, padding."""
    lengths = written(docs.select(F.col(key).alias("key"), length.cast("bigint").alias("length")), "lengths")
    different, counts = histogram(lengths)
    bounds = optimal_bounds(different, counts, n_buckets) or [0]
    shards = max(1, int(counts.sum()) // shard_rows)
    edge = [F.when(F.col("length") <= b, F.lit(i)) for i, b in enumerate(bounds)]
    placed = lengths.withColumn("bucket", F.coalesce(*edge)).withColumn("padded", F.greatest(F.lit(1), F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1)).cast("bigint"))
    # a place inside its bucket for every row, without gathering a bucket: rank in a shard, plus the rows of the shards before
    placed = placed.withColumn("mix", F.xxhash64("key", "length")).withColumn("shard", F.pmod("mix", F.lit(shards)).cast("int"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "bucket", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("mix", "key", "length")) - 1)
    at = ranked.join(before, ["bucket", "shard"]).withColumn("place", F.col("rank") + F.col("before"))
    fits = F.greatest(F.lit(1).cast("bigint"), F.expr(f"{int(token_budget)} div padded"))
    return at.select(
        F.col("key").alias(key),
        F.col("length"),
        F.col("bucket"),
        F.col("padded").alias("padded_length"),
        F.concat_ws(":", F.col("bucket"), F.floor(F.col("place") / fits)).alias("batch_id"),
        F.pmod(F.col("place"), fits).cast("bigint").alias("slot"),
        (F.col("padded") - F.col("length")).alias("padding"),
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, n_words(F.col("text")))
