"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of pivots, nearest first. It is posted in the inverted files of its `n_files` nearest of
`n_pivots` pivots. A query meets the vectors that stand in `shared` or more of the files of its own nearest pivots, ranks them by the
footrule distance of the orders of the first `n_ranked` pivots, and reranks the best of them by the exact distance: `extra`, and a
share `rerank` of all vectors of the block. These don't depend on the table's size. The pivots are the one thing fitted:
`n_pivots` vectors, those with the least hashes (fewer in smaller tables). A query that finds fewer than k vectors that way is
answered by all rows.

Equal vectors are one entry of the index, with the k + 1 smallest of their ids: no larger one can be among the k
nearest of any query. Entries lie in blocks of bounded size. The index is a table with a row for each block: its vectors, inverted
files and orders. Distinct query vectors lie in blocks of their own; a task holds one of each.

Defined results: vectors that are null, zero, or have null, NaN or infinite components take no part, nor do vectors of
another dimension than the most frequent one (the smaller of several), nor rows with a null id. Rows that repeat an id and a
vector count once for each. Where there are fewer than k candidates all are returned; an empty table gives no rows. Ties go
to the smaller id. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, QUERY_BLOCK = 16384, 4096
FOUND = "query_class bigint, distance double, members array<bigint>"
INDEX = "block int, vectors binary, members array<array<bigint>>, posted binary, starts binary, places binary"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return kept.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances less what is the same for all pivots."""
    return (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T


def files_of(vectors: np.ndarray, pivots: np.ndarray, n_files: int) -> np.ndarray:
    """The nearest pivots of each vector, as a set: the files that it is posted in."""
    n_files = min(n_files, len(pivots))
    return np.argpartition(distances(vectors, pivots), n_files - 1, axis=1)[:, :n_files]


def places_of(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Which place each pivot has in a vector's order, nearest first; ties to the first pivot."""
    order = np.argsort(distances(vectors, pivots), axis=1, kind="stable")
    place = np.empty(order.shape, np.int16)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int16)[None], 1)
    return place


def inverted(near: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """The files one after the other, and where each begins."""
    by_pivot = np.argsort(near.ravel(), kind="stable")
    starts = np.searchsorted(near.ravel()[by_pivot], np.arange(n_pivots + 1))
    return (by_pivot // near.shape[1]).astype(np.int32), starts.astype(np.int64)


def met(posted: np.ndarray, starts: np.ndarray, files: np.ndarray, n: int, shared: int) -> np.ndarray:
    """Rows that stand in `shared` or more of these files."""
    rows = np.concatenate([posted[starts[f] : starts[f + 1]] for f in files])
    return np.flatnonzero(np.bincount(rows, minlength=n) >= min(shared, len(files)))


def closest(vectors: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of these rows the k nearest, or all ties of the k-th too, and their exact distances."""
    distance = np.sqrt(((vectors[rows] - q) ** 2).sum(1))
    if len(rows) > k:
        keep = distance <= np.partition(distance, k - 1)[k - 1]
        rows, distance = rows[keep], distance[keep]
    return rows, distance


def nearest(
    rows: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    n_pivots: int = 2048,
    n_files: int = 64,
    shared: int = 4,
    n_ranked: int = 128,
    rerank: float = 0.05,
    extra: int = 100,
) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on column `id`."""
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    wide = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = wide[0]["dim"] if wide else 0
    good = good.where(F.size("v") == dim)
    first = Window.partitionBy("v").orderBy("id")
    few = good.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumn("cls", F.col("members")[0]), "vectors")
    n = classes.count()
    pivots = np.array([r["v"] for r in classes.orderBy(F.xxhash64("v"), "cls").limit(n_pivots).collect()], np.float64).reshape(-1, max(dim, 1))
    asked = written(good.where(is_query).select("id", "v").join(classes.select("v", "cls"), "v").select("id", "cls"), "asked")
    queries = written(asked.select("cls").distinct().join(classes, "cls").select("cls", "v"), "queries")
    blocks = max(1, -(-n // BLOCK))
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    ranked = pivots[:n_ranked]

    def built(own: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(own["v"].to_numpy())
        posted, starts = inverted(files_of(vectors, pivots, n_files), len(pivots))
        raw = [x.tobytes() for x in (vectors, posted, starts, places_of(vectors, ranked))]
        return pd.DataFrame({"block": [own["block"].iloc[0]], "vectors": [raw[0]], "members": [own["members"].tolist()], "posted": [raw[1]], "starts": [raw[2]], "places": [raw[3]]})

    entries = classes.select("v", "members", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("block"))
    index = written(entries.groupBy("block").applyInPandas(built, INDEX), "index")

    def searched(asks: DataFrame, files: bool) -> DataFrame:
        def task(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_class": np.zeros(0, np.int64), "distance": np.zeros(0), "members": np.zeros(0, object)})]
            if len(own) and len(asked):
                block, wanted = own.iloc[0], np.stack(asked["v"].to_numpy())
                vectors = np.frombuffer(block["vectors"]).reshape(-1, dim)
                posted, starts = np.frombuffer(block["posted"], np.int32), np.frombuffer(block["starts"], np.int64)
                places = np.frombuffer(block["places"], np.int16).reshape(len(vectors), -1)
                members = np.empty(len(vectors), object)
                members[:] = list(block["members"])
                depth = extra + int(np.ceil(rerank * len(vectors)))
                for cls, q, near, place in zip(asked["cls"], wanted, files_of(wanted, pivots, n_files), places_of(wanted, ranked), strict=True):
                    at = met(posted, starts, near, len(vectors), shared) if files else np.arange(len(vectors))
                    if files and len(at) > depth:
                        foot = np.abs(places[at] - place).sum(1, dtype=np.int64)
                        at = at[foot <= np.partition(foot, depth - 1)[depth - 1]]  # ties too
                    at, distance = closest(vectors, at, q, k + 1)
                    out.append(pd.DataFrame({"query_class": cls, "distance": distance, "members": members[at]}))
            return pd.concat(out)

        own = index.select("*", numbers(q_blocks).alias("q_block")) if q_blocks > 1 else index.withColumn("q_block", F.lit(0))
        q = asks.select("cls", "v", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q_block"), numbers(blocks).alias("block"))
        return own.groupBy("block", "q_block").cogroup(q.groupBy("block", "q_block")).applyInPandas(task, FOUND)

    found = written(searched(queries, True), "found")
    short = found.groupBy("query_class").agg(F.sum(F.size("members")).alias("n")).where(F.col("n") > k)
    rest = written(queries.join(short, queries["cls"] == short["query_class"], "left_anti"), "rest")
    if not rest.isEmpty():
        found = found.join(rest, found["query_class"] == rest["cls"], "left_anti").unionByName(searched(rest, False))
    each = found.select("query_class", "distance", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("query_class").orderBy("distance", "vec_id")
    top = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    top = top.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))).alias("top"))
    answers = asked.join(top, asked["cls"] == top["query_class"]).select("id", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("top"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("score")
    )


def op1_permutation_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("id", F.lit(100)) == 0)
