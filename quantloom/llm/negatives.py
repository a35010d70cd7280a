"""Hard negatives by exact scores, with the Four Russians' tables.

Components become whole numbers, floor(scale * x), and a score is the inner product of two such vectors. An index block holds up to
`BLOCK` candidates as bit planes of two's complement: for each plane and each group of eight dimensions one byte a candidate. For
a block of anchors a task sets up, for each group of eight dimensions, the sums of all 256 subsets of the anchors'
components, once for all candidates. A candidate's bytes look these sums up; plane by plane they are doubled and added,
the sign's plane is subtracted: the full inner product, exactly, without a multiplication.

Two passes over the same index, each a task for a block of anchors and a block of candidates. The first scores candidates of
the anchor's own label, for the `n_positives` best. The second scores those of other labels, and for each positive keeps the best
`n_negatives` of scores between low and high hundredths of the positive's. Tasks return these few alone, and they are merged.
Anchors are a stated query set: the work is anchors times rows, in blocks.

Defined results: rows with a null id, a null label, a null vector, or a null, NaN or infinite component take no part, nor do vectors
of another dimension than the most frequent one (the smaller of several), nor vectors whose whole numbers are so large (2 ** 28 in 64
dimensions) that a score might not fit 64 bits. Zero vectors take part. Rows that repeat id, label and vector count once. Rows with the
anchor's id are never its positives or negatives. Ties go to the smaller id. Anchors without positives, and positives without
negatives, give no rows; neither does an empty table. Labels are whole numbers. Only the three named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

BLOCK, SLICE, ANCHORS = 32768, 4096, 128
INDEX = "block int, dim int, bits int, planes binary, ids binary, labels binary"
FOUND = "name bigint, p bigint, score bigint, id bigint"


def whole_numbers(rows: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """id, label, q of the rows that take part, each once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), v.alias("v")).dropna().where(F.size("v") > 0)
    fine = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    wide = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = wide[0]["dim"] if wide else 1
    limit = float(1 << (62 - int(dim).bit_length() + 1) // 2)
    fine = fine.where((F.size("v") == dim) & F.forall("v", lambda x: F.abs(x * scale) < limit))
    return fine.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q")).distinct()


def planes_of(q: np.ndarray) -> np.ndarray:
    """Bytes of a plane, a group of eight dimensions and a row: an array (planes, groups, rows); the last plane is the sign's."""
    bits = 1 + max((int(x).bit_length() for x in (q.max(), -q.min() - 1) if x > 0), default=0)
    return np.stack([np.packbits((q >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)])


def tables_of(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Sums of all subsets of each eight components: an array (groups, 256, anchors), as narrow as all scores allow."""
    groups = -(-anchors.shape[1] // 8)
    a = np.zeros((groups * 8, len(anchors)), np.int64)
    a[: anchors.shape[1]] = anchors.T
    most = int(np.abs(a).sum(0).max(initial=0)) << bits
    out = np.zeros((groups, 256, len(anchors)), np.int32 if most < 1 << 31 else np.int64)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + a[i::8, None]
    return out


def scores_of(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors): lookups, shifts and additions."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    looked = np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        total <<= 1
        for g in range(planes.shape[1]):
            np.take(tables[g], planes[b, g], axis=0, out=looked, mode="clip")
            if b == len(planes) - 1:
                total -= looked
            else:
                total += looked
    return total


def indexed(own: pd.DataFrame) -> pd.DataFrame:
    """One row of the index: its rows by label, then id."""
    own = own.sort_values(["label", "id"])
    q = np.stack(own["q"].to_numpy())
    planes = planes_of(q)
    raw = [planes.tobytes(), own["id"].to_numpy(np.int64).tobytes(), own["label"].to_numpy(np.int64).tobytes()]
    return pd.DataFrame({"block": [own["block"].iloc[0]], "dim": [q.shape[1]], "bits": [len(planes)], "planes": [raw[0]], "ids": [raw[1]], "labels": [raw[2]]})


def opened(block: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels"))
    return np.frombuffer(block["planes"], np.uint8).reshape(block["bits"], -1, len(ids)), ids, labels


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best: higher scores first, then smaller ids."""
    if len(score) > 4 * most:
        near = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        return near[np.lexsort((ids[near], -score[near]))[:most]]
    return np.lexsort((ids, -score))[:most]


def positives_in(block: pd.Series, asked: pd.DataFrame, most: int) -> list[pd.DataFrame]:
    """The best of the anchors' own labels."""
    planes, ids, labels = opened(block)
    out = []
    for label, own in asked.groupby("label"):
        lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
        tables = tables_of(np.stack(own["q"].to_numpy()), len(planes))
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(own))]
        for i in range(lo, hi, SLICE):
            j = min(hi, i + SLICE)
            scores = scores_of(planes[:, :, i:j], tables)
            for k, a in enumerate(own["id"]):
                other = ids[i:j] != a
                s, who = np.append(held[k][0], scores[other, k].astype(np.int64)), np.append(held[k][1], ids[i:j][other])
                top = best(s, who, most)
                held[k] = s[top], who[top]
        out += [pd.DataFrame({"name": name, "p": 0, "score": s, "id": who}) for name, (s, who) in zip(own["name"], held, strict=True) if len(s)]
    return out


def negatives_in(block: pd.Series, asked: pd.DataFrame, most: int, low: int, high: int) -> list[pd.DataFrame]:
    """For each positive the best of other labels within the bounds. asked has the positives' scores, best first."""
    planes, ids, labels = opened(block)
    tables = tables_of(np.stack(asked["q"].to_numpy()), len(planes))
    marks = [np.asarray(s, np.int64) for s in asked["scores"]]
    # s >= ceil(low * p / 100) and s <= floor(high * p / 100), in whole numbers
    floors, ceilings = [-(-low * m // 100) for m in marks], [high * m // 100 for m in marks]
    least, greatest = np.array([f.min() for f in floors]), np.array([c.max() for c in ceilings])
    mine = asked["label"].to_numpy(np.int64)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in marks]
    for i in range(0, len(ids), SLICE):
        scores = scores_of(planes[:, :, i : i + SLICE], tables)
        hit = (scores >= least) & (scores <= greatest) & (labels[i : i + SLICE, None] != mine)
        for k in np.flatnonzero(hit.any(0)):
            at = np.flatnonzero(hit[:, k])
            s, who = np.append(held[k][0], scores[at, k].astype(np.int64)), np.append(held[k][1], ids[i : i + SLICE][at])
            order = np.lexsort((who, -s))
            s, who = s[order], who[order]
            first = [int(np.searchsorted(-s, -c)) for c in ceilings[k]]
            keep = np.unique(np.concatenate([np.arange(x, min(x + most, len(s))) for x in first]))
            held[k] = s[keep], who[keep]
    out = []
    for k, (s, who) in enumerate(held):
        for p, (f, c) in enumerate(zip(floors[k], ceilings[k], strict=True), 1):
            at = np.flatnonzero((s <= c) & (s >= f))[:most]
            if len(at):
                out.append(pd.DataFrame({"name": asked["name"].iloc[k], "p": p, "score": s[at], "id": who[at]}))
    return out


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on column `id`."""
    good = written(whole_numbers(rows, key, vector, label, scale), "numbers")
    n = good.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks)).cast("int")
    index = written(good.withColumn("block", dealt).groupBy("block").applyInPandas(indexed, INDEX), "index")
    # rows with one id may have several vectors, so anchors get names
    anchors = written(good.where(is_anchor).withColumn("name", F.monotonically_increasing_id()), "anchors")
    a_blocks = max(1, -(-anchors.count() // ANCHORS))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def passed(asks: DataFrame, search) -> DataFrame:
        def task(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("name", "p", "score", "id")})]
            if len(own) and len(asked):
                for i in range(0, len(asked), ANCHORS):
                    out += search(own.iloc[0], asked.iloc[i : i + ANCHORS])
            return pd.concat(out)

        own = index.select("*", numbers(a_blocks).alias("a_block"))
        asks = asks.withColumn("a_block", F.pmod(F.xxhash64("name"), F.lit(a_blocks)).cast("int")).select("*", numbers(blocks).alias("block"))
        return own.groupBy("block", "a_block").cogroup(asks.groupBy("block", "a_block")).applyInPandas(task, FOUND)

    first = Window.partitionBy("name", "p").orderBy(F.desc("score"), "id")
    placed = lambda found, most: found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    top = placed(passed(anchors, lambda block, asked: positives_in(block, asked, n_positives)), n_positives)
    positives = written(top.select("name", F.col("rank").cast("bigint").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("s")).select("name", F.col("s.positive_score").alias("scores"))
    found = passed(anchors.join(scores, "name"), lambda block, asked: negatives_in(block, asked, n_negatives, low, high))
    out = placed(found, n_negatives).join(positives, ["name", "p"]).join(anchors.select("name", F.col("id").alias("anchor_id")), "name")
    out = out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = written(out, "negatives")
    for t in (good, index, anchors, positives):
        forget(t)
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.pmod("id", F.lit(100)) == 0)


ORACLE = """
with e as (select vec_id id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint lab, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (select a.id anchor, a.lab mine, e.id, e.lab, list_dot_product(a.q, e.q)::bigint score from e a join e on a.id <> e.id where a.id % 100 = 0),
p as (select anchor, mine, id positive, score ps from s where lab = mine qualify row_number() over (partition by anchor order by score desc, id) <= 5),
n as (select p.anchor, p.positive, p.ps, s.id negative, s.score, row_number() over (partition by p.anchor, p.positive order by s.score desc, s.id) rank
  from p join s on s.anchor = p.anchor and s.lab <> p.mine and 80 * p.ps <= 100 * s.score and 100 * s.score <= 100 * p.ps)
select anchor anchor_id, positive positive_id, rank::int rank, negative negative_id, ps positive_score, score negative_score from n where rank <= 5
"""
