"""Near-duplicates of vectors: an exact range join in a metric space.

Vectors of one label and one dimension are compared by cosine; for unit vectors, cosine >= c is Euclidean distance <= r with
r = sqrt(2 - 2 c), a metric. A group of more than `CELL` vectors is parted by pivots: every vector is at home with its nearest pivot. It
also visits each cell in which a vector within r of it could be at home: by the triangle inequality, where the pivot is at most
2 r farther than its nearest one, and where the cell's side of the bisecting plane is at most r away. Vectors within r / 2 of a pivot
form its ball, a cell of its own: all of them are linked with each other, without a comparison, so that a heap of copies
costs nothing; a ball is visited from within 3 r / 2 of its pivot. Cells that are still large are parted anew by pivots of their own,
until they are small or parting shrinks them no more. Residents of a cell that stays large are dealt to blocks of bounded size, and each block
meets the others of the cell in parts of bounded size.

Then each cell is joined by itself: a vector's links are counted at home alone, where all vectors that could be linked with it are
residents or visitors, each once. Tasks compare in numpy and return, for each vector, a count and the least id of what
it is connected with inside the cell, so no pairs are made. Components follow by contraction of stars. Cosines within 1e-9 of the
threshold are taken again from the given components.

Pivots: of each group at most about `SAMPLE` vectors, by hash; of these, vectors r or more apart, each moved to the mean of the
sampled vectors around it. Results don't depend on them, only the work does: vectors without structure in many dimensions visit
most cells (64 dimensions, r = 0.2: some three in ten of many), those with structure few.

Defined results: one row for each given row. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label or null id, link with nothing: no links, their own id as component. Vectors of different dimensions don't link. Rows that
repeat an id are vectors of their own, which link like others; components go by ids. `kept` is whether the id is the component's
least, and true for a null id, whose component is null. An empty table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .ordermin import components

CELL, VISIT, SALT, STRIP = 2048, 8192, 32768, 256
PIVOTS, SAMPLE = 64, 1024
#: Distances are taken this much wider or narrower, more than their rounding errors; cosines this near the threshold are taken again.
SLACK, CLOSE = 1e-7, 1e-9
ROWS = "cell string, parent bigint, no bigint, id bigint, resident boolean, v binary"
PARTED = ROWS + ", ball boolean"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Times a power of two, which changes no digit: the largest component is next to 1, and no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def opened(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def pivots_of(sample: np.ndarray, most: int, r: float) -> np.ndarray:
    """Up to `most` of these unit vectors, each at least r from the others, moved to the mean of what is within r of it."""
    free, chosen = np.ones(len(sample), bool), []
    for i in range(len(sample)):
        if free[i] and len(chosen) < most:
            around = apart(sample[i : i + 1], sample)[0] <= r
            free &= ~around
            chosen.append(sample[around].mean(0))
    return unit(np.array(chosen))


def reached(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: home pivot, whether in its ball, and which cells and which balls (rows, pivots) a link could lead to."""
    d = apart(x, pivots)
    home = d.argmin(1)
    near = d[np.arange(len(x)), home]
    between = apart(pivots, pivots)[home]
    plane = (d**2 - near[:, None] ** 2) / np.maximum(2 * between, 1e-300)
    cells = (d <= near[:, None] + 2 * r + SLACK) & ((plane <= r + SLACK) | (between < 1e-6))
    return home, near <= r / 2 - SLACK, cells, d <= 1.5 * r + SLACK


def parted(own: pd.DataFrame, pivots: np.ndarray, r: float) -> pd.DataFrame:
    """The rows of one group, or of a part of it, dealt to cells and balls of the next round."""
    home, ball, cells, balls = reached(unit(opened(own["v"])), pivots, r)
    resident = own["resident"].to_numpy(bool)
    every, out = np.arange(len(own)), []
    cells[every[resident & ~ball], home[resident & ~ball]] = False  # at home there already
    balls[every[resident & ball], home[resident & ball]] = False
    at_home = every[resident]
    for rows, pivot, is_ball, stays in (
        (at_home, home[at_home], ball[at_home], True),
        (*np.nonzero(cells), False, False),
        (*np.nonzero(balls), True, False),
    ):
        took = own.iloc[rows]
        step = np.char.add(pivot.astype(str), np.where(is_ball, "o", "/"))  # before the name, which ends in the label
        names = np.char.add(step, took["cell"].to_numpy(str)) if len(rows) else []
        out.append(took.assign(cell=names, resident=stays, ball=is_ball))
    return pd.concat(out)


def connected(linked: np.ndarray, residents: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """linked: (residents, residents + others). The least id that each is connected with, through links with residents."""
    ids = np.concatenate([residents, others])
    least, n = ids.copy(), len(residents)
    fresh = linked.any(1)
    for i in range(n):
        if not fresh[i]:
            continue
        seen, front = np.zeros(len(ids), bool), np.array([i])
        seen[i] = True
        while len(front):
            fresh[front] = False
            new = linked[front].any(0) & ~seen
            seen |= new
            # residents among the new, and those linked with the others among the new
            wanted = new[:n] | linked[:, n:][:, new[n:]].any(1)
            front = np.flatnonzero(wanted & fresh)
            seen[front] = True
        least[seen] = ids[seen].min()
    return least[:n], least[n:]


def links_of(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which of these vectors are linked, a strip of rows at a time."""
    a, b = scaled(a), scaled(b)
    u, w = unit(a), unit(b)
    linked = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(a), STRIP):
        s = u[k : k + STRIP] @ w.T
        linked[k : k + STRIP] = s >= cosine
        for i, j in zip(*np.nonzero(np.abs(s - cosine) < CLOSE), strict=True):
            x, y = a[k + i], b[j]
            linked[k + i, j] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine
    return linked


def met(own: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One block of a cell's residents, with a part of what else may be linked with them: no, id, links, least id connected."""
    here = own["resident"].to_numpy(bool)
    r, o = own[here], own[~here]
    if not len(r):
        return pd.DataFrame({"no": [], "id": [], "n": [], "least": [], "resident": []})
    ids, others, a = r["id"].to_numpy(np.int64), o["id"].to_numpy(np.int64), opened(r["v"])
    inside = links_of(a, a, cosine) if r["own_links"].iloc[0] else np.zeros((len(r), len(r)), bool)
    np.fill_diagonal(inside, False)
    outside = links_of(a, opened(o["v"]), cosine) if len(o) else np.zeros((len(r), 0), bool)
    linked = np.concatenate([inside, outside], axis=1)
    least_r, least_o = connected(linked, ids, others)
    touched = outside.any(0)
    return pd.concat(
        [
            pd.DataFrame({"no": r["no"].to_numpy(), "id": ids, "n": linked.sum(1), "least": least_r, "resident": True}),
            pd.DataFrame({"no": o["no"].to_numpy()[touched], "id": others[touched], "n": 0, "least": least_o[touched], "resident": False}),
        ]
    )


def cells_of(rows: DataFrame, r: float) -> tuple[DataFrame, list[DataFrame]]:
    """rows (cell, parent, no, id, resident, v), parted until cells are small: cell, ball, residents, visitors, least, no, id, resident, v.
    Also the tables that these are read from.
    """
    done, temporary, turn = [], [], 0
    rows = rows.withColumn("ball", F.lit(False))
    while True:
        of_cell = [F.count_if("resident").alias("residents"), F.count_if(~F.col("resident")).alias("visitors"), F.min(F.when(F.col("resident"), F.col("id"))).alias("least")]
        sizes = written(rows.groupBy("cell").agg(*of_cell, F.any_value("ball").alias("ball"), F.any_value("parent").alias("parent")).where("residents > 0"), "sizes")
        temporary.append(sizes)
        large = ~F.col("ball") & (F.col("residents") > CELL) & (F.col("residents") <= 0.9 * F.col("parent"))
        rows = rows.drop("ball", "parent").join(sizes, "cell")
        done.append(rows.where(~large).drop("parent"))
        if sizes.where(large).isEmpty():
            return reduce(DataFrame.unionByName, done), temporary
        todo = rows.where(large)
        share = F.lit(SAMPLE) / F.col("residents")
        chosen = todo.where(F.col("resident") & (F.pmod(F.xxhash64("no", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40) < share))
        first = Window.partitionBy("cell").orderBy(F.xxhash64("no", F.lit(turn)), "no")
        chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * SAMPLE)

        def pivots(own: pd.DataFrame) -> pd.DataFrame:
            most = int(np.clip(-(-2 * own["residents"].iloc[0] // CELL), 2, PIVOTS))
            found = pivots_of(unit(opened(own.sort_values("place")["v"])), most, r)
            return pd.DataFrame({"cell": [own["cell"].iloc[0]], "pivots": [found.tobytes()], "dim": [found.shape[1]], "salts": [-(-int(own["residents"].iloc[0] + own["visitors"].iloc[0]) // SALT)]})

        by_cell = written(chosen.groupBy("cell").applyInPandas(pivots, "cell string, pivots binary, dim int, salts int"), "pivots")

        def dealt(own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            names = [c.split()[0] for c in PARTED.split(", ")]
            own = own.assign(parent=own["residents"])
            if len(own) and len(pivots):
                own = parted(own, np.frombuffer(pivots["pivots"].iloc[0]).reshape(-1, pivots["dim"].iloc[0]), r)
            return own[names]  # a cell without pivots, if there were any, stays as it is and is not parted again

        salts = F.ceil((F.col("residents") + F.col("visitors")) / SALT)
        todo = todo.withColumn("salt", F.pmod(F.xxhash64("no", F.lit(turn), F.lit(1)), salts).cast("int"))
        by_salt = by_cell.select("cell", "pivots", "dim", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        rows = written(todo.groupBy("cell", "salt").cogroup(by_salt.groupBy("cell", "salt")).applyInPandas(dealt, PARTED), "parted")
        temporary += [by_cell, rows]
        turn += 1


def joined(cells: DataFrame, cosine: float) -> DataFrame:
    """no, id, n, least, resident: partial counts of each resident, and what each connected vector is connected with."""
    blocks = F.ceil(F.col("residents") / CELL).cast("int")
    inner = F.when(F.col("ball") | (blocks == 1), F.lit(0)).otherwise(F.col("residents"))  # other blocks' residents are visitors too
    parts = F.greatest(F.lit(1), F.ceil((F.col("visitors") + inner) / VISIT)).cast("int")
    cells = cells.select("*", blocks.alias("blocks"), parts.alias("parts"))
    own = F.pmod(F.xxhash64("no", F.lit(2)), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("no", F.lit(3)), F.col("parts")).cast("int")
    all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = lambda b, p, resident, links: F.struct(b.alias("block"), p.alias("part"), resident.alias("resident"), links.alias("own_links"))
    # as resident in all parts of its block (its links inside the block count in the first), as visitor in one part of other blocks
    homes = F.transform(all_of("parts"), lambda p: at(own, p, F.lit(True), ~F.col("ball") & (p == 0)))
    others = F.when(F.col("ball"), F.array_except(all_of("blocks"), all_of("blocks"))).otherwise(F.filter(all_of("blocks"), lambda b: b != own))
    calls = F.transform(F.when(F.col("resident"), others).otherwise(all_of("blocks")), lambda b: at(b, part, F.lit(False), F.lit(False)))
    places = F.when(F.col("resident"), F.concat(homes, calls)).otherwise(calls)
    rows = cells.select("cell", "no", "id", "v", F.explode(places).alias("at")).select("cell", "no", "id", "v", "at.*")
    return rows.groupBy("cell", "block", "part").applyInPandas(lambda g: met(g, cosine), "no bigint, id bigint, n bigint, least bigint, resident boolean")


def linked_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """key, n_links, component_id, kept."""
    kind = rows.schema[key].dataType
    v = F.col("v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    base = base.withColumn("no", F.monotonically_increasing_id()).withColumn("fine", F.coalesce(fine, F.lit(False)))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(v=[None if x is None else np.asarray(x, np.float64).tobytes() for x in b["v"]])

    start = F.when(F.col("fine"), F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label")))
    base = base.select("no", "id", start.alias("cell"), F.when(F.col("fine"), F.col("v")).alias("v"))
    base = written(base.mapInPandas(packed, "no bigint, id bigint, cell string, v binary"), "vectors")
    groups = base.where("cell is not null").select("cell", F.lit((1 << 62)).cast("bigint").alias("parent"), "no", "id", F.lit(True).alias("resident"), "v")
    cells, temporary = cells_of(groups, float(np.sqrt(2 - 2 * cosine)))
    found = written(joined(cells, cosine), "met")
    counts = found.where("resident").groupBy("no").agg(F.sum("n").alias("n"))
    # all of a ball are linked with each other
    balls = cells.where(F.col("ball") & F.col("resident")).select("no", "id", (F.col("residents") - 1).alias("n"), "least")
    counts = counts.unionByName(balls.select("no", "n")).groupBy("no").agg(F.sum("n").alias("n"))
    edges = found.where("id <> least").select("id", "least").unionByName(balls.where("id <> least").select("id", "least"))
    edges = written(edges.select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b")).distinct(), "links")
    labels = components(edges).select(F.col("node").alias("id"), "label")
    out = base.select("no", "id").join(counts, "no", "left").join(labels, "id", "left")
    out = out.select(F.col("id").cast(kind).alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))), "linked")
    for t in (base, found, edges, *temporary):
        forget(t)
    return out


def op13_metric_range_join(spark, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive e as (select vec_id id, label, embedding::double[] v from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select x.id a, y.id b from e x join e y on x.label = y.label and x.id <> y.id where list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98),
reach(id, other) as (select vec_id, vec_id from embeddings union select r.id, l.b from reach r join l on l.a = r.other)
select e.vec_id, coalesce(n, 0)::bigint n_links, c component_id, e.vec_id = c kept
from embeddings e join (select id, min(other) c from reach group by id) m on m.id = e.vec_id left join (select a, count(*) n from l group by a) k on k.a = e.vec_id
"""
