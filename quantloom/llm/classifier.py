"""A quality classifier by co-training of two views.

The content view sees the text: which of the telling words it has, and shares of symbols, capitals, repeated lines and
the like. The metadata view sees what is known without the text: source, language, length. Both are logistic
regressions. In each round either one labels those unlabelled documents of which it is confident, and the other one learns
from these labels too. Held-out labelled documents then calibrate each view by itself, and weigh the two calibrated views
against each other. A document is good if its quality is 1 and it isn't toxic.

What is fitted on a sample are the labelled rows alone: `max_labelled` of them at most, those with the least hashes of their ids (a
quarter is held out). Telling words, `max_words` of them, are those of this sample with the largest chi-squared. All unlabelled
documents take part in the exchange: their features are a table, and a step of Newton's method adds up their gradients and curvatures
task by task, then in two levels of groups, so that the driver gets one row. Together they weigh no more than the labelled
ones. Scoring covers every document and its whole text.

Defined results: a null text is empty; null metadata are values of their own. A document with a null label, or a null id, is unlabelled; if an id has
several labels, it is good only if all say so. Rows that repeat an id are scored each for itself. Where the labels have one
class only or there are none, every document gets that class's score, or 1, and `kept` follows from it. An empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import cut, forget, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Kinds of bytes that are counted: symbols, capitals, small letters (and bytes of others), digits, ends of sentences, bars.
KINDS = (b"#*$%&<>", bytes(range(65, 91)), bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(48, 58)), b".!?", b"|")
SHAPES = len(KINDS) + 4
SOURCES, LANGUAGES = 64, 16


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps, over columns standardised by the rows that it was first fitted on."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log likelihood of these rows."""
        z = self.standard(x)
        p = sigmoid(np.clip(z @ self.weights, -30, 30))
        return z.T @ (y - p), (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        penalty = np.full(len(self.weights), self.ridge)
        penalty[-1] = 1e-6
        move = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.weights)
        self.weights = self.weights + move
        return float(np.abs(move).max())

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale = np.where(self.scale > 1e-9, self.scale, 1.0)
        self.weights = np.zeros(x.shape[1] + 1)
        for _ in range(30):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def content(texts: pa.Array, words: dict[str, int]) -> np.ndarray:
    """Rows of shape features and of 0 / 1 for each telling word."""
    data, at = kernels.bytes_of(texts)
    size = np.maximum(np.diff(at), 1).astype(float)
    out = np.zeros((len(texts), SHAPES + len(words)), np.float32)
    for j, kind in enumerate(KINDS):
        table = np.zeros(256, np.int64)
        table[list(kind)] = 1
        sums = np.append(0, np.cumsum(table[data]))
        out[:, j] = (sums[at[1:]] - sums[at[:-1]]) / size
    known = words.keys()
    for i, text in enumerate(texts.to_pylist()):
        found = letters(text)
        distinct = set(found)
        lines = [x for x in (text or "").split("\n") if x.strip()]
        n = max(1, len(found))
        out[i, len(KINDS) : SHAPES] = (np.log1p(len(found)), np.log1p(len(distinct)) / np.log1p(n), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, 10 / n))
        for w in distinct & known:
            out[i, SHAPES + words[w]] = 1
    return out


def letters(text: str | None) -> list[str]:
    """The words of a text, for choosing telling words as for finding them: runs of letters, small."""
    return LETTERS.findall((text or "").lower())


def metadata(languages: list, sources: list, lengths: list) -> np.ndarray:
    """One column for each hashed source and language, and the length."""
    out = np.zeros((len(sources), SOURCES + LANGUAGES + 2), np.float32)

    def slot(value, n: int) -> int:
        code = 0 if value is None else 1
        for b in (value or "").encode("utf-8"):
            code = (code * 257 + b + 1) % 1_000_003
        return code % n

    seen: dict = {}
    for i, (lang, source, n) in enumerate(zip(languages, sources, lengths, strict=True)):
        for key, first, count in (((0, source), 0, SOURCES), ((1, lang), SOURCES, LANGUAGES)):
            if key not in seen:
                seen[key] = first + slot(key[1], count)
            out[i, seen[key]] = 1
        out[i, -2] = n is None
        out[i, -1] = np.log1p(max(0, n or 0))
    return out


@dataclass
class Model:
    """What scoring needs: telling words, both views, how each is calibrated, and how they are weighed."""

    words: dict[str, int]
    views: tuple[Logistic, Logistic] | None
    calibrated: tuple[Logistic, Logistic] | None
    joint: Logistic | None
    constant: float = 1.0

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: content view, metadata view, both: probabilities that the document is good."""
        if self.views is None:
            return np.full((len(x), 3), self.constant)
        odds = np.column_stack([c.logit(v.logit(f)[:, None]) for c, v, f in zip(self.calibrated, self.views, (x, m), strict=True)])
        return np.column_stack([sigmoid(odds), sigmoid(self.joint.logit(odds))])


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, good: of the ids with labels."""
    good = F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good")
    return labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(good)


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, text, metadata and good of the labelled documents to learn from, as a table of bounded size."""
    spark = docs.sparkSession
    few = docs.select("doc_id").distinct().join(known_labels(labels), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    wanted = spark.createDataFrame([(r["doc_id"], r["good"]) for r in few.collect()], "doc_id bigint, good int")  # max_labelled rows of 16 bytes at most
    return written(docs.select(*READ).join(F.broadcast(wanted), "doc_id"), "sample")


def telling_words(labelled: DataFrame, max_words: int, least: int = 8) -> list[str]:
    """Words of the labelled sample whose presence goes most with one class, by chi-squared."""
    n, n_good = labelled.agg(F.count(F.lit(1)), F.sum("good")).first()
    if not n or not 0 < n_good < n:
        return []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            each = [(g, w) for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in set(letters(t))]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in each], pa.int32()), pa.array([w for _, w in each], pa.string())], ["good", "word"])

    words = labelled.select("good", "text").mapInArrow(task, "good int, word string")
    by = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("good").alias("dg")).where(F.col("df") >= least)
    expected = F.col("df") * F.lit(n_good / n)
    chi = (F.col("dg") - expected) * (F.col("dg") - expected) / (expected * F.lit(1 - n_good / n))
    return [r["word"] for r in by.where(chi > 12).orderBy(chi.desc(), "word").limit(max_words).collect()]


def features(docs: DataFrame, words: dict[str, int]) -> DataFrame:
    """READ columns and `good` to good and both views' features, float32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            x = content(b.column(1), words)
            m = metadata(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), *[pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, m)]], ["id", "good", "x", "m"])

    return docs.select(*READ, "good").mapInArrow(task, "id bigint, good int, x binary, m binary")


def stacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1).astype(float)


def told(pool: DataFrame, judges: list[Logistic], now: list[Logistic], confident: float, groups: int = 1) -> tuple | None:
    """Over all documents of the pool of which the other view's judge is confident: for each view how many they are, and the
    gradient and curvature of its present weights. None if the pool is empty. groups: of tasks, whose sums are added up first."""
    sizes = [len(v.weights) for v in now]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0, np.zeros(n), np.zeros((n, n))] for n in sizes]
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                rows = [stacked(part.column(c).to_pylist()) for c in (0, 1)]
                for v in (0, 1):
                    p = sigmoid(judges[1 - v].logit(rows[1 - v]))
                    sure = (p >= confident) | (p <= 1 - confident)
                    if sure.any():
                        gradient, curvature = now[v].sums(rows[v][sure], (p[sure] >= 0.5).astype(float))
                        total[v][0] += int(sure.sum())
                        total[v][1] += gradient
                        total[v][2] += curvature
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.append(n, g) if k == 0 else g.ravel() for n, *gs in total for k, g in enumerate(gs)]).tobytes()], pa.binary())], ["sums"])

    def added(table: pa.Table) -> pa.Table:
        out = 0
        for x in table.column("sums"):
            out = out + np.frombuffer(x.as_buffer())
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    parts = pool.select("x", "m").mapInArrow(task, "sums binary").withColumn("part", F.spark_partition_id())
    first = parts.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(added, "part int, sums binary")
    last = first.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(added, "part int, sums binary").collect()
    if not last:
        return None
    flat, out, at = np.frombuffer(last[0]["sums"]), [], 0
    for n in sizes:
        out.append((flat[at], flat[at + 1 : at + 1 + n], flat[at + 1 + n : at + 1 + n + n * n].reshape(n, n)))
        at += 1 + n + n * n
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_words: int = 192, rounds: int = 3, steps: int = 2, confident: float = 0.98) -> Model:
    labelled = sample(docs, labels, max_labelled)
    words = {w: i for i, w in enumerate(telling_words(labelled, max_words))}
    rows = features(labelled, words).toPandas().sort_values("id")
    y = rows["good"].to_numpy(float)
    if len(y) < 8 or y.min() == y.max():
        return Model(words, None, None, None, float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 4 == 3
    sides = [stacked(rows["x"].tolist()), stacked(rows["m"].tolist())]
    views = [Logistic(ridge=4.0).fit(v[~held], y[~held]) for v in sides]
    if rounds:
        every = features(docs.select(*READ, F.lit(None).cast("int").alias("good")), words)
        # features are narrow where texts aren't; and a merge join at every size, so that what is shuffled grows as the input does
        pool = written(every.join(known_labels(labels).select(F.col("doc_id").alias("id")).hint("merge"), "id", "left_anti"), "pool")
        groups = max(1, int(pool.select(F.spark_partition_id()).distinct().count() ** 0.5))
        for _ in range(rounds):
            judges = [replace(v) for v in views]
            for _ in range(steps):
                sums = told(pool, judges, views, confident, groups)
                for v, view in enumerate(views):
                    gradient, curvature = view.sums(sides[v][~held], y[~held])
                    if sums is not None and sums[v][0]:
                        share = min(1.0, (~held).sum() / sums[v][0])
                        gradient, curvature = gradient + share * sums[v][1], curvature + share * sums[v][2]
                    view.step(gradient, curvature)
        forget(pool)
    forget(labelled)
    raw = [v.logit(f[held]) for v, f in zip(views, sides, strict=True)]
    calibrated = tuple(Logistic(ridge=0.1).fit(r[:, None], y[held]) for r in raw)
    odds = np.column_stack([c.logit(r[:, None]) for c, r in zip(calibrated, raw, strict=True)])
    return Model(words, tuple(views), calibrated, Logistic(ridge=1.0).fit(odds, y[held]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with p_content, p_metadata, p_good and kept in a struct `quality_score`."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = list(docs.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, names.index("text")):
            col = {n: b.column(i) for i, n in enumerate(names)}
            p = model.score(content(col["text"], model.words), metadata(col["lang"].to_pylist(), col["source"].to_pylist(), col["n_chars"].to_pylist()))
            scores = [pa.array(p[:, j]) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([*scores, pa.array(p[:, 2] >= threshold)], ["p_content", "p_metadata", "p_good", "kept"])], [*names, "quality_score"])

    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", quality_score struct<p_content double, p_metadata double, p_good double, kept boolean>"
    return docs.mapInArrow(task, schema)


READ = ["doc_id", "text", "lang", "source", "n_chars"]


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that a classifier fitted on them and their labels finds good."""
    return score(docs.select(*READ), fit(docs, labels), threshold).where("quality_score.kept").select(*READ)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*READ)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", "quality_score.*")
