"""Windows of a fixed number of words that occur more than once, over a whole corpus, found around recurring phrases.

1. Of every window the anchor is the phrase (gram) of it with the least hash (kernels.anchors). Only anchors that occur again matter.
2. `locate` says at which of their places these phrases stand, letter by letter (automata, phrases.py). Nothing else goes on.
3. A run of windows around one located phrase is compared by all that it covers. Where that occurs again, all its windows do.
4. Else parts of runs are compared, and then single windows, where they share what they have in common with a different run.

No step holds a group in one task: groups are counted by pre-aggregated sums and found again by joins, which Spark splits
where they are skewed. What runs, parts and windows cover is compared by two hashes of 64 bits.

Documents are told apart by `key`. A window is marked if it also occurs at a smaller key, or at the same key and a smaller start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import cut, forget, written

U = np.uint64
RUN = "key bigint, start int, n int, place int, gram bigint, whole bigint"
CONTEXT = "key bigint, start int, n int, place int, units binary"
PART = "key bigint, run int, start int, n int, gram bigint, whole bigint"
WINDOW = "key bigint, start int, gram bigint, whole bigint"


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = kernels.bytes_of(column)
    starts, ends, rows = kernels.words_at(data, at)
    return kernels.word_values(data, starts, ends), rows


def anchored(column: pa.Array, window: int, gram: int, with_whole: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start, n, place of the anchor, its hash, and a hash of all covered, of every run of windows in these texts that has one anchor."""
    units, at = word_units(column)
    for row, part, shift in kernels.stretches(at, window):
        lo, hi = part[0], part[-1]
        start, n, place, gram_hash, whole = kernels.anchors(units[lo:hi], part - lo, window, gram, with_whole)
        if len(start):
            own = np.searchsorted(part - lo, start, "right") - 1
            base = (part - lo)[own] - shift
            yield row + own, (start - base).astype(np.int32), n.astype(np.int32), (place - start).astype(np.int32), gram_hash.view(np.int64), whole.view(np.int64) if with_whole else None


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs: key, text. The anchors of all windows: key, word, hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, start, _, place, gram_hash, _ in anchored(b.column(1), window, gram, False):
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(start + place), pa.array(gram_hash)], ["key", "at", "gram"])

    return docs.select("key", "text").mapInArrow(task, "key bigint, at int, gram bigint")


def context_rows(docs: DataFrame, window: int) -> DataFrame:
    """docs: key, text, runs array<struct<start, n, place>>. The runs with the words that they cover, as hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            runs = b.column(2)
            flat, owner = runs.flatten(), np.repeat(np.arange(b.num_rows), np.diff(runs.offsets.to_numpy()))
            start, n, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            units, at = word_units(b.column(1))
            begin = at[owner] + start
            data = [units[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + n - 1 + window).tolist(), strict=True)]
            keys = b.column(0).to_numpy(zero_copy_only=False)[owner]
            for i in range(0, len(data), 1 << 14):
                some = slice(i, i + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(start[some]), pa.array(n[some]), pa.array(place[some]), pa.array(data[some], pa.binary())], ["key", "start", "n", "place", "units"])

    return docs.select("key", "text", "runs").mapInArrow(task, CONTEXT)


def units_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of a column of contexts, one after the other, and where each context begins."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data.copy().view(U), (at - at[0]) // 8


def runs_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, n[i] times i; and 0 .. n[i] - 1."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def part_rows(contexts: DataFrame, window: int, size: int) -> DataFrame:
    """Runs cut into parts of `size` windows, at multiples of `size` before the anchor.

    `gram` is a hash of what all windows of such a part have in common, `whole` of all that this part's windows cover.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, start, n, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            values, at = units_in(b.column(4))
            top, low = place // size, (place - n + 1) // size
            own, i = runs_of((top - low + 1).astype(np.int64))
            g = top[own] - i
            first = np.maximum(place[own] - (g + 1) * size + 1, 0)  # of the part's windows, counted from the run's start
            last = np.minimum(place[own] - g * size, n[own] - 1)
            core = place[own] - g * size, place[own] - (g + 1) * size + 1 + window
            m = (last - first + 1).astype(np.int32)
            base = at[own]
            gram = kernels.mix(kernels.Spans(values, 0)(base + core[0], base + core[1]) + g.astype(U) * U(kernels.BASES[1]))
            whole = kernels.mix(kernels.Spans(values, 1)(base + first, base + last + window) + m.astype(U) * U(kernels.BASES[0]))
            cols = [keys[own], start[own], (start[own] + first).astype(np.int32), m, gram.view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "run", "start", "n", "gram", "whole"])

    return contexts.mapInArrow(task, PART)


def window_rows(contexts: DataFrame, window: int) -> DataFrame:
    """contexts, with parts array<struct<start, n>>. The windows of these parts, with two hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, start = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            values, at = units_in(b.column(2))
            flat, owner = b.column(3).flatten(), np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
            first, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            part, i = runs_of(n)
            own = owner[part]
            each = first[part] + i
            begin = at[own] + each - start[own]
            cols = [keys[own], each.astype(np.int32)] + [kernels.Spans(values, j)(begin, begin + window).view(np.int64) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "start", "gram", "whole"])

    return contexts.select("key", "start", "units", "parts").mapInArrow(task, WINDOW)


def judged(rows: DataFrame, name: str) -> DataFrame:
    """rows: key, start, gram, whole ... As a table, with `marked`: all of the row's windows are; and `resolve`: some may be.

    Rows of one gram may have windows in common, rows of one whole have all of them in common. Of these one row, the first,
    stands for the others in later passes.
    """
    at = F.struct("key", "start")
    # counts are tables of their own before they are joined: Spark splits a skewed join only if both sides come from a shuffle
    counts = written(rows.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("same"), F.min(at).alias("first")), "counts")
    mixed = written(counts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed")
    runs = written(counts.join(mixed, "gram", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))).where("same > 1 or kinds > 1"), "shared")
    forget(counts)
    forget(mixed)
    both = rows.join(runs, ["gram", "whole"]).withColumn("is_first", at == F.col("first"))
    told = both.withColumns({"marked": (F.col("same") > 1) & ~F.col("is_first"), "resolve": (F.col("kinds") > 1) & F.col("is_first")})
    out = written(told.where("marked or resolve").drop("gram", "whole", "same", "first", "kinds", "is_first"), name)
    forget(runs)
    return out


def repeated(docs: DataFrame, window: int, gram: int, part: int, locate: Callable) -> DataFrame:
    """docs: key (unique, not null), text. Returns key, marks array<struct<start, n>>: n windows from start on are marked.

    locate gets docs, the anchors of all windows (key, at, gram), and the phrases among them that occur again, each with the first
    place where it does (gram, key, at), and deletes both tables; it returns a table of the runs of windows at whose anchors a phrase stands.
    """
    rows = written(anchor_rows(docs, window, gram), "anchors")
    again = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "at")).alias("first")).where("c > 1").select("gram", "first.key", "first.at"), "again")
    shared = locate(docs, rows, again)
    runs = judged(shared, "runs")
    forget(shared)
    lists = runs.where("resolve").groupBy("key").agg(F.collect_list(F.struct("start", "n", "place")).alias("runs"))
    contexts = written(context_rows(docs.join(lists, "key"), window), "contexts")
    parts = judged(part_rows(contexts, window, part), "parts")
    todo = parts.where("resolve").groupBy("key", F.col("run").alias("start")).agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    single = written(window_rows(contexts.join(todo, ["key", "start"]), window), "windows")
    groups = written(single.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start")).alias("first")).where("c > 1"), "groups")
    hits = single.join(groups, ["gram", "whole"]).where(F.struct("key", "start") != F.col("first"))
    marks = runs.where("marked").select("key", "start", "n")
    marks = marks.unionByName(parts.where("marked").select("key", "start", "n")).unionByName(hits.select("key", "start", F.lit(1).alias("n")))
    out = written(marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks")), "marks")
    for used in (runs, contexts, parts, single, groups):
        forget(used)
    return out


def covered(size: int, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of `size` units lie in a marked window."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + n - 1 + window, -1)
    return np.cumsum(steps[:size]) > 0


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, text with a unique key in the order of ids. Ids that are null, repeat, or aren't integers make a table with keys of its own."""
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and own.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or id is null").isEmpty():
        return own.withColumn("key", F.col("id").cast("bigint"))
    # null ids first, then by id; rows that repeat an id in the order of their texts' hashes
    ranged = own.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"))
    return written(ranged.withColumn("key", F.monotonically_increasing_id()), "keyed")
