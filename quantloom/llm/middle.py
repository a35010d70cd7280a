"""Fill-in-the-middle: a text's units are cut at two ranks, which an indexable skip list finds.

A unit is a code point, or what a given pattern matches from left to right (what lies between matches is a unit too). Above the list
of all units lie express lanes: a unit stands in lane k with probability FAN ** -k, by a hash of its rank. Every link
of a lane carries the units, the code points and the bytes that it passes over. To reach a rank one follows the uppermost lane as
long as the sum of its unit-widths does not pass the rank, then goes down a lane, to the lowest; the sums of the other widths
are then the cut in code points and in bytes. Expected steps: FAN for each lane, log(n) of them. All texts of a batch descend together.

Which cuts and which form a text gets follows from the sha256 of `seed:key` alone, so a rerun gives the same rows. Forms: psm is
prefix, suffix, middle; spm is suffix, prefix, middle; plain is the text itself.

Defined results: a null text counts as empty. Empty texts, texts that hold one of the three marks, and a share of the others
stay plain; their cuts are null. A null key is hashed as the word `null`. Rows that repeat a key are cut each by itself, by the same
numbers. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .kernels import bytes_of, mix

MARKS = ("<P>", "<S>", "<M>")
FAN_BITS = 4
FAN = 1 << FAN_BITS
OUT = "key string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def heights(ranks: np.ndarray) -> np.ndarray:
    """In how many lanes above the lowest a unit stands: of the hash of its rank, the leading groups of FAN_BITS zero bits."""
    h = mix(ranks.astype(np.uint64) + np.uint64(1))
    height = np.zeros(len(ranks), np.int8)
    left = np.ones(len(ranks), bool)
    for k in range(64 // FAN_BITS):
        left = left & ((h >> np.uint64(64 - FAN_BITS * (k + 1))) & np.uint64(FAN - 1) == 0)
        if not left.any():
            break
        height += left
    return height


class SkipLists:
    """One indexable skip list for each text of a batch.

    widths: an array (units, 3) of units (always 1), code points and bytes of each unit; at: where each text's units begin, and the end.
    A lane is: the rank in `widths` where each of its links begins, the widths of the link, and where each text's links begin.
    The head of a text stands in every lane, so a lane's links of a text cover all of it.
    """

    def __init__(self, widths: np.ndarray, at: np.ndarray):
        self.at = at
        n, sizes = len(widths), np.diff(at)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        height = heights(np.arange(n) - at[owner])
        height[at[:-1][sizes > 0]] = 127  # heads
        self.lanes = [(np.arange(n), widths, at)]
        for k in range(1, 64 // FAN_BITS + 1):
            below, links, _ = self.lanes[-1]
            here = np.flatnonzero(height[below] >= k)
            if len(here) == len(below) or not len(here):
                break
            nodes = below[here]
            self.lanes.append((nodes, np.add.reduceat(links, here, axis=0), np.searchsorted(nodes, at)))
            if len(nodes) <= len(sizes):  # heads alone
                break

    def reach(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Units, code points and bytes before the unit of this rank, for many texts and ranks at once: an array (asked, 3)."""
        passed = np.zeros((len(text), 3), np.int64)
        place = self.at[text]  # in the list of all units
        for nodes, links, starts in reversed(self.lanes):
            link, end = np.searchsorted(nodes, place), starts[text + 1]
            moving = np.flatnonzero(link < end)
            while len(moving):
                step = links[link[moving]]
                fits = passed[moving, 0] + step[:, 0] <= rank[moving]
                moving, step = moving[fits], step[fits]
                passed[moving] += step
                place[moving] += step[:, 0]
                link[moving] += 1
                moving = moving[link[moving] < end[moving]]
        return passed


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widths of all code points, and where each text's begin."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    bytes_each = np.diff(np.append(starts, len(data)))
    one = np.ones(len(starts), np.int64)
    return np.stack([one, one, bytes_each], axis=1), np.searchsorted(starts, at)


def matched(texts: list[str], unit: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the units that a pattern matches, and where each text's begin."""
    widths, at = [], [0]
    for t in texts:
        edges = sorted({0, len(t)} | {x for m in unit.finditer(t) for x in m.span()})
        pieces = [t[a:b] for a, b in zip(edges, edges[1:])]
        widths += [(1, len(p), len(p.encode("utf-8"))) for p in pieces]
        at.append(len(widths))
    return np.array(widths, np.int64).reshape(-1, 3), np.array(at)


def numbers(key: str | None, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


def arrange(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str | None = None, seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output. unit: a pattern, or None for code points. Of 100 texts, those from
    plain_from on stay plain; of 100 others, those below spm_below are suffix first. marks: of prefix, suffix and middle.
    """

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = None if unit is None else re.compile(unit)
        p, s, m = marks
        for b in cut(batches, 1):
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            widths, at = code_points(*bytes_of(b.column(1))) if pattern is None else matched(texts, pattern)
            n = np.diff(at)
            h = np.array([numbers(k, seed) for k in keys], np.int64).reshape(-1, 4)
            ranks = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
            every = np.arange(len(texts))
            lists = SkipLists(widths, at)
            first, second = (lists.reach(every, ranks[:, i])[:, 1] for i in (0, 1))
            form, output, cuts = [], [], []
            for i, t in enumerate(texts):
                if not t or any(x in t for x in marks) or h[i, 2] % 100 >= plain_from:
                    form.append("plain"), output.append(t), cuts.append((None, None))
                    continue
                a, z = int(first[i]), int(second[i])
                spm = h[i, 3] % 100 < spm_below
                form.append("spm" if spm else "psm"), cuts.append((a, z - a))
                output.append(f"{s}{t[z:]}{p}{t[:a]}{m}{t[a:z]}" if spm else f"{p}{t[:a]}{s}{t[z:]}{m}{t[a:z]}")
            columns = [pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(form, pa.string())]
            columns += [pa.array([c[j] for c in cuts], pa.int64()) for j in (0, 1)] + [pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(arranged, OUT).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again. The marks stand once each in what is not plain."""
    parts = F.split(output, "|".join("\\Q" + x + "\\E" for x in marks))
    first, second, third = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = arrange(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || doc_id) h from documents),
k as (select doc_id, t, length(t) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) z,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from k),
o as (select *, substring(t, 1, a) p, substring(t, a + 1, z - a) m, substring(t, z + 1) s from f)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then z - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from o
"""
