"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes of at least `length` bytes are ordered through their first `length` bytes only, by passes over digits of 8 bytes, most
significant first. After a pass the suffixes of one group agree in all bytes so far, and groups of one are done: they take no part in
the next. The groups left after the last pass are exactly the repeated strings; every byte they cover is removed, strings being judged
on the input. All passes compare bytes; hashes only deal suffixes to tasks and leave out those that can't repeat.

1. Of every string of `length` bytes the anchor is a gram of 64 bytes that depends on the string alone (kernels.anchors), so equal strings
   have equal anchors at equal places, and a suffix whose anchor stands nowhere else repeats nothing. Some fifty suffixes in a
   row share an anchor: a run. Texts lie in chunks of some 400 KB; a chunk sends each bucket the anchors in it, once each, and hears
   which of them stand elsewhere too.
2. An anchor with more than HOT different runs would fill a task. Its suffixes go on one by one, each as a run of its own, named by a hash of its whole
   string, and only if that name occurs again: names spread over all buckets however frequent the anchor is.
3. Chunks send the bytes of runs to the bucket of their names, equal runs of a chunk once. The task of a bucket takes equal runs as one, with
   their number, deals suffixes by anchor and distance to it, and then passes over digits. It answers with a bit a suffix: does its group have more than one?

So no position of a text is shuffled with a suffix, and the number of buckets grows with the input. Runs are sent in as many rounds
(8 at most), by name, as keep a round's bytes within three quarters of the texts' size. What stands in every chunk is sent by every chunk, 200
to 340 bytes each time: at very large inputs chunks should grow (64 MB at 100 TB).

Defined results: a null text is empty, and a text shorter than `length` is left whole (n_spans 0, the hash of all its
bytes). Matches never cross documents. Rows that repeat an id are documents of their own, so repeated long rows remove each
other; so are rows with a null id. An empty table gives no rows. Ids may be of any type. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, windows
from .common import batches_of, cut, forget, written

U = np.uint64
GRAM = 64
CHUNK = 3 << 17
BUCKET = 8 << 20
CLASSES = 8
ROUND = 0.75
#: Different runs of one anchor that a bucket takes.
HOT = 1 << 13
#: Bytes of runs that a bucket takes: its task holds some thirty times as much, as every byte begins a suffix.
ROOM = 2 << 20
#: A run of suffixes with one anchor: first start in the chunk's data, how many, how far on the anchor is, the first run of the chunk with
#: the same bytes, whether the anchor is hot, and its name.
RUN = np.dtype([("start", "i4"), ("n", "i4"), ("off", "i4"), ("own", "i4"), ("hot", "u1"), ("name", "u8")])
HEAD = np.dtype([("n", "i4"), ("off", "i4"), ("name", "u8")])
CHUNKS = "keys binary, base binary, size binary, data binary, n_suffixes bigint"
STATE = "chunk bigint, keys binary, base binary, size binary, data binary, n_suffixes bigint, n_hot bigint, load bigint, runs binary"
NAMES = "chunk bigint, bucket int, n int, names binary, counts binary"
TOLD = "chunk bigint, bucket int, n int, told binary"
SENT = "chunk bigint, bucket int, heads binary, more binary, data binary"
BITS = "chunk bigint, bucket int, n int, bits binary"


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns(schema))


def chunked(docs: DataFrame, length: int, chunk_bytes: int) -> DataFrame:
    """docs: key, text. Chunks of whole texts, or of parts of one long text that overlap so that each suffix is whole in one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, int, bytes]] = []
        held = 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(p) for _, _, p in pieces], np.int64)
            arrays = [np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64), sizes]
            suffixes = int((sizes - length + 1).sum())
            cols = [pa.array([a.tobytes()], pa.binary()) for a in arrays] + [pa.array([b"".join(p[2] for p in pieces)], pa.binary()), pa.array([suffixes], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["keys", "base", "size", "data", "n_suffixes"])

        for b in cut(batches, 1, chunk_bytes):
            data, at = kernels.bytes_of(b.column(1))
            for key, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for begin in range(0, max(0, hi - lo - length + 1), chunk_bytes):
                    piece = data[lo + begin : min(hi, lo + begin + chunk_bytes + length - 1)].tobytes()
                    if pieces and held + len(piece) > chunk_bytes:
                        yield row()
                        pieces, held = [], 0
                    pieces.append((key, begin, piece))
                    held += len(piece)
        if pieces:
            yield row()

    rows = docs.select("key", "text").mapInArrow(task, CHUNKS)
    return written(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks", block=4 << 20)


def numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def ordered(name: np.ndarray, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of names (by bucket, then name), and where groups of equal ones begin in it.

    Sorting numbers that hold the leading bits and the place is far quicker than sorting places; names that agree in these bits
    alone show afterwards and are sorted in full.
    """
    n = len(name)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = U(int(n).bit_length())
    bits = 32 if name.dtype == np.uint32 else 64
    top = name.astype(U) << U(64 - bits)
    lead = U(0)
    if bucket is not None:
        lead = U(int(bucket.max()).bit_length())
        top = (top >> lead) | (bucket << (U(64) - lead) if lead else U(0))
    packed = (top >> low << low) | np.arange(n, dtype=U)
    packed.sort()
    order = (packed & ((U(1) << low) - U(1))).astype(np.int64)
    ranked = name[order]
    new = np.empty(n, bool)
    new[0], new[1:] = True, ranked[1:] != ranked[:-1]
    if bucket is not None:
        new[1:] |= bucket[order[1:]] != bucket[order[:-1]]
    if bits > 64 - int(low) - int(lead):
        lost = packed >> low
        if (new[1:] & (lost[1:] == lost[:-1])).any():
            order = np.lexsort((name,) if bucket is None else (name, bucket))
            ranked = name[order]
            new[1:] = ranked[1:] != ranked[:-1]
            if bucket is not None:
                new[1:] |= bucket[order[1:]] != bucket[order[:-1]]
    return order, np.flatnonzero(new)


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> U(32)) * U(buckets)) >> U(32)


def runs_at(start, n, off, name) -> np.ndarray:
    out = np.zeros(len(start), RUN)
    out["start"], out["n"], out["off"], out["name"] = start, n, off, name
    return out


def anchored(length: int):
    """Of a chunk: all runs, what tells their bytes apart, and no runs that need no asking."""

    def asked(data: np.ndarray, size: np.ndarray, runs: bytes | None):
        at = np.append(0, np.cumsum(size))
        found = [(np.zeros(0, RUN), np.zeros(0, U))]
        for _, part, _ in kernels.stretches(at, length):  # stretches of some bytes, so that sums and powers stay small
            lo, hi = part[0], part[-1]
            start, n, place, gram, whole = kernels.anchors(kernels.byte_values(0)[data[lo:hi]], part - lo, length, min(GRAM, (length + 1) // 2))
            # an anchor has the least hash of many: mixed, so that names spread over buckets
            found.append((runs_at(start + lo, n, place - start, kernels.mix(gram)), whole))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.zeros(0, RUN)

    return asked


def single(length: int):
    """Of a chunk: the suffixes of hot anchors, each named by its whole string; and the other runs."""

    def asked(data: np.ndarray, size: np.ndarray, runs: bytes | None):
        known = np.frombuffer(runs, RUN)
        hot = known[known["hot"] > 0]
        own, i = windows.runs_of(hot["n"].astype(np.int64))
        start = hot["start"][own] + i
        name = kernels.Spans(kernels.byte_values(1)[data], 1)(start, start + length)
        return runs_at(start, 1, 0, name), name, known[known["hot"] == 0]

    return asked


def send_names(chunks: DataFrame, asked, buckets: int) -> DataFrame:
    """What the chunks (chunk, size, data, runs) send to the buckets: each name once, with twice the number of its different runs, and one more if it stands there twice."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, size, raw, known in zip(*(b.column(i) for i in range(4)), strict=True):
                runs, whole, _ = asked(np.frombuffer(raw.as_buffer(), np.uint8), numbers(size.as_py()), known.as_py())
                if not len(runs):
                    continue
                name = runs["name"].copy()
                bucket = bucket_of(name, buckets)
                order, first = ordered(name, bucket)
                fresh = np.zeros(len(name), np.int64)
                fresh[np.unique(whole, return_index=True)[1]] = 1
                counts = np.minimum(np.add.reduceat(fresh[order], first), 0x7FFF) * 2 + (np.diff(np.append(first, len(order))) > 1)
                counts, name, bucket = counts.astype(np.uint16), name[order[first]], bucket[order[first]]
                edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U)).tolist()
                yield batch([(chunk.as_py(), j, hi - lo, name[lo:hi].tobytes(), counts[lo:hi].tobytes()) for j, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo], NAMES)

    return chunks.select("chunk", "size", "data", "runs").mapInArrow(task, NAMES)


def told_names(hot: int):
    """For the rows of a bucket: a byte for each name, 0 if it stands at one place only, else 1, or 2 if it has more than `hot` different runs."""

    def task(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        name = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in table.column("names")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("counts")]).astype(np.int64)
        order, first = ordered(name)
        sums = [np.add.reduceat(c[order], first) for c in (1 + (counts & 1), counts >> 1)]
        found = (sums[0] > 1).astype(np.uint8) * (1 + (sums[1] > hot)).astype(np.uint8)
        out = np.empty(len(name), np.uint8)
        out[order] = np.repeat(found, np.diff(np.append(first, len(name))))
        edges = np.append(0, np.cumsum(n)).tolist()
        told = [out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(n.astype(np.int32)), pa.array(told, pa.binary())], columns(TOLD))

    return task


def heard_names(chunks: DataFrame, answers: DataFrame, asked, buckets: int, length: int) -> DataFrame:
    """The chunks with the runs whose names stand elsewhere too. load: the bytes of different runs."""
    each = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias("told"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                raw = b.column(4)[r].as_buffer()
                runs, _, rest = asked(np.frombuffer(raw, np.uint8), numbers(b.column(3)[r].as_py()), b.column(5)[r].as_py())
                if len(runs):
                    name = runs["name"].copy()
                    order, first = ordered(name, bucket_of(name, buckets))
                    told = np.frombuffer(b"".join(t["told"] for t in sorted(b.column(6)[r].as_py(), key=lambda t: t["bucket"])), np.uint8)
                    state = np.empty(len(runs), np.uint8)
                    state[order] = np.repeat(told, np.diff(np.append(first, len(order))))
                    runs["hot"] = state == 2
                    runs = runs[state > 0]
                runs = np.concatenate([rest, runs])
                if not len(runs):
                    continue
                data, seen, load = raw.to_pybytes(), {}, 0
                size = runs["n"] - 1 + length
                for i, (at, m, off) in enumerate(zip(runs["start"].tolist(), size.tolist(), runs["off"].tolist(), strict=True)):
                    own = seen.setdefault((off, data[at : at + m]), i)
                    runs["own"][i] = own
                    load += m if own == i else 0
                yield batch([(*(b.column(c)[r].as_py() for c in range(4)), data, int(runs["n"].sum()), int(runs["n"][runs["hot"] > 0].sum()), load, runs.tobytes())], STATE)

    both = chunks.join(each, "chunk", "left")
    both = both.withColumn("told", F.coalesce("told", F.array().cast("array<struct<bucket:int,told:binary>>")))
    return both.select("chunk", "keys", "base", "size", "data", "runs", "told").mapInArrow(task, STATE)


def dealt(known: bytes, rounds: int, turn: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All runs of a chunk; which of them are in a round, and of these the different ones by bucket, and where buckets begin."""
    runs = np.frombuffer(known, RUN)
    on = np.flatnonzero((runs["name"] & U(CLASSES - 1)) * U(rounds) // U(CLASSES) == U(turn))
    first = on[runs["own"][on] == on]
    bucket = bucket_of(runs["name"][first], buckets)
    order = np.argsort(bucket, kind="stable")
    return runs, on, first[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U)).tolist()


def send_runs(state: DataFrame, rounds: int, turn: int, buckets: int, length: int) -> DataFrame:
    """The bytes of the runs of one round, with a bit for those that stand in the chunk more than once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, raw, known in zip(*(b.column(i) for i in range(3)), strict=True):
                runs, on, first, edges = dealt(known.as_py(), rounds, turn, buckets)
                if not len(first):
                    continue
                data = memoryview(raw.as_buffer())
                more = np.bincount(runs["own"][on], minlength=len(runs))[first] > 1
                head = np.empty(len(first), HEAD)
                for c in HEAD.names:
                    head[c] = runs[c][first]
                start = runs["start"][first]
                spans = list(zip(start.tolist(), (start + head["n"] - 1 + length).tolist(), strict=True))
                chunk = chunk.as_py()
                yield batch([(chunk, j, head[lo:hi].tobytes(), np.packbits(more[lo:hi]).tobytes(), b"".join(data[x:y] for x, y in spans[lo:hi])) for j, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo], SENT)

    return state.select("chunk", "data", "runs").mapInArrow(task, SENT)


def left_over(data: bytes, at: np.ndarray, group: np.ndarray, weight: np.ndarray, ends: list[int]) -> np.ndarray:
    """Which of the suffixes of data that begin at `at` are in a group of more than one after all digits.

    group: what they are dealt by at first; suffixes of different groups differ. weight: how often each stands. Digits end at `ends`,
    8 bytes apart at most, and data has 7 bytes more than the last suffix covers.
    """
    digits = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    hit = np.zeros(len(at), bool)
    order, first = ordered(group)
    begin = -1
    for end in (0, *ends):
        sizes = np.diff(np.append(first, len(order)))
        if end:
            digit = digits[at[order] + begin].astype(U) >> U(8 * (8 - end + begin))
            differs = digit != np.repeat(digit[first], sizes)
            if not differs.any():
                begin = end
                continue
            # groups that part are sorted by this digit; in the others all suffixes have the same
            own = np.repeat(np.arange(len(first)), sizes)
            parts = np.zeros(len(first), bool)
            parts[own[differs]] = True
            some = np.flatnonzero(parts[own])
            by = some[np.lexsort((digit[some], own[some]))]
            order[some], digit[some] = order[by], digit[by]
            new = np.append(True, digit[1:] != digit[:-1])
            new[first] = True
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(order)))
        begin = end
        alone = sizes == 1
        done = order[first[alone]]
        hit[done] = weight[done] > 1
        order = order[np.repeat(~alone, sizes)]
        if not len(order):
            return hit
        first = np.append(0, np.cumsum(sizes[~alone])[:-1])
    hit[order] = True
    return hit


def sorted_bucket(length: int, ends: list[int]):
    """For the rows of a bucket: a bit for each suffix of each run, whether its string stands more than once."""

    def task(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x.as_buffer(), HEAD) for x in table.column("heads")]
        counts = [len(h) for h in heads]
        more = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table.column("more"), counts, strict=True)])
        head = np.concatenate(heads)
        n, off = head["n"].astype(np.int64), head["off"].astype(np.int64)
        data = b"".join([x.as_buffer() for x in table.column("data")] + [bytes(8)])
        at = np.append(0, np.cumsum(n - 1 + length))
        # equal runs are one, with the number of times they stand
        seen: dict[tuple[int, bytes], int] = {}
        own = np.array([seen.setdefault((o, data[x:y]), i) for i, (o, x, y) in enumerate(zip(off.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))])
        weight = np.bincount(own, 1 + more.astype(np.int64), minlength=len(n))
        first = np.flatnonzero(own == np.arange(len(n)))
        run, i = windows.runs_of(n[first])
        anchor = np.unique(head["name"][first], return_inverse=True)[1]
        group = (anchor[run] * (int(off.max()) + 1) + off[first][run] - i).astype(U)
        where, own_weight = at[first][run] + i, weight[first][run]
        del seen, anchor, run, i
        hit = left_over(data, where, spread(group), own_weight, ends)
        del where, own_weight, group
        begin = np.zeros(len(n), np.int64)
        begin[first] = np.append(0, np.cumsum(n[first])[:-1])
        run, i = windows.runs_of(n)
        hit = hit[begin[own][run] + i]
        edges = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))].tolist()
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(np.diff(edges).astype(np.int32)), pa.array(bits, pa.binary())], columns(BITS))

    return task


def spread(x: np.ndarray) -> np.ndarray:
    """Small numbers moved to the leading bits, by which `ordered` sorts first."""
    return x << U(64 - max(1, int(x.max()).bit_length())) if len(x) else x


def marks_of(state: DataFrame, answers: DataFrame, rounds: int, buckets: int) -> DataFrame:
    """key, marks array<struct<start, n>>: n suffixes of the text of that key, from start on, are repeated. No text is read here."""
    each = answers.groupBy("chunk").agg(F.collect_list(F.struct("turn", "bucket", "n", "bits")).alias("told"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, base, size, known, told in zip(*(b.column(i) for i in range(5)), strict=True):
                keys, base, size, known = numbers(keys.as_py()), numbers(base.as_py()), numbers(size.as_py()), known.as_py()
                told = sorted(((t["turn"], t["bucket"], t["n"], t["bits"]) for t in told.as_py()), key=lambda t: t[:2])
                alive = np.zeros(int(size.sum()), bool)
                for turn in range(rounds):
                    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for t, _, n, x in told if t == turn]
                    if not bits:
                        continue
                    runs, on, first, _ = dealt(known, rounds, turn, buckets)
                    n = runs["n"].astype(np.int64)
                    begin = np.zeros(len(runs), np.int64)
                    begin[first] = np.append(0, np.cumsum(n[first])[:-1])
                    run, i = windows.runs_of(n[on])
                    alive[runs["start"][on][run] + i] = np.concatenate(bits)[begin[runs["own"][on]][run] + i]
                at = np.append(0, np.cumsum(size))
                on = np.flatnonzero(alive)
                piece = np.searchsorted(at, on, "right") - 1
                new = np.append(True, (np.diff(on) > 1) | (np.diff(piece) > 0))[: len(on)]
                first = np.flatnonzero(new)
                n, piece, on = np.diff(np.append(first, len(on))), piece[first], on[first]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[piece], base[piece] + on - at[piece], n)], ["key", "start", "n"])

    both = state.select("chunk", "keys", "base", "size", "runs").join(each, "chunk")
    rows = both.select("keys", "base", "size", "runs", "told").mapInArrow(task, "key bigint, start bigint, n bigint")
    return rows.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def repeated(docs: DataFrame, length: int, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET, depths: tuple[int, ...] = (), hot: int = HOT) -> DataFrame:
    """docs: key (unique, not null), text. Returns key, marks: the suffixes left after the last pass.

    depths: further ends of digits, besides every eighth byte. hot: different runs of an anchor that a bucket takes.
    """
    spark = docs.sparkSession
    with batches_of(spark, 4):  # chunks in an Arrow batch
        chunks = chunked(docs, length, chunk_bytes)
        n_bytes, n = chunks.agg(F.sum(F.octet_length("data")), F.sum("n_suffixes")).first()
        state = chunks.withColumn("runs", F.lit(None).cast("binary"))
        for asked, share in ((anchored(length), 20), (single(length), 1)):  # some twenty suffixes have one anchor at least
            buckets = max(1, (n or 0) // share * 8 // bucket_bytes)
            told = written(send_names(state, asked, buckets).groupBy("bucket").applyInArrow(told_names(hot), TOLD), "answers")
            new = written(heard_names(state, told, asked, buckets, length), "runs", block=4 << 20)
            forget(told)
            forget(chunks)
            chunks = state = new
            n, load = state.agg(F.sum("n_hot"), F.sum("load")).first()
            if not n:
                break
        load = load or 0
        room = min(bucket_bytes, ROOM)
        rounds = next(r for r in (1, 2, 4, 8) if r == CLASSES or load <= r * max(ROUND * (n_bytes or 0), 8 * bucket_bytes))
        buckets = max(1, -(-load // (rounds * room)))
        ends = sorted({*range(8, length, 8), *(d for d in depths if 0 < d < length), length})
        told = []
        for turn in range(rounds):
            got = send_runs(state, rounds, turn, buckets, length).groupBy("bucket").applyInArrow(sorted_bucket(length, ends), BITS)
            told.append(written(got.withColumn("turn", F.lit(turn)), "answers"))
        every = told[0]
        for t in told[1:]:
            every = every.unionByName(t)
        out = written(marks_of(state, every, rounds, buckets), "marks")
        for used in (*told, state):
            forget(used)
    return out


def marked(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id, text, marks."""
    own = windows.keyed(docs, key, text)
    return own.join(repeated(own, length), "key", "left")


def remove_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            data, at = kernels.bytes_of(b.column(1))
            marks = b.column(2)
            out = []
            for i in range(b.num_rows):
                own = data[at[i] : at[i + 1]]
                removed = spans = 0
                if marks[i].is_valid:
                    flat = marks[i].values
                    gone = windows.covered(len(own), flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64), length)
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                kept = own.tobytes()
                out.append((at[i + 1] - at[i], removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = [b.column(0)] + [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = marked(docs, length, key, text).select("id", "text", "marks")
    return rows.mapInArrow(task, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("id", key)


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*RESULT)
