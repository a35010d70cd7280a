"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is the sequence of its shingles of `k` words, each labelled with which occurrence of that shingle it is. A sketch
holds, for each of `n_sketches` orders, the `ell` least labelled shingles, in the order of the text. Documents that share
one are candidates, so texts are found whose shingles agree and agree in order. Candidates are aligned within the band
that the threshold allows: similarity is m / (a + b - m), with m the shingles of the best alignment and a and b all
shingles of either; 0.8 or more makes a link. Texts of at most `SHORT` shingles are candidates also where they are the same but
for one shingle in either, so that at 0.8 none of their links depends on the sketches.

Texts with equal words are one representative from the start. A bucket holds the texts that share a sketch entry. First, in
at most `rounds` rounds, texts are paired with the bucket's leader alone: in the first round the text whose entries are the most
popular, which is the original of a family if it is there, later the least in one of `N_ORDERS` random orders that
change from sketch to sketch and from round to round. Linked texts stay and may lead. These rounds only save work: they join
families at a cost that grows with the texts, and end as soon as few pairs are left.

Then no link within a bucket is left out. In a bucket where at most `FEW` texts are outside its largest class, these are aligned
with all texts of other classes. Texts of all other buckets make the hot set, and all links within it are found by prefixes: their
shingles are ordered by how many texts of the set have them (in counters of a fixed number, so about), rare ones first, and two texts of sizes
a and b that agree in m or more shingles share one of the first a - m + 1 and b - m + 1. These are the keys under which a text is met;
one that very many texts have is a key only together with each further one. Inside a key a text meets those of possible sizes and other
classes, if what follows both places can still agree enough. Copies edited at different places share
their common shingles alone, which stand behind their own rare ones and so outside the prefixes: they are no pairs.
Classes are the connected components of the links, found by contracting stars.

Defined results: a text without words (null, empty or blank) is alone in its class. A text of fewer than k words has one
shingle, all its words. Rows that repeat an id are documents of their own, told apart by their texts' hashes; the class
takes the id of its first row (null ids are first). An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, windows
from .common import cut, forget, written

U = np.uint64
N_ORDERS = 3
FEW = 16
#: Counters of shingles, entries of a bucket, pairs that are looked at together, and texts that make a shingle no key by itself.
COUNTERS, ENTRIES, PAIRS, OFTEN = 1 << 20, 1 << 18, 1 << 20, 4096
#: Texts of so many shingles at most have entries of their own: two of them that agree in 0.8 are the same but for one shingle in either.
SHORT = 9


def shingles(values: np.ndarray, k: int) -> np.ndarray:
    """Labelled shingle hashes of a document's words, in order; all different."""
    n = len(values)
    if n == 0:
        return values
    begin = np.arange(max(1, n - k + 1))
    grams = kernels.Spans(values, 0)(begin, np.minimum(begin + k, n))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if new.all():
        return grams
    first = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    label = np.empty(len(grams), U)
    label[order] = (np.arange(len(grams)) - first).astype(U)
    return np.where(label > 0, kernels.mix(grams + label * U(kernels.BASES[0])), grams)


def sketch(labelled: np.ndarray, n_sketches: int, ell: int) -> np.ndarray:
    """One hash for each order: of its `ell` least shingles as they follow one another in the text."""
    seeds = kernels.mix(np.arange(1, n_sketches + 1, dtype=U) * U(kernels.BASES[1]))
    take = min(ell, len(labelled))
    at = np.empty((n_sketches, take), np.int64)
    step = max(1, (1 << 20) // len(labelled))
    for i in range(0, n_sketches, step):
        keys = (labelled[None] ^ seeds[i : i + step, None]) * U(kernels.BASES[0])
        keys ^= keys >> U(29)
        at[i : i + step] = np.argpartition(keys, take - 1, axis=1)[:, :take]
    at.sort(axis=1)
    out = seeds.copy()
    for j in range(take):
        out = kernels.mix(out * U(kernels.BASES[0]) + labelled[at[:, j]])
    return out


def short_entries(labelled: np.ndarray) -> np.ndarray:
    """Hashes of a short text's whole sequence and of all that lack one shingle, which links of short texts share for sure."""
    n = len(labelled)
    if n > SHORT:
        return np.zeros(0, U)
    out = []
    for gone in range(n + 1) if n > 1 else (n,):
        h = kernels.mix(np.array([kernels.BASES[1] ^ kernels.BASES[0]], U))
        for x in np.delete(labelled, gone) if gone < n else labelled:
            h = kernels.mix(h * U(kernels.BASES[0]) + x)
        out.append(h)
    return np.concatenate(out)


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity of two labelled shingle sequences, or 0 where it is sure to be under the threshold."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return 0.0
    least = int(np.ceil(threshold * (na + nb) / (1 + threshold) - 1e-9))
    if min(na, nb) < least:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(na, nb) - least  # a match farther off the diagonal leaves too few others
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    if len(ia) < least:
        return 0.0
    ib = ib[np.argsort(ia)]
    m = len(ib)
    if not (np.diff(ib) > 0).all():
        tails: list[int] = []
        for j in ib.tolist():
            i = bisect_left(tails, j)
            if i == len(tails):
                tails.append(j)
            else:
                tails[i] = j
        m = len(tails)
    return m / (na + nb - m)


def sketches(docs: DataFrame, k: int, n_sketches: int, ell: int) -> DataFrame:
    """docs: key, text. key, two hashes of all words (null without words), number of shingles, entries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            values, at = windows.word_units(b.column(1))
            whole, sizes, entries = [], [], []
            for i in range(b.num_rows):
                own = values[at[i] : at[i + 1]]
                if len(own):
                    ends = np.array([len(own)])
                    whole.append([int(kernels.Spans(own, j)(np.array([0]), ends).view(np.int64)[0]) for j in (0, 1)])
                    labelled = shingles(own, k)
                    sizes.append(len(labelled))
                    entries.append(np.append(sketch(labelled, n_sketches, ell), short_entries(labelled)).view(np.int64))
                else:
                    whole.append([None, None])
                    sizes.append(0)
                    entries.append(np.zeros(0, np.int64))
            cols = [b.column(0), *[pa.array([w[j] for w in whole], pa.int64()) for j in (0, 1)], pa.array(sizes, pa.int32()), pa.array(entries, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "w1", "w2", "size", "entries"])

    return docs.select("key", "text").mapInArrow(task, "key bigint, w1 bigint, w2 bigint, size int, entries array<bigint>")


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """docs: key, text. key, and the labelled shingles in order, 8 bytes each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            values, at = windows.word_units(b.column(1))
            own = [shingles(values[x:y], k).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["key", "seq"])

    return docs.select("key", "text").mapInArrow(task, "key bigint, seq binary")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs: a, b. Those whose shingles (key, seq) are similar, with the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 2, 4 << 20):
            x, y = (b.column(i).to_numpy() for i in (0, 1))
            s = np.array([alignment(np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U), threshold) for p, q in zip(b.column(2), b.column(3), strict=True)])
            yes = s >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(x[yes]), pa.array(y[yes]), pa.array(s[yes])], ["a", "b", "similarity"])

    right = pairs.hint("merge").join(texts.select(F.col("key").alias("b"), F.col("seq").alias("seq_b")), "b")
    both = right.hint("merge").join(texts.select(F.col("key").alias("a"), F.col("seq").alias("seq_a")), "a")
    return both.select("a", "b", "seq_a", "seq_b").mapInArrow(task, "a bigint, b bigint, similarity double")


def stars(links: DataFrame) -> DataFrame:
    """links: a, b. node, label: a node near each node that has a link, the most linked one of its own and its neighbours' choice.

    Nodes of one label are connected, and most of those connected have one label. Ties go by hash, so that chains shrink too.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    own = written(degree.select("node", F.struct("n", F.xxhash64("node").alias("h"), F.col("node").alias("label")).alias("by")), "degree")
    seen = both.join(own.select(F.col("node").alias("other"), "by"), "other").select("node", "by")
    near = written(seen.unionByName(own).groupBy("node").agg(F.max("by")["label"].alias("label")), "near")
    forget(own)
    far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
    return near.join(far, "label").select("node", F.col("far").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node, label for each node with a link: the least node it is connected with.

    Every star becomes one node, until no links are left between different ones: as many steps as the logarithm of the longest chain.
    """
    edges, labels = written(links.select("a", "b"), "edges"), None
    while True:
        near = written(stars(edges), "stars")
        later = near.select(F.col("node").alias("label"), F.col("label").alias("later"))
        new = written(near if labels is None else labels.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label")), "labels")
        a, b = (near.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        fewer = written(moved.distinct(), "edges")
        for used in (near, edges, *([] if labels is None else [labels])):
            forget(used)
        labels, edges = new, fewer
        if edges.isEmpty():
            break
    forget(edges)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return labels.join(least, "label").select("node", F.col("least").alias("label"))


def possible(a: Column, b: Column, threshold: float) -> Column:
    """Whether two different texts of a and b shingles can be similar: all shingles aligned would make them equal."""
    least = F.ceil(threshold * (a + b) / (1 + threshold) - F.lit(1e-9))
    return (F.least(a, b) >= least) & (F.greatest(a, b) > least)


def crossing(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Those entries (rep, size, entry, order) whose buckets hold texts of different classes, with the label of each."""
    own = entries.select("rep", "size", "entry", "order").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = written(own.withColumn("label", F.coalesce("label", "rep")), "labelled")
    mixed = own.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("entry")
    out = written(own.join(mixed, "entry"), "crossing")
    forget(own)
    return out


def outside(crossed: DataFrame) -> DataFrame:
    """entry, largest (the class with the most texts of the bucket), n (texts of others), of (all texts)."""
    counts = crossed.groupBy("entry", "label").agg(F.count(F.lit(1)).alias("c"))
    by = counts.groupBy("entry").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("of"))
    return by.select("entry", F.col("top.label").alias("largest"), (F.col("of") - F.col("top.c")).alias("n"), "of")


def crossing_pairs(crossed: DataFrame, largest: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of different classes that share one of the buckets of `largest` and can be similar.

    Of a bucket's largest class no two texts are ever joined with one another: the others, few, are joined with all.
    """
    own = crossed.join(largest, "entry")
    x = own.where("label <> largest").select("entry", F.col("rep").alias("x"), F.col("size").alias("x_size"), F.col("label").alias("x_label"))
    y = own.select("entry", F.col("rep").alias("y"), F.col("size").alias("y_size"), F.col("label").alias("y_label"), (F.col("label") == F.col("largest")).alias("in_largest"))
    both = x.join(y, "entry").where((F.col("x_label") != F.col("y_label")) & (F.col("in_largest") | (F.col("x") < F.col("y"))) & possible(F.col("x_size"), F.col("y_size"), threshold))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def counters(texts: DataFrame) -> np.ndarray:
    """How many texts hold shingles of each of COUNTERS hashes: a table of fixed size, whatever the number of shingles."""
    chunk = 1 << 14

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(counter_of(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64)), minlength=COUNTERS)
        some = [i for i in range(0, COUNTERS, chunk) if n[i : i + chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([n[i : i + chunk].tobytes() for i in some], pa.binary())], ["at", "n"])

    def added(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [own["at"].iloc[0]], "n": [sum(np.frombuffer(x, np.int64) for x in own["n"]).tobytes()]})

    parts = texts.select("seq").mapInArrow(task, "at int, n binary").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(32)))
    out = np.zeros(COUNTERS, np.int64)
    for r in parts.groupBy("at", "some").applyInPandas(added, "at int, n binary").groupBy("at").applyInPandas(added, "at int, n binary").collect():
        out[r["at"] : r["at"] + chunk] = np.frombuffer(r["n"], np.int64)
    return out


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (kernels.mix(shingles.view(np.uint64)) >> np.uint64(64 - int(COUNTERS).bit_length() + 1)).astype(np.int64)


def prefix_of(seq: np.ndarray, counts: np.ndarray, threshold: float, often: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a text is met, and the place of each key's shingle in the text's order, from 0.

    The order is by counter, then by value: the same for all texts, rare shingles first. Two similar texts share a shingle among as many as one
    more than need not agree; and two among one more than these, where they have two. A shingle that very many texts hold is no key by itself, but
    with each other one of these: so a hot key is split, and no pair is lost.
    """
    size = len(seq)
    n = counts[counter_of(seq)]
    order = np.lexsort((seq, n))
    free = size - int(np.ceil(threshold * size - 1e-9))  # that need not agree with any partner
    first, wider = order[: free + 1], order[: free + 2]
    hot = (n[first] > often) & (size > 1)
    keys, at = [seq[first[~hot]].view(np.uint64)], [np.flatnonzero(~hot)]
    for i in np.flatnonzero(hot):
        others = seq[np.delete(wider, i)].view(np.uint64)
        keys.append(kernels.mix(others) ^ kernels.mix(seq[first[i] : first[i] + 1].view(np.uint64)))
        at.append(np.full(len(others), i))
    return np.concatenate(keys), np.concatenate(at)


def met_in(entries: np.ndarray, threshold: float) -> np.ndarray:
    """a, b: pairs of different classes that share a key and whose sizes and places leave room for the threshold; each once."""
    entries = entries[np.lexsort((entries["size"], entries["key"]))]
    size, key = entries["size"].astype(np.float64), entries["key"]
    ends = np.searchsorted(key, key, "right")  # the partners of a row are behind it, up to the largest size that is possible
    most = np.floor(size / threshold + 1e-9)
    # sorted by key and size: a row's last partner is found by one search over both
    rank = np.searchsorted(np.unique(key), key).astype(np.float64)
    wide = size.max(initial=0) / threshold + 2
    stop = np.minimum(ends, np.searchsorted(rank * wide + size, rank * wide + most, "right"))
    n = np.maximum(stop - np.arange(len(entries)) - 1, 0)
    found, i = [np.zeros((0, 2), np.int64)], 0
    total = np.concatenate([[0], np.cumsum(n)])
    while i < len(entries):  # some pairs at a time
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        left = np.repeat(np.arange(i, j), n[i:j])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - total[i], n[i:j])
        a, b = entries[left], entries[right]
        sizes = a["size"].astype(np.int64) + b["size"]
        need = np.ceil(threshold * sizes / (1 + threshold) - 1e-9)
        room = np.minimum(a["size"] - a["at"], b["size"] - b["at"]) >= need
        fits = (np.minimum(a["size"], b["size"]) >= need) & (np.maximum(a["size"], b["size"]) > need)
        ok = (a["label"] != b["label"]) & room & fits
        found.append(np.stack([np.minimum(a["rep"], b["rep"])[ok], np.maximum(a["rep"], b["rep"])[ok]], axis=1))
        found = [np.unique(np.concatenate(found), axis=0)]
        i = j
    return found[0]


def prefix_pairs(hot: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """hot: rep, size, label (unique reps). a, b: all pairs of different classes whose prefixes leave room for `threshold`.

    Entries go packed, by buckets of keys, and are met inside a bucket in numpy: what becomes rows are pairs.
    """
    own = written(hot.join(texts, F.col("rep") == F.col("key")).select("rep", "size", "label", "seq"), "prefixed")
    counts = counters(own)
    often = OFTEN + 2 * int(counts.mean())
    known = own.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
    total = own.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-int(total * (1 - threshold) + own.count()) // ENTRIES))
    kind = np.dtype([("key", np.uint64), ("rep", np.int64), ("label", np.int64), ("size", np.int32), ("at", np.int32)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            rows = np.concatenate(held)
            bucket = (kernels.mix(rows["key"]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            parts = np.split(rows[order], starts[1:])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "entries"])

        for b in cut(batches, 3):
            for rep, size, label, seq in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                keys, at = prefix_of(np.frombuffer(seq, np.int64), known.value, threshold, often)
                rows = np.zeros(len(keys), kind)
                rows["key"], rows["rep"], rows["label"], rows["size"], rows["at"] = keys, rep, label, size, at
                held.append(rows)
                n += len(rows)
            if n > ENTRIES:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        found = met_in(np.frombuffer(b"".join(group["entries"]), kind), threshold)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    packed = own.mapInArrow(task, "bucket int, entries binary")
    out = written(packed.groupBy("bucket").applyInPandas(pairs, "a bigint, b bigint").distinct(), "met")
    forget(own)
    return out


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right, which has a row for each key at most. Keys that have over a thousandth of left's rows, and so

    at most 1000 of them, are broadcast; all others have few rows each.
    """
    limit = left.count() / 1000
    often = left.groupBy(*on).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit).select(*on)
    heavy = written(right.join(F.broadcast(often), on), "heavy")
    light = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right, on)
    return light.unionByName(left.join(F.broadcast(heavy), on))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, n_sketches: int = 32, ell: int = 5, rounds: int = 1) -> DataFrame:
    """id, class_id, n_links (links of the text's representative that were found), kept (first of its class)."""
    own = windows.keyed(docs, key, text)
    marks = written(sketches(own, k, n_sketches, ell), "sketches")
    texts_of = written(marks.where("w1 is not null").groupBy("w1", "w2").agg(F.min("key").alias("rep")), "texts_of")
    # merge joins, also where one side is small: what is shuffled then grows as the input does
    reps = marks.join(texts_of.select("rep").hint("merge"), F.col("key") == F.col("rep")).select("rep", "size", F.posexplode("entries").alias("band", "entry"))
    entries = written(reps.select("rep", "size", "entry", F.pmod("band", F.lit(N_ORDERS)).alias("order")), "entries")
    shared = written(entries.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    todo = entries.join(shared.hint("merge"), "entry")
    fame = todo.groupBy("rep").agg(F.sum("c").alias("fame"))
    todo = written(todo.drop("c").join(fame.hint("merge"), "rep").withColumn("label", F.col("rep")), "shared")
    forget(entries)
    forget(shared)
    texts = written(shingled(own.join(todo.select(F.col("rep").alias("key")).distinct().hint("merge"), "key"), k), "texts")
    links, tried, n_entries, used = None, None, todo.count(), [todo]
    for turn in range(rounds + 1):
        buckets = None
        if turn > 0 or turn == rounds:
            buckets = written(outside(todo), "buckets")
            used.append(buckets)
            pairs_left = buckets.agg(F.sum(F.col("n").cast("double") * F.col("of"))).first()[0] or 0
        last = turn == rounds or (turn > 0 and pairs_left <= 4 * n_entries)
        if not last:
            order = -F.col("fame") if turn == 0 else F.xxhash64("rep", "order", F.lit(turn))
            by = F.struct(order.alias("x"), F.col("rep").alias("leader"), F.col("size").alias("leader_size"), F.col("label").alias("leader_label"))
            leaders = written(todo.groupBy("entry").agg(F.min(by).alias("by")).select("entry", "by.leader", "by.leader_size", "by.leader_label"), "leaders")
            used.append(leaders)
            pairs = todo.join(leaders, "entry").where((F.col("label") != F.col("leader_label")) & possible(F.col("size"), F.col("leader_size"), threshold))
            pairs = pairs.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
        else:
            pairs = crossing_pairs(todo, buckets.where(F.col("n") <= FEW).select("entry", "largest"), threshold)
            hot = written(todo.join(buckets.where(F.col("n") > FEW).select("entry"), "entry", "left_semi").select("rep", "size", "label").distinct(), "hot")
            used.append(hot)
            if not hot.isEmpty():
                met = prefix_pairs(hot, texts, threshold)
                used.append(met)
                pairs = pairs.unionByName(met).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        used.append(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = written(verified(pairs, texts, threshold), "links")
        used.append(new)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
        if last:
            break
        if links is not None:
            todo = crossing(todo, stars(links))
            used.append(todo)
    forget(texts)
    by_text = texts_of.withColumnsRenamed({"rep": "node"})
    if links is None:
        by_text = by_text.select("w1", "w2", F.col("node").alias("label"), F.lit(0).cast("bigint").alias("n_links"))
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        by_text = by_text.join(components(links), "node", "left").join(degree, "node", "left")
        by_text = by_text.select("w1", "w2", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    by_text = written(by_text, "classes")
    for table in (*used, texts_of):
        forget(table)
    kind = docs.schema[key].dataType.simpleString()
    worded = spread_join(marks.where("w1 is not null").select("key", "w1", "w2"), by_text, ["w1", "w2"]).select("key", "label", "n_links")
    named = worded.unionByName(marks.where("w1 is null").select("key", F.col("key").alias("label"), F.lit(0).cast("bigint").alias("n_links")))
    if not hasattr(own, "_quantloom_path"):  # the keys are the ids
        out = named.select(F.col("key").cast(kind).alias("id"), F.col("label").cast(kind).alias("class_id"), "n_links", (F.col("key") == F.col("label")).alias("kept"))
    else:
        named = written(named, "named")
        firsts = own.select(F.col("key").alias("label"), F.col("id").alias("class_id"))
        out = spread_join(named, firsts, ["label"]).join(own.select("key", "id"), "key").select("id", "class_id", "n_links", (F.col("key") == F.col("label")).alias("kept"))
    return out.withColumnRenamed("id", key)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their class, all their columns. For unique keys that are not null."""
    return docs.join(classes(docs.select(key, text), key, text).where("kept").select(key), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
