"""SentencePiece segmentations sampled without replacement, and their decoding.

The lattice of a text has an edge for every piece of the model that matches; characters without a piece go by their UTF-8
bytes, as in the library. A piece of merge rank r weighs (r + 10) ** -alpha, and a segmentation the product of its pieces'. Single
characters and runs of blanks, which no merge makes, have their number as rank.

Sampling is top-down A* on log weights with Gumbel noise. A node of the search is a set of segmentations: a fixed beginning,
one stretch of the text that must differ from what was taken before, and a free rest. Its bound is the largest perturbed log
probability in the set, drawn as a Gumbel truncated at its parent's. The node with the largest bound is popped, its best
member is emitted, and what is left of it is split at each stretch where another member can first differ. So the k emitted are
distinct, a sample without replacement, in order. `inclusion` is the probability that a segmentation passes the
threshold, the bound of the first one not emitted.

No piece crosses from a word to a blank behind it, nor a line end, so the lattice is a chain of small ones, one for each
stretch: a word with the blanks before it. Their inside weights are summed once for each distinct stretch of a batch, and paths of
all its stretches are drawn together. All noise is a hash of the row's key, the place and the draw. Bounds so far down that no
noise could lift them are not drawn.

Defined results: a null text is empty; an empty text has one segmentation, of no pieces, with inclusion 1. Texts with fewer
than k segmentations give fewer rows, with inclusion 1, and none is held for weightless: what is left of a stretch beside those taken is
summed up, not taken off 1, where it is small. Rows that repeat a key and text give the same samples. Keys may be of any type; null keys share one
seed. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import cut

U = np.uint64
SPACE = "▁"
STRETCHES = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: No noise is larger: the largest Gumbel of a draw by `uniform`.
MOST_NOISE = 37.5

class Lattices:
    """Lattices of stretches as one automaton: a state for each place, its edges side by side.

    `reach` of an edge is its state's number plus the share of the state's weight up to and with this edge: a draw takes the
    first edge that reaches beyond it. All stretches of a batch are built together, column by column.
    A piece below 0 stands for the bytes of a character that has no piece (see `spelled`).
    """

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_of, self.of_byte, pieces = [], {}, []
        for i in range(self.model.get_piece_size()):
            piece, score = self.model.id_to_piece(i), self.model.get_score(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
                self.of_byte[self.bytes_of[-1][0]] = i
                continue
            self.bytes_of.append(piece.encode("utf-8"))
            rank = -score if score > -1e8 else float(i) if len(piece) == 1 or not piece.strip(SPACE) else None  # pieces that no merge makes have no rank
            if rank is not None and not (self.model.is_control(i) or self.model.is_unknown(i)):
                pieces.append((piece, i, -alpha * np.log(10.0 + rank)))
        self.by_byte = -alpha * float(np.log(10.0 + len(self.bytes_of)))
        self.spelled: list[tuple[int, ...]] = []
        self.code_of: dict[int, int] = {}
        self.known = []  # by length: sorted hashes, their piece and log weight, and a filter by a part of the hash
        for n in range(1, max(len(p) for p, _, _ in pieces) + 1):
            own = [x for x in pieces if len(x[0]) == n]
            text = codes("".join(p for p, _, _ in own))
            begin = np.arange(len(own)) * n
            hashes = place_hash(text, begin, n)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(own):
                raise ValueError("two pieces have one hash")
            likely = np.zeros(1 << 20, bool)
            likely[hashes * U(kernels.BASES[1]) >> U(44)] = True
            self.known.append((hashes[order], np.array([i for _, i, _ in own], np.int64)[order], np.array([w for _, _, w in own])[order], likely))

    def code(self, char: int) -> int:
        """The piece of a character without one: its byte's, or a number below 0 for several bytes."""
        raw = chr(char).encode("utf-8", "surrogatepass")
        if len(raw) == 1:
            return self.of_byte[raw[0]]
        if char not in self.code_of:
            self.spelled.append(tuple(self.of_byte[b] for b in raw))
            self.code_of[char] = -len(self.spelled)
        return self.code_of[char]

    def expanded(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids) or ids.min() >= 0:
            return ids
        return np.array([y for x in ids.tolist() for y in ((x,) if x >= 0 else self.spelled[-x - 1])], np.int32)

    def prepare(self, distinct: list[str]) -> np.ndarray:
        """Build the lattices of these stretches; their start states."""
        text = codes("".join(distinct))
        at = np.append(0, np.cumsum([len(x) for x in distinct])).astype(np.int64)
        n = len(text)
        left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
        order = np.argsort(left, kind="stable")  # states in the order of what is left of their stretch
        state = np.empty(n, np.int64)
        state[order] = np.arange(n)
        spans = PlaceHashes(text)
        found, per_place = [], np.zeros(n, np.int64)
        for size, (hashes, ids, weights, likely) in enumerate(self.known, 1):
            here = np.flatnonzero(left >= size)
            h = spans(here, size)
            some = likely[h * U(kernels.BASES[1]) >> U(44)]
            here, h = here[some], h[some]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[k] == h
            here, k = here[hit], k[hit]
            found.append((here, size, ids[k], weights[k], per_place[here]))
            per_place[here] += 1
            if size == 1:
                bare = np.ones(n, bool)
                bare[here] = False
                bare = np.flatnonzero(bare)
                size_of = np.where(text[bare] < 0x80, 1, np.where(text[bare] < 0x800, 2, np.where(text[bare] < 0x10000, 3, 4)))
                found.append((bare, 1, np.array([self.code(int(c)) for c in text[bare]], np.int64), self.by_byte * size_of, per_place[bare]))
                per_place[bare] += 1
        per_state = per_place[order]
        first = np.append(0, np.cumsum(per_state))
        m = int(first[-1])
        piece, weight, then, share = np.empty(m, np.int32), np.empty(m), np.full(m, -1, np.int64), np.empty(m)
        for here, size, ids, weights, number in found:  # of a state's edges the longest comes first, as it is often the one
            e = first[state[here] + 1] - 1 - number
            piece[e], weight[e] = ids, weights
            inner = size < left[here]
            then[e[inner]] = state[here[inner] + size]
        inside = np.zeros(n + 1)  # log weights of all ends; the last is that of nothing left
        several = np.zeros(n + 1, bool)  # whether there is more than one way to go on
        level = np.append(0, np.cumsum(np.bincount(left)[1:])) if n else np.zeros(1, np.int64)
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b = first[lo], first[hi]
            w = weight[a:b] + inside[then[a:b]]
            begins, counts = first[lo:hi] - a, per_state[lo:hi]
            top = np.maximum.reduceat(w, begins)
            x = np.exp(w - np.repeat(top, counts))
            total = np.add.reduceat(x, begins)
            inside[lo:hi] = top + np.log(total)
            share[a:b] = x / np.repeat(total, counts)
            several[lo:hi] = (counts > 1) | np.logical_or.reduceat(several[then[a:b]], begins)
        upto = np.cumsum(share)
        numbers = np.repeat(np.arange(n), per_state)
        reach = numbers + (upto - np.append(0.0, upto)[first[:-1]][numbers] if n else upto)
        reach[first[1:] - 1] = np.arange(n) + 1.0
        self.flat = [reach, then, piece, share]
        self.first, self.several = first, several
        return state[at[:-1]]

    def weight(self, state: int, ids: tuple) -> float:
        """The share of the state's weight that the path of these pieces has."""
        _, then, piece, share = self.flat
        out = 1.0
        for x in ids:
            e = next(e for e in range(int(self.first[state]), int(self.first[state + 1])) if piece[e] == x)
            out *= float(share[e])
            state = int(then[e])
        return out

    def rest(self, state: int, taken: list[tuple]) -> float:
        """The share of the state's weight that all paths but those taken have: a sum, so right to the last digits however small it is."""
        _, then, piece, share = self.flat
        total, open_states = 0.0, [(state, [(t, 0) for t in taken], 1.0)]
        while open_states:
            state, paths, weight = open_states.pop()
            if not paths:
                total += weight
            elif state >= 0:
                for e in range(int(self.first[state]), int(self.first[state + 1])):
                    x = piece[e]
                    open_states.append((int(then[e]), [(t, i + 1) for t, i in paths if t[i] == x], weight * float(share[e])))
        return total

    def done(self) -> None:
        self.flat = self.first = self.several = None


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PlaceHashes(kernels.Spans):
    """Hashes of stretches of characters of one length, unmixed."""

    def __init__(self, text: np.ndarray):
        super().__init__(kernels.mix(text.astype(U) + U(1)), 0)

    def __call__(self, begin: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[begin + size] - self.sums[begin]) * self.down[begin]


def place_hash(text: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    return PlaceHashes(text)(begin, size)


def uniform(seed: np.ndarray) -> np.ndarray:
    """Draws in (0, 1), one for each 64-bit seed."""
    x = (seed ^ (seed >> U(32))) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return ((x >> U(11)).astype(float) + 0.5) * 2.0**-53


def walk(lat: Lattices, state: np.ndarray, seed: np.ndarray):
    """One path through each lattice: pieces of all paths one after the other, their offsets, log probabilities."""
    reach, then, piece, share = lat.flat
    n = len(state)
    alive, steps, sizes = np.arange(n), [], np.zeros(n, np.int64)
    turn = 0
    while len(alive):
        own = seed if turn == 0 else seed[alive]
        aim = state + uniform(own + U(turn * 0x9E3779B97F4A7C15 % 2**64))
        e = lat.first[state]
        off = np.flatnonzero(reach[e] <= aim)
        while len(off):
            e[off] += 1
            off = off[reach[e[off]] <= aim[off]]
        steps.append((alive, e))
        sizes[alive] = turn = turn + 1
        state = then[e]
        go = np.flatnonzero(state >= 0)
        alive, state = alive[go], state[go]
    offsets = np.append(0, np.cumsum(sizes))
    edges = np.empty(offsets[-1], np.int64)
    for t, (at, e) in enumerate(steps):
        edges[offsets[at] + t] = e
    total = np.add.reduceat(np.log(share[edges]), offsets[:-1]) if n else np.zeros(0)
    return piece[edges], offsets, total


def walk_one(lat: Lattices, state: int, seed: int) -> tuple[tuple, float]:
    """The same path as `walk` takes, through one lattice."""
    reach, then, piece, share = lat.flat
    ids, log_p = [], 0.0
    while state >= 0:
        x = (seed + len(ids) * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        aim = state + ((x >> 11) + 0.5) * 2.0**-53
        e = int(lat.first[state])
        while reach[e] <= aim:
            e += 1
        ids.append(int(piece[e]))
        log_p += math.log(share[e])
        state = int(then[e])
    return tuple(ids), log_p


class Path:
    """A segmentation: which walk each stretch is from (pairs of the first stretch and the walk), what was changed, log
    probabilities of the stretches, and where it may differ from what was taken."""

    def __init__(self, sources: list[tuple[int, int]], changes: dict[int, tuple], log_p: np.ndarray, free_from: int, taken: list):
        self.sources, self.changes, self.log_p, self.free_from, self.taken = sources, changes, log_p, free_from, taken


def other_part(lat: Lattices, state: int, taken: set, seed: int) -> tuple[tuple, float] | None:
    """A path through one lattice that isn't among those taken, by its probability among the rest."""
    for t in range(8):
        got = walk_one(lat, state, seed + t * 0x632BE59BD9B4E019)
        if got[0] not in taken:
            return got
    return walk_beside(lat, state, list(taken), seed)


def walk_beside(lat: Lattices, state: int, taken: list[tuple], seed: int) -> tuple[tuple, float] | None:
    """The same by one walk: an edge has the weight of its state's share less that of the taken paths through it."""
    _, then, piece, share = lat.flat
    ids, log_p, turn = [], 0.0, 0
    while state >= 0:
        edges = range(int(lat.first[state]), int(lat.first[state + 1]))
        rest = []
        for e in edges:
            rest.append(float(share[e]) * lat.rest(int(then[e]), [t[1:] for t in taken if t[0] == piece[e]]))
        total = sum(rest)
        if total <= 0:
            return None
        aim = float(uniform(np.array([(seed + (turn + 64) * 0x9E3779B97F4A7C15) % 2**64], U))[0]) * total
        at = 0
        while at < len(rest) - 1 and (aim >= rest[at] or rest[at] == 0):
            aim -= rest[at]
            at += 1
        while rest[at] == 0:  # rounding left nothing behind the last edge with weight
            at -= 1
        e = edges[at]
        taken = [t[1:] for t in taken if t[0] == piece[e]]
        ids.append(int(piece[e]))
        log_p += float(np.log(share[e]))
        state = int(then[e])
        turn += 1
    return tuple(ids), log_p


def sample_rows(lat: Lattices, states: np.ndarray, walks: list, lo: int, hi: int, k: int, seed: int):
    """Up to k (ids, log probability, perturbed, inclusion) of the text whose stretches are lo .. hi - 1."""
    n = hi - lo
    part = lambda w, j: tuple(w[0][w[1][lo + j] : w[1][lo + j + 1]].tolist())
    salts = np.arange(1, n + 1, dtype=U) * U(0xD6E8FEB86659FD93)
    several = lat.several[states[lo:hi]]
    own = lambda path, j: piece_of(path.sources, path.changes, j, walks, part)

    def bounds(path: Path, top: float, turn: int) -> np.ndarray:
        """Of the set of those that first differ from the path in stretch j: the largest perturbed log probability.

        A set weighs no more than the path up to its stretch, so behind some stretch all bounds are below the k + 1 largest.
        """
        before = np.append(0.0, np.cumsum(path.log_p))[:-1]
        j = path.free_from
        taken = sum(np.exp(p) for _, p in path.taken)
        m = j + 256
        while True:
            out = np.full(n, -np.inf)
            m = min(n, m)
            if m <= j:
                return out
            gone = np.exp(path.log_p[j:m])
            gone[0] += taken
            rest = 1 - gone
            rest[~several[j:m]] = 0
            for i in np.flatnonzero((rest < 1e-6) & several[j:m]).tolist():  # too small for a difference
                rest[i] = lat.rest(int(states[lo + j + i]), [*(t for t, _ in path.taken if i == 0), own(path, j + i)])
            with np.errstate(divide="ignore"):
                mass = before[j:m] + np.log(rest)
            noise = np.log(-np.log(uniform(salts[j:m] + U((seed + (turn + 1) * 0x94D049BB133111EB) % 2**64))))
            out[j:m] = -np.logaddexp(-top, noise - mass)
            if m == n or (m - j > k + 1 and np.partition(out[j:m], -k - 1)[-k - 1] > before[m] + MOST_NOISE):
                return out
            m = j + 8 * (m - j)

    path = Path([(0, 0)], {}, walks[0][2][lo:hi].copy(), 0, [])
    top = float(-np.log(-np.log(uniform(np.array([seed], U))[0])))
    paths, out, open_sets = [path], [(0, top)], [bounds(path, top, 0)]
    while len(out) < k:
        best = max(range(len(open_sets)), key=lambda i: open_sets[i].max(initial=-np.inf))
        value = float(open_sets[best].max(initial=-np.inf))
        if value == -np.inf:
            break
        j = int(open_sets[best].argmax())
        open_sets[best][j] = -np.inf
        old, new = paths[best], len(paths)
        taken = [*(old.taken if j == old.free_from else []), (own(old, j), float(old.log_p[j]))]
        got = other_part(lat, int(states[lo + j]), {t for t, _ in taken}, (seed + new * 0xBF58476D1CE4E5B9 + j) % 2**64)
        if got is None:
            continue
        log_p = np.concatenate([old.log_p[:j], [got[1]], walks[new][2][lo + j + 1 : hi]])
        paths.append(Path([s for s in old.sources if s[0] <= j] + [(j + 1, new)], {i: p for i, p in old.changes.items() if i < j} | {j: got[0]}, log_p, j, taken))
        out.append((new, value))
        open_sets.append(bounds(paths[-1], value, new))
    threshold = max((s.max(initial=-np.inf) for s in open_sets), default=-np.inf)
    for i, value in out:
        total = float(paths[i].log_p.sum())
        pieces = []
        sources, changes = paths[i].sources, paths[i].changes
        for (a, w), b in zip(sources, [*[s[0] for s in sources[1:]], n], strict=True):
            for c in [x for x in sorted(changes) if a <= x < b]:
                pieces += [walks[w][0][walks[w][1][lo + a] : walks[w][1][lo + c]], np.array(changes[c], np.int32)]
                a = c + 1
            if a < b:
                pieces.append(walks[w][0][walks[w][1][lo + a] : walks[w][1][lo + b]])
        ids = lat.expanded(np.concatenate(pieces)) if pieces else np.zeros(0, np.int32)
        yield ids, total, value, 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(700.0, total - threshold))))


def piece_of(sources: list, changes: dict, j: int, walks: list, part) -> tuple:
    if j in changes:
        return changes[j]
    return part(walks[[w for a, w in sources if a <= j][-1]], j)


@lru_cache(maxsize=2)
def lattices(model: str, alpha: float) -> Lattices:
    return Lattices(model, alpha)


def normal(text: str) -> str:
    """As the model's own normaliser leaves it: a blank in front, and every blank visible."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def samples_of(keys: np.ndarray, texts: list[str], lat: Lattices, k: int):
    """For each text the list of its samples."""
    found = [STRETCHES.findall(normal(t)) for t in texts]
    at = np.append(0, np.cumsum([len(f) for f in found]))
    codes, distinct = pd.factorize(np.array([s for f in found for s in f], object))
    states = lat.prepare(list(distinct))[codes] if len(codes) else np.zeros(0, np.int64)
    seeds = kernels.mix(keys.view(U) + U(0x9E3779B97F4A7C15))
    each = np.repeat(seeds, np.diff(at)) + np.arange(len(states), dtype=U) * U(0xBF58476D1CE4E5B9) - np.repeat(at[:-1].astype(U) * U(0xBF58476D1CE4E5B9), np.diff(at))
    walks = [walk(lat, states, kernels.mix(each + U(i))) for i in range(k)] if len(states) else [(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0))] * k
    for i in range(len(texts)):
        yield list(sample_rows(lat, states, walks, int(at[i]), int(at[i + 1]), k, int(seeds[i])))
    lat.done()


def groups_of(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Rows i .. j - 1 that hold about `most` characters together, or one longer text."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def sampled(docs: DataFrame, model: str, k: int = 2, alpha: float = 0.4, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row for each sample: key, sample (from 1), log_prob, perturbed, inclusion, and ids; or n_pieces, ids_sha256, and whether the ids decode to the text."""
    kind = docs.schema[key].dataType.simpleString()
    last = [("n_pieces", pa.int32(), "int"), ("ids_sha256", pa.string(), "string"), ("decodes", pa.bool_(), "boolean")] if digest else [("ids", pa.list_(pa.int32()), "array<int>")]
    fields = [("sample", pa.int32(), "int"), *[(x, pa.float64(), "double") for x in ("log_prob", "perturbed", "inclusion")], *last]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model, alpha)
        for b in cut(batches, 1, 8 << 20):
            seeds = b.column(2).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in groups_of(texts):
                rows: list[list] = [[] for _ in fields]
                owner = []
                for r, got in zip(range(i, j), samples_of(seeds[i:j], texts[i:j], lat, k), strict=True):
                    for s, (ids, log_p, value, inclusion) in enumerate(got, 1):
                        own = (len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), decoded(ids, lat.bytes_of) == texts[r]) if digest else (ids,)
                        owner.append(r)
                        for col, v in zip(rows, (s, log_p, value, inclusion, *own), strict=True):
                            col.append(v)
                cols = [b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, (_, t, _) in zip(rows, fields, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["key", *(f for f, _, _ in fields)])

    whole = kind in ("tinyint", "smallint", "int", "bigint")
    seed = F.coalesce(F.col(key).cast("bigint") if whole else F.xxhash64(key), F.lit(-1).cast("bigint"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), seed.alias("seed"))
    return rows.mapInArrow(task, f"key {kind}, " + ", ".join(f"{f} {t}" for f, _, t in fields)).withColumnRenamed("key", key)


def decoded(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    """The text of piece ids: their bytes in a row, visible blanks made blanks, and without the one in front."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")[1:]


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with the text of the ids, in place of a column of that name if there is one. Null ids give null."""
    names = [c for c in rows.columns if c != out or c == ids]
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    at = names.index(ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = lattices(model, 0.4).bytes_of
        for b in cut(batches, at):
            texts = [None if x is None else decoded(np.array(x, np.int64), bytes_of) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out])

    return rows.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(task, f"{kinds}, `{out}` string")


def op2_gumbel_segmentations(spark, sf_dir: str) -> DataFrame:
    from .tokens import tokenizer_path

    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def gumbel_round_trip(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_samples, n_different, restored: up to four samples of each document, and whether all of them decode to its text.

    Samples are decoded and compared where they are drawn; neither ids nor texts travel.
    """
    from .tokens import tokenizer_path

    rows = sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"), k=4, digest=True)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("ids_sha256").alias("n_different"), F.min("decodes").alias("restored"))
