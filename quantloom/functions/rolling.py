"""Rolling functions over rows that Spark has dealt out and sorted, for many windows at once.

Spark's own sliding windows visit all n rows of each window for each aggregate; here a window's moments are merged from those of its
parts (1, 2, 4, ... rows), so the work is that of the logarithm of n. Nothing is taken off again: a window's value comes from its own
rows only, so neither a large value nor an infinity leaves anything behind, and one without spread has a deviation of exactly 0.

A task's rows come sorted by key and order, in Arrow batches. It holds some ten thousand at a time and, of a key that goes on, what
windows look back at; only `whole` asks for all rows of a key at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at once.
ROWS = 1 << 15


class Vec:
    """Values with their validity; arithmetic and comparisons are null where a side is."""

    __slots__ = ("v", "ok")

    def __init__(self, v: np.ndarray, ok: np.ndarray):
        self.v, self.ok = v, ok

    def _with(self, other, f):
        if isinstance(other, Vec):
            return Vec(f(self.v, other.v), self.ok & other.ok)
        return Vec(f(self.v, other), self.ok)

    def __add__(self, o):
        return self._with(o, np.add)

    def __sub__(self, o):
        return self._with(o, np.subtract)

    def __mul__(self, o):
        return self._with(o, np.multiply)

    def __truediv__(self, o):
        return self._with(o, np.divide)

    def __radd__(self, o):
        return Vec(o + self.v, self.ok)

    def __rsub__(self, o):
        return Vec(o - self.v, self.ok)

    def __rmul__(self, o):
        return Vec(o * self.v, self.ok)

    def __neg__(self):
        return Vec(-self.v, self.ok)

    def __lt__(self, o):
        return self._with(o, np.less)

    def __gt__(self, o):
        return self._with(o, np.greater)

    def __and__(self, o):
        """True where both are, null where neither is false and one is null."""
        no = (self.ok & ~self.v) | (o.ok & ~o.v)
        return Vec(self.v & o.v & ~no, (self.ok & o.ok) | no)

    def __or__(self, o):
        yes = (self.ok & self.v) | (o.ok & o.v)
        return Vec(yes, (self.ok & o.ok) | yes)

    @property
    def true(self) -> np.ndarray:
        return self.ok & self.v.astype(bool)


def back(a: np.ndarray, k: int) -> np.ndarray:
    """a's values k rows before."""
    if k == 0:
        return a
    out = np.empty_like(a)
    out[:k] = 0
    out[k:] = a[:-k] if k < len(a) else a[:0]
    return out


def merged(parts: tuple, n: int, join: Callable) -> tuple:
    """The state of each row's last n rows, from the states of single rows; join(earlier, later, rows of each)."""
    size, step, out, have = 1, parts, None, 0
    while True:
        if n & size:
            out, have = (step, size) if out is None else (join(tuple(back(x, have) for x in step), out, size, have), have + size)
        if 2 * size > n:
            return out
        step = join(tuple(back(x, size) for x in step), step, size, size)
        size *= 2


def join_moments(a: tuple, b: tuple, na: int, nb: int) -> tuple:
    """Mean and centred sums of squares, cubes and fourth powers, as many as there are."""
    n = na + nb
    d = b[0] - a[0]
    mean = a[0] + d * (nb / n)
    if len(a) == 1:
        return (mean,)
    d2 = d * d
    m2 = a[1] + b[1] + d2 * (na * nb / n)
    if len(a) == 2:
        return mean, m2
    m3 = a[2] + b[2] + d2 * d * (na * nb * (na - nb) / n**2) + d * ((na / n) * b[1] - (nb / n) * a[1]) * 3
    m4 = a[3] + b[3] + d2 * d2 * (na * nb * (na * na - na * nb + nb * nb) / n**3) + d2 * ((na / n) ** 2 * b[1] + (nb / n) ** 2 * a[1]) * 6 + d * ((na / n) * b[2] - (nb / n) * a[2]) * 4
    return mean, m2, m3, m4


def join_pairs(a: tuple, b: tuple, na: int, nb: int) -> tuple:
    """Means of both, centred squares of both and products."""
    n = na + nb
    dx, dy, w = b[0] - a[0], b[1] - a[1], na * nb / n
    return a[0] + dx * (nb / n), a[1] + dy * (nb / n), a[2] + b[2] + dx * dx * w, a[3] + b[3] + dy * dy * w, a[4] + b[4] + dx * dy * w


class Rows:
    """Columns of sorted rows, and functions over each key's rows: a value exists only where the window holds n non-null values."""

    def __init__(self, columns: dict[str, Vec], at: np.ndarray, sums: list[float | None]):
        self.columns, self.at, self.known_sums, self.made = columns, at, sums, {}
        self.sums: list[Vec] = []
        self.begins = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, np.int64)

    def col(self, x) -> Vec:
        return self.columns[x] if isinstance(x, str) else x

    def add(self, **named: Vec) -> None:
        self.columns.update(named)

    def once(self, what: str, x, n: int, f: Callable):
        if not isinstance(x, str):
            return f(self.col(x))
        if (what, x, n) not in self.made:
            self.made[what, x, n] = f(self.col(x))
        return self.made[what, x, n]

    def known(self, x: Vec, n: int) -> np.ndarray:
        c = np.append(0, np.cumsum(x.ok))
        i = np.arange(len(x.ok))
        return c[i + 1] - c[np.maximum(0, i - np.minimum(self.at, n - 1))]

    def whole_window(self, x: Vec, n: int) -> np.ndarray:
        return self.known(x, n) == n

    def lag(self, x, k: int = 1) -> Vec:
        x = self.col(x)
        return Vec(back(x.v, k), back(x.ok, k) & (self.at >= k))

    def lead(self, x, k: int = 1) -> Vec:
        """Needs whole keys."""
        x, key = self.col(x), self.numbers()
        ahead = lambda a: back(a[::-1], k)[::-1]
        return Vec(ahead(x.v), ahead(x.ok) & (ahead(key) == key))

    def diff(self, x, k: int = 1) -> Vec:
        return self.col(x) - self.lag(x, k)

    def ratio(self, a: Vec, b: Vec) -> Vec:
        """a / b, null where b is 0."""
        b = self.col(b)
        a = self.col(a)
        return Vec(a.v / b.v, a.ok & b.ok & (b.v != 0))

    div = ratio

    def pct_change(self, x, k: int) -> Vec:
        return self.ratio(self.col(x), self.lag(x, k)) - 1

    pct = pct_change

    def moments(self, x, n: int, most: int) -> tuple:
        """Mean (1), squares too (2), or all four (4)."""
        return self.once(f"moments{most}", x, n, lambda x: (merged((x.v, *(np.zeros_like(x.v) for _ in range(most - 1))), n, join_moments), self.whole_window(x, n)))

    def mean(self, x, n: int, least: int | None = None) -> Vec:
        if least is not None and least < n:
            x, total = self.col(x), np.zeros(len(self.at))
            v = np.where(x.ok, x.v, 0.0)
            for k in range(n):
                total += np.where(self.at >= k, back(v, k), 0.0)
            count = self.known(x, n)
            return Vec(total / count, count >= least)
        return self.total(x, n) / n

    def total(self, x, n: int) -> Vec:
        return self.once("total", x, n, lambda x: Vec(merged((x.v,), n, lambda a, b, *_: (a[0] + b[0],))[0], self.whole_window(x, n)))

    def var(self, x, n: int) -> Vec:
        m, ok = self.moments(x, n, 2)
        return Vec(np.where(np.isfinite(m[0]), m[1], np.nan) / (n - 1), ok)  # of an infinity there is none

    def std(self, x, n: int) -> Vec:
        return self.sqrt(self.var(x, n))

    def skew(self, x, n: int) -> Vec:
        """Sample-adjusted; null without spread."""
        m, ok = self.moments(x, n, 4)
        return Vec(n**0.5 * m[2] / m[1] ** 1.5 * ((n * (n - 1)) ** 0.5 / (n - 2)), ok & (m[1] != 0))

    def kurt(self, x, n: int) -> Vec:
        m, ok = self.moments(x, n, 4)
        return Vec(((n * m[3] / (m[1] * m[1]) - 3) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))), ok & (m[1] != 0))

    def highest(self, x, n: int) -> Vec:
        return self.once("highest", x, n, lambda x: Vec(merged((x.v,), n, lambda a, b, *_: (np.maximum(a[0], b[0]),))[0], self.whole_window(x, n)))

    def lowest(self, x, n: int) -> Vec:
        return self.once("lowest", x, n, lambda x: Vec(merged((x.v,), n, lambda a, b, *_: (np.fmin(a[0], b[0]),))[0], self.whole_window(x, n)))

    high, low = highest, lowest

    def ordered(self, x, n: int) -> tuple[np.ndarray, np.ndarray]:
        def f(x: Vec):
            ok = self.whole_window(x, n)
            rows = np.flatnonzero(ok)
            return np.sort(np.lib.stride_tricks.sliding_window_view(x.v, n)[rows - n + 1], axis=1) if len(rows) else np.zeros((0, n)), ok

        return self.once("ordered", x, n, f)

    def quantile(self, x, n: int, q: float) -> Vec:
        values, ok = self.ordered(x, n)
        h = (n - 1) * q
        i = min(int(h), n - 2)
        out = np.zeros(len(ok))
        out[ok] = values[:, i] + (values[:, i + 1] - values[:, i]) * (h - i)
        return Vec(out, ok)

    def pairs(self, x, y, n: int) -> tuple:
        def f(x: Vec):
            other = self.col(y)
            both = Vec(x.v, x.ok & other.ok)
            zero = np.zeros_like(x.v)
            m = merged((x.v, other.v, zero, zero, zero), n, join_pairs)
            return (*m[:4], np.where(np.isfinite(m[0] + m[1]), m[4], np.nan)), self.whole_window(both, n)

        return self.once(f"pairs {y}", x, n, f) if isinstance(y, str) else f(self.col(x))

    def corr(self, x, y, n: int) -> Vec:
        """Pearson over the last n rows, all known; null without spread."""
        (_, _, sx, sy, c), ok = self.pairs(x, y, n)
        spread = np.sqrt(sx / n) * np.sqrt(sy / n)
        return Vec(c / n / spread, ok & (spread != 0))

    def cov(self, x, y, n: int) -> Vec:
        m, ok = self.pairs(x, y, n)
        return Vec(m[4] / (n - 1), ok)

    def slope(self, y, x, n: int) -> Vec:
        """Of y on x."""
        m, ok = self.pairs(x, y, n)
        return Vec(m[4] / m[2], ok & (m[2] != 0))

    def ts_rank(self, x, n: int, percent: bool = True) -> Vec:
        """Rank, with average ties, of the last of n values."""

        def f(x: Vec):
            twice = np.full(len(x.v), 2.0)
            for k in range(1, n):
                before = back(x.v, k)
                twice += 2.0 * (before < x.v) + (before == x.v)
            return Vec(twice / 2, self.whole_window(x, n))

        rank = self.once("ts_rank", x, n, f)
        return rank / n if percent else rank

    def argmax(self, x, n: int) -> Vec:
        """Rows since the start of the window at which its (first) maximum lies, from 0."""
        x = self.col(x)
        top, out = self.highest(x, n), np.zeros(len(x.v))
        for k in range(n):
            out[back(x.v, k) == top.v] = n - 1 - k
        return Vec(out, top.ok)

    def running(self, x) -> Vec:
        """The sum so far, null before the first value."""
        x = self.col(x)
        v, ok = np.where(x.ok, x.v, 0.0), np.empty(len(x.v), bool)
        number = len(self.sums)
        before = self.known_sums[number] if number < len(self.known_sums) else None
        if before is not None and len(v):
            v[0] += before
        for i, j in zip(self.begins.tolist(), [*self.begins[1:].tolist(), len(v)], strict=True):
            np.cumsum(v[i:j], out=v[i:j])
            np.logical_or.accumulate(x.ok[i:j], out=ok[i:j])
            if i == 0 and before is not None:
                ok[i:j] = True
        self.sums.append(Vec(v, ok))
        return Vec(v, ok)

    def numbers(self) -> np.ndarray:
        """Each row's key as a number."""
        return np.cumsum(np.bincount(self.begins, minlength=len(self.at))) - 1 if len(self.at) else np.zeros(0, np.int64)

    def key_ranks(self, x) -> tuple[Vec, Vec, Vec]:
        """Average rank from 1, first rank (ties in the rows' order) and number of values, among all rows of the key. Needs whole keys."""
        x = self.col(x)
        rows = np.flatnonzero(x.ok)
        key = self.numbers()[rows]
        order = np.lexsort((x.v[rows], key))
        k, v = key[order], x.v[rows][order]
        new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
        new = new_key | np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))[: len(k)]
        places, starts = np.arange(len(k)), np.flatnonzero(new)
        tie, begin = np.cumsum(new) - 1, np.maximum.accumulate(np.where(new_key, places, 0))
        same = np.diff(np.append(starts, len(k)))[tie]
        average, first, count = (np.zeros(len(x.v)) for _ in range(3))
        average[rows[order]] = starts[tie] - begin + (same + 1) / 2.0
        first[rows[order]] = places - begin + 1
        count[rows] = np.bincount(key)[key] if len(key) else 0
        return Vec(average, x.ok), Vec(first, x.ok), Vec(count, x.ok)

    def key_mean(self, x, within: np.ndarray | None = None) -> Vec:
        """Mean of the known values of the row's key, or of its rows with the same number from 0 in `within`. Needs whole keys."""
        x, group = self.col(x), self.numbers()
        if within is not None:
            group = group * (int(within.max(initial=0)) + 1) + within
        n = np.bincount(group, x.ok)
        return Vec((np.bincount(group, np.where(x.ok, x.v, 0.0)) / n)[group], n[group] > 0)

    def key_zscore(self, x) -> Vec:
        """By the mean and deviation of the key's known values; null without spread. Needs whole keys."""
        x, key = self.col(x), self.numbers()
        d = x - self.key_mean(x)
        v, n = np.where(x.ok, x.v, np.inf), int(key[-1]) + 1 if len(key) else 0
        lowest, highest = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(lowest, key, v)
        np.maximum.at(highest, key, np.where(x.ok, x.v, -np.inf))
        sd = np.sqrt(self.key_mean(d * d).v)
        return Vec(d.v / sd, d.ok & (sd != 0) & (lowest != highest)[key])

    def key_corr(self, x: Vec, y: Vec, least: int = 1) -> Vec:
        """Pearson over the key's rows where both are known, at the key's first row only; null without spread or with fewer than `least` rows. Needs whole keys."""
        both, key = x.ok & y.ok, self.numbers()
        x, y = Vec(x.v, both), Vec(y.v, both)
        dx, dy = x - self.key_mean(x), y - self.key_mean(y)
        total = lambda v: np.bincount(key, np.where(both, v, 0.0))
        spread, out, ok = np.sqrt(total(dx.v * dx.v)) * np.sqrt(total(dy.v * dy.v)), np.zeros(len(key)), np.zeros(len(key), bool)
        out[self.begins] = total(dx.v * dy.v) / spread
        ok[self.begins] = (spread != 0) & (np.bincount(key, both) >= least)
        return Vec(out, ok)

    def whole_rank(self, x) -> Vec:
        """Percent rank among all rows of the key, earlier and later; average ties."""
        average, _, count = self.key_ranks(x)
        return average / count

    def abs(self, x: Vec) -> Vec:
        return Vec(np.abs(x.v), x.ok)

    def sign(self, x: Vec) -> Vec:
        return Vec(np.sign(x.v), x.ok)

    def sqrt(self, x: Vec) -> Vec:
        return Vec(np.sqrt(x.v), x.ok)

    def ln(self, x: Vec) -> Vec:
        return Vec(np.log(x.v), x.ok & (x.v > 0))

    def rounded(self, x: Vec, digits: int) -> Vec:
        return Vec(np.round(x.v, digits), x.ok)

    def greatest(self, *xs) -> Vec:
        """Of those known."""
        return self._best(xs, np.fmax, -np.inf)

    def least(self, *xs) -> Vec:
        return self._best(xs, np.fmin, np.inf)

    def _best(self, xs: tuple, f: Callable, none: float) -> Vec:
        vs = [x if isinstance(x, Vec) else Vec(np.full(len(self.at), float(x)), np.ones(len(self.at), bool)) for x in xs]
        v, ok = np.where(vs[0].ok, vs[0].v, none), vs[0].ok
        for x in vs[1:]:
            v, ok = f(v, np.where(x.ok, x.v, none)), ok | x.ok
        return Vec(v, ok)

    def when(self, condition: Vec, a, b=None) -> Vec:
        """a where the condition holds, else b (null unless given); either may be a number."""
        yes, n = condition.true, len(self.at)
        of = lambda x: x if isinstance(x, Vec) else Vec(np.full(n, np.nan if x is None else float(x)), np.full(n, x is not None))
        a, b = of(a), of(b)
        return Vec(np.where(yes, a.v, b.v), np.where(yes, a.ok, b.ok))

    def only(self, x: Vec, known: Vec) -> Vec:
        """x where the other is known."""
        return Vec(x.v, x.ok & known.ok)

    def number(self, condition: Vec) -> Vec:
        return Vec(condition.v.astype(float), condition.ok)

    def or_else(self, x: Vec, value: float) -> Vec:
        return Vec(np.where(x.ok, x.v, value), np.ones(len(x.v), bool))


def over_rows(df: DataFrame, columns: list[str], names: list[str], body: Callable, lookback: int | None, by: str = "symbol", order: str = "trade_date", rows: int = ROWS, schema: str | None = None) -> DataFrame:
    """by, order and the named doubles that body makes of the columns of each key's rows in order.

    lookback: no value depends on more rows than these before its own, running sums apart; None: a key's rows are worked on all at once.
    schema: body gets the key and order columns too, and makes rows of this schema itself, the names' in their order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def vec(a: pa.Array) -> Vec:
        ok = np.asarray(pc.is_valid(a))
        return Vec(a.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float), ok)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, skip, number, sums = 0, 0, 0, []  # rows to look back at, the first row's number in its key, sums before it
        enough = rows  # of a long key, twice as many as the last time

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, skip, number, sums
            t = pa.Table.from_batches(held).combine_chunks()
            key, n = t.column(0).combine_chunks(), t.num_rows
            a, b = key.slice(1), key.slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            begins = np.append(0, 1 + np.flatnonzero(~np.asarray(same)))
            upto = n if last or lookback is not None else int(begins[-1])
            if upto == 0:  # one key, and not all of it is here
                return
            at = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            first_end = int(begins[1]) if len(begins) > 1 else n
            at[:first_end] += number
            r = Rows({c: vec(t.column(i + 2).combine_chunks().slice(0, upto)) for i, c in enumerate(columns)}, at[:upto], sums)
            with np.errstate(all="ignore"):
                made = body(r, *(t.column(i).combine_chunks().slice(0, upto) for i in range(2))) if schema else body(r)
            if schema:
                yield pa.RecordBatch.from_arrays(made, names)
            keys = [t.column(i).combine_chunks().slice(skip, upto - skip) for i in range(2)]
            if not schema:
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(made[x].v[skip:], pa.float64(), mask=~made[x].ok[skip:]) for x in names)], [by, order, *names])
            start = upto if lookback is None else max(int(begins[-1]), n - lookback)
            sums = [float(s.v[start - 1]) if s.ok[start - 1] else None for s in r.sums] if lookback is not None and start > begins[-1] else sums if start == 0 else []
            number, skip = (int(at[start]), n - start) if lookback is not None else (0, 0)
            held, size = t.slice(start).to_batches(), n - start

        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                held.append(batch.slice(i, rows))
                size += held[-1].num_rows
                if size - skip >= enough:
                    yield from work(False)
                    enough = rows + 2 * (size - skip)
        if size > skip:
            yield from work(True)

    sorted_rows = df.select(by, order, *[F.col(c).cast("double").alias(c) for c in columns]).repartition(by).sortWithinPartitions(by, order)
    return sorted_rows.mapInArrow(task, schema or ", ".join([f"`{c}` {kinds[c]}" for c in (by, order)] + [f"`{n}` double" for n in names]))
