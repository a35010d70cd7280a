"""Prefix keys lose no similar pair, also where shingles are so common that they are keys only in pairs."""

import numpy as np
import pytest

from quantloom.llm import ordermin

KIND = np.dtype([("key", np.uint64), ("rep", np.int64), ("label", np.int64), ("size", np.int32), ("at", np.int32)])


@pytest.mark.parametrize("often", [2, 10, 10_000])
def test_all_similar_pairs_meet(monkeypatch, often):
    monkeypatch.setattr(ordermin, "PAIRS", 50)
    g = np.random.default_rng(often)
    base = g.integers(0, 1 << 60, 40)
    common = g.integers(0, 1 << 60, 3)
    texts = []
    for i in range(120):
        t = set(base.tolist()) if i % 2 else set(g.integers(0, 1 << 60, int(g.integers(1, 40))).tolist())
        t = set(g.permutation(list(t))[: max(1, len(t) - int(g.integers(0, 9)))].tolist()) | set(g.integers(0, 1 << 60, int(g.integers(0, 4))).tolist()) | set(common[: int(g.integers(0, 4))].tolist())
        texts.append(np.array(sorted(t), np.int64))
    counts = np.zeros(ordermin.COUNTERS, np.int64)
    for t in texts:
        counts += np.bincount(ordermin.counter_of(t), minlength=ordermin.COUNTERS)
    rows = []
    for i, t in enumerate(texts):
        keys, at = ordermin.prefix_of(t, counts, 0.8, often)
        assert len(keys) == len(at) and (at < len(t)).all()
        rows += [(k, i, i % 7, len(t), a) for k, a in zip(keys.tolist(), at.tolist())]
    met = {tuple(p) for p in ordermin.met_in(np.array(rows, KIND), 0.8).tolist()}
    similar = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            m = len(np.intersect1d(a, texts[j]))
            if m / (len(a) + len(texts[j]) - m) >= 0.8 and i % 7 != j % 7 and (len(a), m) != (len(texts[j]), len(a)):
                similar.add((i, j))
    assert similar and similar <= met and all(i % 7 != j % 7 for i, j in met)
    assert ordermin.met_in(np.zeros(0, KIND), 0.8).shape == (0, 2)
