"""The range join of vectors against all cosines."""

import duckdb
import numpy as np
import pytest

from quantloom.llm import cells

SCHEMA = "vec_id bigint, embedding array<double>, label int, no string, v int"


def by_hand(rows, cosine=0.98):
    fine = {k: (x[0], x[2], np.array(x[1], float)) for k, x in enumerate(rows) if x[0] is not None and x[2] is not None and x[1] and None not in x[1] and np.isfinite(x[1]).all() and any(x[1])}
    root = {x[0]: x[0] for x in rows if x[0] is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = dict.fromkeys(range(len(rows)), 0)
    groups = {}
    for k, (i, label, v) in fine.items():
        groups.setdefault((label, len(v)), []).append((k, i, v / np.abs(v).max()))
    for own in groups.values():
        u = np.array([v / np.sqrt(v @ v) for _, _, v in own])
        for a, b in zip(*np.nonzero(u @ u.T >= cosine)):
            if a != b:
                n[own[a][0]] += 1
                x, y = sorted((find(own[a][1]), find(own[b][1])))
                root[y] = x
    out = []
    for k, x in enumerate(rows):
        c = None if x[0] is None else find(x[0])
        out.append((x[0], n[k], c, c is None or c == x[0]))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    got = cells.linked_vectors(spark.createDataFrame(rows, SCHEMA), **how)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def rows_with(g, dim, n, clumps, labels=2):
    rows = [g.normal(size=dim) for _ in range(n)]
    for size, spread in clumps:
        c = g.normal(size=dim)
        c /= np.linalg.norm(c)
        rows += [(c + g.normal(size=dim) * spread / np.sqrt(dim)) * g.uniform(0.1, 9) for _ in range(size)]
    order = g.permutation(len(rows))
    return [(int(i), [float(x) for x in rows[k]], int(k % labels), "x", 1) for i, k in enumerate(order)]


@pytest.mark.parametrize(("dim", "spread", "cell", "visit"), [(64, 0.13, 64, 50), (8, 0.2, 48, 40), (3, 0.3, 64, 64), (64, 0.02, 32, 30)])
def test_equals_all_cosines(spark, monkeypatch, dim, spread, cell, visit):
    for name, value in (("CELL", cell), ("VISIT", visit), ("SALT", 100), ("PIVOTS", 5), ("SAMPLE", 60)):
        monkeypatch.setattr(cells, name, value)
    g = np.random.default_rng(dim)
    rows = rows_with(g, dim, 400, [(150, spread), (90, spread), (40, spread / 4)])
    want = by_hand(rows)
    assert max(x[1] for x in want) > 15
    assert found(spark, rows) == want


def test_chains_and_heaps_of_copies(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 32)
    monkeypatch.setattr(cells, "VISIT", 32)
    chain = [(1000 - i, [float(np.cos(0.15 * i)), float(np.sin(0.15 * i))], 7, "chain", 0) for i in range(20)]
    copies = [(2000 + i, [0.5, -3.0], 7, "copy", 0) for i in range(300)]
    rows = chain + copies + [(5000, [0.55, -3.0], 7, "beside", 0), (5001, [0.5, -3.0], 8, "other label", 0)]
    assert found(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1, "a", 0), (2, [2.0, 0.0], 1, "a", 0), (3, [1.0, 0.0], None, "a", 0), (4, None, 1, "a", 0), (5, [0.0, 0.0], 1, "a", 0), (6, [1.0, None], 1, "a", 0), (7, [nan, 1.0], 1, "a", 0), (8, [inf, 1.0], 1, "a", 0)]
    rows += [(9, [], 1, "a", 0), (10, [1.0], 1, "a", 0), (None, [1.0, 0.0], 1, "a", 0), (2, [2.0, 0.0], 1, "a", 0), (11, [1e200, 0.0], 1, "a", 0), (12, [1e-200, 0.0], 1, "a", 0), (13, [-1.0, 0.0], 1, "a", 0)]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == [] and found(spark, rows[2:5]) == by_hand(rows[2:5])


def test_boundary_replication_loses_no_link():
    g = np.random.default_rng(4)
    for dim in (2, 5, 32):
        x = cells.unit(np.concatenate([g.normal(size=(300, dim)), g.normal(size=(1, dim)) + 0.1 * g.normal(size=(200, dim))]))
        pivots = cells.pivots_of(x[::7], 9, 0.2)
        home, ball, reach_cells, reach_balls = cells.reached(x, pivots, 0.2)
        for i, j in zip(*np.nonzero(cells.apart(x, x) <= 0.2)):
            reach = reach_balls if ball[j] else reach_cells
            assert reach[i, home[j]]
            assert not (ball[i] and ball[j] and home[i] == home[j]) or x[i] @ x[j] >= 0.98
        same = ball[:, None] & ball[None] & (home[:, None] == home[None])
        assert ((x @ x.T)[same] >= 0.98 - 1e-12).all()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_given_vectors_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = cells.op13_metric_range_join(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({cells.ORACLE})").fetchall())
