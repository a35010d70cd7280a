"""Hard negatives against all inner products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, q int"


def by_hand(rows, scale=256, most=5, low=80, high=100, every=100):
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all():
            good[i, label, tuple(int(np.floor(scale * x)) for x in v)] = None
    out = []
    for i, label, q in good:
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, z)), j, other) for j, other, z in good if j != i)
        for ps, p, _ in [x for x in s if x[2] == label][:most]:
            fit = [x for x in s if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps][:most]
            out += [(i, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.pmod("id", F.lit(100)) == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("dim", "size"), [(64, 0.3), (5, 3.0), (11, 40.0)])
def test_equals_all_inner_products(spark, monkeypatch, dim, size):
    for name, value in (("BLOCK", 300), ("SLICE", 64), ("ANCHORS", 4)):
        monkeypatch.setattr(negatives, name, value)
    g = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in g.normal(scale=size, size=dim)], int(g.integers(4)), "x", 1) for i in range(1500)]
    rows += [(2000 + i, rows[100][1], i % 3, "copy", 1) for i in range(40)]  # ties
    want = by_hand(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_rows_that_take_no_part(spark):
    fine = [(0, [1.0, 1.0], 1, "a", 0), (1, [1.0, 0.5], 1, "a", 0), (2, [1.0, 0.4], 2, "a", 0)]
    odd = [(3, None, 2, "a", 0), (4, [1.0, None], 2, "a", 0), (5, [float("nan"), 1.0], 2, "a", 0), (6, [float("inf"), 1.0], 2, "a", 0), (7, [1.0, 0.4], None, "a", 0), (None, [1.0, 0.4], 2, "a", 0), (8, [1.0], 2, "a", 0), (9, [], 2, "a", 0), (10, [1e300, 1.0], 2, "a", 0)]
    want = [(0, 1, 1, 2, 256 * 384, 256 * 256 + 256 * 102)]
    assert mined(spark, fine + odd + [fine[2]]) == want
    assert mined(spark, []) == [] and mined(spark, fine[:1]) == [] and mined(spark, odd) == []


def test_no_negative_scores_as_positives_bound(spark):
    rows = [(0, [1.0, 0.0], 1, "a", 0), (1, [-1.0, 0.0], 1, "a", 0), (2, [-0.9, 0.0], 2, "a", 0), (100, [0.0, 0.0], 3, "a", 0), (101, [0.0, 0.0], 3, "a", 0)]
    assert mined(spark, rows) == by_hand(rows)


def test_other_counts_and_bounds(spark):
    g = np.random.default_rng(3)
    rows = [(i, [float(x) for x in g.normal(size=6)], int(g.integers(3)), "x", 1) for i in range(400)]
    assert mined(spark, rows, n_positives=3, n_negatives=7, low=50, high=95, scale=16.0) == sorted(
        x for x in by_hand(rows, 16, 7, 50, 95) if x[1] in {y[1] for y in sorted_positives(rows, x[0], 3)}
    )


def sorted_positives(rows, anchor, most):
    q = {i: np.floor(16 * np.array(v)).astype(int) for i, v, *_ in rows}
    label = {i: x for i, _, x, *_ in rows}
    return sorted((-int(q[anchor] @ q[i]), i) for i in q if i != anchor and label[i] == label[anchor])[:most]


def test_tables_hold_all_subset_sums():
    a = np.random.default_rng(1).integers(-200, 200, (3, 13))
    t = negatives.tables_of(a, 9)
    assert t.shape == (2, 256, 3) and t.dtype == np.int32
    for byte in (0, 1, 77, 255):
        bits = [i for i in range(8) if byte >> i & 1]
        assert (t[0, byte] == a[:, bits].sum(1)).all()
    c = np.random.default_rng(2).integers(-300, 300, (50, 13))
    assert (negatives.scores_of(negatives.planes_of(c), negatives.tables_of(a, 10)) == c @ a.T).all()
    big = c << 24
    assert (negatives.scores_of(negatives.planes_of(big), negatives.tables_of(a, 34)) == big @ a.T).all()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_given_vectors_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = negatives.op12_hard_negatives(spark, d)
    want = con.execute(f"select {', '.join(got.columns)} from ({negatives.ORACLE})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
