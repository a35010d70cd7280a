"""Fill-in-the-middle: forms and cuts against plain slicing, skip lists against sums."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import middle


def by_hand(key, text, pattern=None, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = list(t) if pattern is None else [u for u in re.split(f"({pattern})", t) if u]
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = ("".join(x) for x in (units[:a], units[a:z], units[z:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "né 漢字 😀", "has <M> inside", "<P", "x" * 70_000, "😀é" * 3_000, " \n\t ", "é combining", "<P<S>", "line\r\nline"] + [f"text {i} " * (i % 37) for i in range(300)]


@pytest.mark.parametrize("pattern", [None, r"\w+"])
def test_forms_cuts_and_round_trip(spark, pattern):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(5, "a repeated id", "x", 2), (5, "a repeated id", "x", 2), (None, "no id at all", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, form int")
    out = middle.arrange(docs, unit=pattern)
    got = out.select("*", middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    want = [(i, *by_hand("null" if i is None else i, t, pattern)) for i, t, *_ in rows]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert middle.arrange(docs.limit(0)).count() == 0


def test_other_marks_seeds_and_keys(spark):
    docs = spark.createDataFrame([(f"k{i}", "some words here " * i) for i in range(1, 60)], "id string, body string")
    out = middle.arrange(docs, key="id", text="body", seed=7, marks=("[a]", "(b", "c*"), plain_from=100, spm_below=100)
    got = out.select("*", middle.restored(F.col("output"), F.col("form"), ("[a]", "(b", "c*")).alias("back")).collect()
    assert {r["form"] for r in got} == {"spm"} and {(r["id"], r["back"]) for r in got} == {(f"k{i}", "some words here " * i) for i in range(1, 60)}


def test_skip_lists_reach_every_rank():
    g = np.random.default_rng(5)
    sizes = np.array([0, 1, 5000, 0, 17, 900, 1])
    widths = np.stack([np.ones(sizes.sum(), np.int64), *(g.integers(1, 9, (2, sizes.sum())))], axis=1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    lists = middle.SkipLists(widths, at)
    assert len(lists.lanes) >= 3
    for t, n in enumerate(sizes):
        ranks = np.arange(n + 1)
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(widths[at[t] : at[t + 1]], axis=0)])
        assert (lists.reach(np.full(n + 1, t), ranks) == sums).all()


def test_lanes_thin_out():
    h = middle.heights(np.arange(1 << 16))
    assert abs((h >= 1).mean() * middle.FAN - 1) < 0.1 and (h >= 2).any()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_given_documents_against_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    got = middle.op11_fill_in_middle(spark, d)
    names = got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"select {', '.join(names)} from ({middle.ORACLE})").fetchall(), key=repr)
