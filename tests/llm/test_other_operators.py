"""Nearest neighbours, archives and the pipeline."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import ann, classifier, ordermin, phrases, rules, warc
from quantloom.llm.common import fresh_path


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int, v string")


def brute(data, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in data if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    for i, q in good:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((q - x) ** 2).sum())), j) for j, x in good if j != i)[:k]
            for rank, (d, j) in enumerate(near, 1):
                yield i, rank, j, d


@pytest.mark.parametrize("files", [True, False])
def test_neighbours_of_a_small_table_are_exact(spark, files):
    g = np.random.default_rng(1)
    data = [(i, [float(x) for x in g.normal(size=8)], 0, "x") for i in range(0, 700)]
    data += [(1000 + i, data[100][1], 0, "x") for i in range(40)]  # copies of a query
    data += [(2000, None, 0, "x"), (2100, [0.0] * 8, 0, "x"), (2200, [float("nan")] + [1.0] * 7, 0, "x"), (2300, [None] + [1.0] * 7, 0, "x"), (None, [1.0] * 8, 0, "x"), (2400, [1.0, 2.0], 0, "x")]
    how = {"rerank": 1.0, "shared": 1} if files else {"n_files": 1, "shared": 1, "rerank": 1.0}  # the latter sends some queries to all rows
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(vectors(spark, data), F.pmod("id", F.lit(100)) == 0, **how).collect())
    want = sorted(brute([d for d in data if d[0] != 2400]))
    if files:
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)
    else:
        assert [x[:2] for x in got] == [x[:2] for x in want]
        by_id = {d[0]: np.array(d[1], np.float32).astype(float) for d in data[:740]}
        assert all(abs(s - np.sqrt(((by_id[q] - by_id[v]) ** 2).sum())) < 1e-12 for q, _, v, s in got)


def test_neighbours_of_few_or_no_rows(spark):
    one = vectors(spark, [(0, [1.0, 2.0], 0, "x")])
    assert ann.nearest(one, F.col("id") == 0).count() == 0
    two = vectors(spark, [(0, [1.0, 2.0], 0, "x"), (7, [1.0, 2.0], 0, "x"), (0, [1.0, 2.0], 0, "x")])
    assert {(r["vec_id"], r["score"]) for r in ann.nearest(two, F.col("id") == 0).collect()} == {(7, 0.0)}
    assert ann.nearest(vectors(spark, []), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    want = {(q, j) for q, _, j, _ in brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])}
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(rows, F.pmod("id", F.lit(100)) == 0).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_files_and_ranks_leave_few_vectors():
    g = np.random.default_rng(2)
    vectors, pivots = g.normal(size=(4000, 16)), g.normal(size=(1000, 16))
    near = ann.files_of(vectors, pivots, 20)
    posted, starts = ann.inverted(near, 1000)
    assert all(set(posted[starts[p] : starts[p + 1]].tolist()) == set(np.flatnonzero((near == p).any(1)).tolist()) for p in range(0, 1000, 37))
    rows = ann.met(posted, starts, near[5], 4000, 4)
    assert rows.tolist() == [i for i in range(4000) if len(set(near[i]) & set(near[5])) >= 4]
    assert 5 in rows and len(rows) < 800
    place = ann.places_of(vectors[:3], pivots[:50])
    d = ((vectors[:3, None] - pivots[None, :50]) ** 2).sum(2)
    assert all((np.argsort(d[i]) == np.argsort(place[i])).all() for i in range(3))


PAGES = "page_id bigint, url string, html string, key string"


def test_archive_round_trip(spark):
    data = [(1, "http://a", "<p>é</p>", "x"), (2, None, None, "x"), (3, "http://b", "<p>é</p>", "x"), (4, "u", "", "x"), (5, "a b\r\nc", "WARC/1.1\r\n\r\n fake \x1f\x8b\x08", "x"), (None, "n", "null id", "x"), (3, "http://b", "<p>é</p>", "x")]
    path = fresh_path(spark, "t")
    warc.write_archive(spark.createDataFrame(data, PAGES).repartition(2), path, file_bytes=2100)
    records, gaps = warc.read_archive(spark, path)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["payload_bytes"], r["refers_to"] or 0) for r in records.collect()))
    assert got == [(0, "response", 7, 0), (1, "revisit", 9, 3), (2, "revisit", 0, 4), (3, "response", 9, 0), (3, "response", 9, 0), (4, "response", 0, 0), (5, "response", 22, 0)]
    assert gaps.count() == 0
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert {r["payload_digest"] for r in records.where("page_id in (1, 3)").collect()} == {digest}
    empty = fresh_path(spark, "t")
    warc.write_archive(spark.createDataFrame([], PAGES), empty)
    assert warc.read_archive(spark, empty)[0].count() == 0


def test_salvage_goes_on_behind_damage():
    recs = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, False, None) for i in range(5)]
    zipped = [warc.member(r) for r in recs]
    ids = lambda data: [warc.key_of(f["warc-record-id"]) for f, _ in warc.salvage(data)[0]]
    assert ids(b"".join(zipped)) == [0, 1, 2, 3, 4] and warc.salvage(b"".join(zipped))[1] == []
    broken = bytearray(zipped[2])
    broken[len(broken) // 2] ^= 0xFF
    data = zipped[0] + zipped[1] + bytes(broken) + zipped[3] + zipped[4][:-9]
    found, gaps = warc.salvage(data)
    assert ids(data) == [0, 1, 3]
    lost = {k for a, b, _ in gaps for k in range(a, b)}
    at = len(zipped[0]) + len(zipped[1])
    assert set(range(at, at + len(broken))) <= lost and len(data) - 1 in lost and at - 1 not in lost
    # plain archives: a wrong length, a flipped byte of a block, junk between records
    wrong = recs[1].replace(b"Content-Length: ", b"Content-Length: 9", 1) if b"Content-Length: " in recs[1] else recs[1]
    flipped = recs[2].replace(b"payload 2", b"PAYLOAD 2", 1)
    data = recs[0] + wrong + b"junk" + flipped + recs[3] + b"tail"
    assert ids(data) == [0, 3]
    assert sum(b - a for a, b, _ in warc.salvage(data)[1]) == len(data) - len(recs[0]) - len(recs[3])
    assert ids(gzip.compress(b"".join(recs))) == [0, 1, 2, 3, 4]
    assert warc.salvage(b"") == ([], [])
    g = random.Random(1)
    for _ in range(50):  # whatever is broken, records before and behind are found
        data = bytearray(b"".join(zipped))
        k = g.randint(len(zipped[0]), len(data) - len(zipped[4]) - 1)
        data[k] ^= 1 << g.randint(0, 7)
        assert {0, 4} <= set(ids(bytes(data)))


def test_salvage_of_foreign_and_odd_archives():
    ids = lambda data: [f.get("warc-record-id") for f, _ in warc.salvage(data)[0]]
    bomb = b"\x1f\x8b\x08 and \x1f\x8b\x08\x00 \r\nWARC/1.1\r\n\r\n"
    plain = [warc.record(i, f"http://x/{i}", bomb if i == 1 else b"text %d" % i, False, None) for i in range(4)]
    assert len(ids(b"".join(plain))) == 4 and warc.salvage(b"".join(plain))[1] == []
    head = "WARC/1.0\r\nWARC-Type: {t}\r\nWARC-Record-ID: <urn:uuid:0f3a-{n}>\r\n{more}Content-Length: {n}\r\n\r\n"

    def foreign(kind, body, more=""):
        return head.format(t=kind, n=len(body), more=more).encode() + body + b"\r\n\r\n"

    untyped = foreign("x", b"ab").replace(b"WARC-Type: x\r\n", b"")
    wrong = foreign("resource", b"abc", "WARC-Payload-Digest: sha1:AAAA\r\n")
    data = foreign("warcinfo", b"software: x") + untyped + foreign("revisit", b"") + wrong + warc.member(foreign("resource", b"abcd")) + plain[0]
    found, gaps = warc.salvage(data)
    rows = [warc.page_row(*x) for x in found]
    assert [(r[0], r[1], r[2]) for r in rows] == [(None, "warcinfo", 11), (None, "revisit", 0), (None, "resource", 4), (0, "response", 6)]
    assert [r[6] for r in rows[:3]] == ["<urn:uuid:0f3a-11>", "<urn:uuid:0f3a-0>", "<urn:uuid:0f3a-4>"]
    assert [g[2] for g in gaps] == ["no type", "wrong payload digest"]
    assert sum(b - a for a, b, _ in gaps) == len(untyped) + len(wrong)
    assert warc.salvage(b"no archive at all " * 9)[0] == []


def test_gaps_are_kept_as_a_table(spark):
    path = fresh_path(spark, "t")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40, "x") for i in range(6)], PAGES).repartition(1)
    warc.write_archive(pages, path)
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    local = files[0].removeprefix("file:")
    data = bytearray(open(local, "rb").read())
    data[60] ^= 0x55  # in the first record
    open(local, "wb").write(data)
    import os

    os.remove(os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc"))
    records, gaps = warc.read_archive(spark, path)
    got, lost = records.collect(), gaps.collect()
    assert 4 <= len(got) < 6 and len(lost) >= 1 and all(0 <= g["start"] < g["stop"] <= len(data) and g["file"] == files[0] for g in lost)


def test_pipeline_is_its_operators_one_after_the_other(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_duplicates", "repeated_passages", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = classifier.score(docs.select(*classifier.READ), classifier.fit(docs, labels))
    ids = {r["doc_id"] for r in scores.where("quality_score.kept").collect()}
    ids &= {r["doc_id"] for r in rules.apply_policy(rules.ledger(docs)).where("kept").collect()}
    third = docs.where(F.col("doc_id").isin(ids))
    ids &= {r["doc_id"] for r in ordermin.classes(third).where("kept").collect()}
    left = phrases.remove_passages(docs.where(F.col("doc_id").isin(ids))).where("n_removed < n_words")
    want = {(r["doc_id"], r["n_words"] - r["n_removed"]) for r in left.collect()}
    got = {(r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 100


def test_pipeline_on_empty_and_awkward_tables(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept int, quality_score int"
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    g = random.Random(2)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(g.randint(3, 8)))
    good = [" ".join(word() for _ in range(80)) for _ in range(5)]
    texts = [*good, good[0], None, "", "  ", "short text", good[1] + " " + word(), " ".join(word() for _ in range(20000))]
    for name, data in (("empty", []), ("odd", [(i, t, None, None, None, "x", 1, 2) for i, t in enumerate(texts)])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, kinds).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        got = {r["doc_id"]: r["length"] for r in corpus_pipeline.run(spark, d).collect()}
        assert got == ({} if not data else {0: 80, 1: 80, 2: 80, 3: 80, 4: 80, 11: 20000})


def test_classifier_finds_held_out_junk(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*classifier.READ)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    model = classifier.fit(docs, known)
    out = classifier.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id")
    rows = [((r["quality"] == 1 and r["toxic"] == 0), r["quality_score"]) for r in out.collect()]
    right = sum(a == s["kept"] for a, s in rows) / len(rows)
    assert right > 0.9
    for one in ("p_content", "p_metadata"):  # both views together are no worse than either alone
        assert right >= sum(a == (s[one] >= 0.5) for a, s in rows) / len(rows) - 0.01
    # calibrated: views are right about as often as they say
    for one in ("p_content", "p_metadata", "p_good"):
        assert abs(sum(s[one] for _, s in rows) / len(rows) - sum(a for a, _ in rows) / len(rows)) < 0.1


def test_exchange_teaches_a_view_what_only_the_other_knows(spark):
    """Few labels, many unlabelled documents: the metadata view knows one source only from the content view's labels."""
    g = random.Random(4)

    def doc(i, good, source):
        text = " ".join(g.choice(["calm", "river", "stone", "paper"] if good else ["spam", "click", "prize", "cheap"]) for _ in range(12))
        return (i, text, "en", source, len(text))

    labelled = [doc(i, i % 2 == 0, "a" if i % 2 == 0 else "b") for i in range(80)]
    free = [doc(1000 + i, False, "c") if i % 2 else doc(1000 + i, True, "d") for i in range(400)]
    docs = spark.createDataFrame(labelled + free, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    before, after = (classifier.fit(docs, labels, rounds=r, confident=0.9) for r in (0, 3))
    x = classifier.metadata(["en", "en"], ["c", "d"], [60, 60])
    bad, good = after.views[1].logit(x)
    assert good > bad + 1 and good - bad > np.diff(before.views[1].logit(x))[0] + 1


def test_sums_over_the_pool_are_those_of_all_its_rows(spark):
    g = np.random.default_rng(3)
    x, m = (g.normal(size=(500, n)).astype(np.float32) for n in (4, 3))
    pool = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes())) for a, b in zip(x, m)], "x binary, m binary").repartition(5)
    judges = [classifier.Logistic(mean=np.zeros(n), scale=np.ones(n), weights=g.normal(size=n + 1) * 2) for n in (4, 3)]
    now = [classifier.Logistic(mean=np.zeros(n), scale=np.ones(n), weights=g.normal(size=n + 1)) for n in (4, 3)]
    got = classifier.told(pool, judges, now, 0.9)
    for v, (own, other) in enumerate(((x, m), (m, x))):
        p = 1 / (1 + np.exp(-(other @ judges[1 - v].weights[:-1] + judges[1 - v].weights[-1])))
        sure = (p >= 0.9) | (p <= 0.1)
        z = np.hstack([own[sure], np.ones((sure.sum(), 1))])
        q = 1 / (1 + np.exp(-z @ now[v].weights))
        assert got[v][0] == sure.sum()
        assert np.allclose(got[v][1], z.T @ ((p[sure] >= 0.5) - q), atol=1e-4)
        assert np.allclose(got[v][2], (z * (q * (1 - q))[:, None]).T @ z, atol=1e-2)


def test_scores_by_hand(spark, sf):
    """Every document's score, from its features and the model's numbers, one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*classifier.READ)
    model = classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def line(model, values):
        w = model.weights
        return sum((a - b) / c * d for a, b, c, d in zip(values, model.mean, model.scale, w[:-1])) + w[-1]

    for r in classifier.score(docs, model).limit(40).collect():
        text = r["text"] or ""
        data = text.encode()
        found = classifier.letters(text)
        lines = [x for x in text.split("\n") if x.strip()]
        x = [sum(data.count(bytes([c])) for c in kind) / max(1, len(data)) for kind in classifier.KINDS]
        x += [np.log1p(len(found)), np.log1p(len(set(found))) / np.log1p(max(1, len(found))), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, 10 / max(1, len(found)))]
        x += [float(w in set(found)) for w in model.words]
        m = classifier.metadata([r["lang"]], [r["source"]], [r["n_chars"]])[0]
        odds = [line(c, [line(v, f)]) for c, v, f in zip(model.calibrated, model.views, (x, m))]
        assert r["quality_score"]["p_good"] == pytest.approx(1 / (1 + np.exp(-line(model.joint, odds))), abs=1e-4)
