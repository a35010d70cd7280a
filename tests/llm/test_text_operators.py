"""The text operators against brute force, and on awkward rows: nulls, empty and long texts, ties, repeats, clashing names."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm import classifier, ordermin, packing, phrases, pieces, rules, suffix, tokens
from quantloom.llm.common import written

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, `words` string, h1 int"


def made(n=40, seed=1):
    """Texts with shared passages, copies, near copies, repeated lines, blanks and odd characters."""
    g = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["é", "中文", "naïve", "#x", "<|endoftext|>"]
    passage = " ".join(g.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        body = [g.choice(vocabulary) for _ in range(g.randint(1, 150))]
        if i % 3 == 0:
            at = g.randint(0, len(body))
            body[at:at] = passage.split()
        text = "".join(w + g.choice([" ", " ", " ", "\n", "\t", "  "]) for w in body)
        out.append(text)
    out[5] = out[4]
    words = out[9].split()
    words[len(words) // 2] = "changed"
    out[8] = " ".join(words)
    out[11] = "line one of it\n" * 6
    return out


def rows(texts):
    return [(i, t, "en", "s%d" % (i % 3), len(t or ""), "k", "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*made(), None, "", "   \n ", "a", "word " * 3000, "no"]
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows that repeat ids, null ids, equal texts."""
    data = [(1, "a b c " * 40), (1, "a b c " * 40), (2, "a b c " * 40), (None, "x y z " * 50), (None, None), (3, None), (2, "other")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in data], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_rules_by_hand(docs, awkward, empty):
    got = {r["doc_id"]: r for r in rules.apply_policy(rules.ledger(docs)).collect()}
    for i, text in texts_of(docs).items():
        words = WORD.findall(text)
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        n = collections.Counter(grams)
        repeated = {k for j, x in enumerate(grams) if n[x] > 1 for k in range(j, j + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (r["failed_bits"] == 0)
    assert rules.ledger(awkward).count() == 7
    assert rules.ledger(empty).count() == 0
    kept = rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())


def test_ablations_count_what_a_rule_alone_rejects(docs):
    led = rules.ledger(docs)
    bits = [r["failed_bits"] for r in led.collect()]
    for r in rules.ablations(led).collect():
        one = rules.mask_of((r["rule"],))
        assert r["n_failed"] == sum(bool(b & one) for b in bits)
        assert r["n_failed_alone"] == sum(b == one for b in bits)
        assert r["n_kept_without"] == sum(b & ~one == 0 for b in bits)


def test_token_counts_are_the_librarys(docs, awkward, empty):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in tokens.count_tokens(docs, path).collect():
        text = texts_of(docs)[r["doc_id"]]
        assert r["n_tokens"] == len(lib.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 512)
    assert tokens.count_tokens(awkward, path).count() == 7
    assert tokens.count_tokens(empty, path).count() == 0


def test_pre_tokens_agree_with_the_library_below_the_guard():
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    c = tokens.counter(path)
    for code in range(0x250):
        for text in (f"a{chr(code)}b", f" {chr(code)}{chr(code)} 1{chr(code)}", f"{chr(code)}'s \n\n {chr(code)}"):
            mine = c.cut.findall(text)
            theirs = [text[a:b] for _, (a, b) in c.library.pre_tokenizer.pre_tokenize_str(text)]
            assert mine == theirs, (code, text)
    whole = [s for s in c if c[s] == 1][:2000]
    assert all(len(c.library.encode(s, add_special_tokens=False).ids) == 1 for s in whole if c.cut.findall(s) == [s])


def brute_bytes(texts, length):
    seen = collections.Counter(b[j : j + length] for b in texts.values() for j in range(len(b) - length + 1))
    for i, b in texts.items():
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield i, (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("length", [200, 40])
def test_suffix_dedup(docs, length):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs, length).collect()}
    assert got == dict(brute_bytes({i: t.encode() for i, t in texts_of(docs).items()}, length))
    assert any(v[1] for v in got.values())


def test_suffix_dedup_awkward(awkward, empty):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(awkward).collect())
    assert got == [(0, 0, 0), (0, 300, 300), (1, 240, 240), (1, 240, 240), (2, 5, 0), (2, 240, 240), (3, 0, 0)]
    assert suffix.remove_repeats(empty).count() == 0


def marked_starts(df):
    return {r["key"]: sorted(s for m in r["marks"] for s in range(m["start"], m["start"] + m["n"])) for r in df.collect()}


def test_digit_passes_leave_the_repeated_suffixes(spark):
    """Small chunks, buckets and rounds; long texts in several chunks; digits before the last change nothing."""
    g = random.Random(3)
    base = "".join(g.choice("abcdefgh") for _ in range(6000))
    texts = {0: base, 1: "".join(g.choice("xyz") for _ in range(500)) + base[1200:2900], 2: base[100:350], 3: "z" * 900, 4: None, 5: "é" * 150, 6: "q" + "é" * 120}
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = collections.Counter(b[j : j + 200] for b in data.values() for j in range(len(b) - 199))
    want = {k: [j for j in range(len(b) - 199) if seen[b[j : j + 200]] > 1] for k, b in data.items()}
    df = spark.createDataFrame(list(texts.items()), "key bigint, text string").repartition(2)
    for depths in ((), (32, 64)):
        got = marked_starts(suffix.repeated(df, 200, chunk_bytes=1000, bucket_bytes=600, depths=depths))
        assert got == {k: v for k, v in want.items() if v}


def test_suffixes_of_hot_anchors_go_on_one_by_one(spark):
    """A passage in many texts, each with contexts of its own, of which some repeat: the same rows whether its anchors are hot or not."""
    g = random.Random(8)
    word = lambda n: "".join(g.choice("abcdefgh ") for _ in range(n))
    passage, contexts = word(260), [word(150) for _ in range(9)]
    texts = {k: contexts[k % 7] + passage + (contexts[k % 9] if k % 3 else word(150)) for k in range(40)} | {40: passage * 3, 41: "ab" * 400}
    data = {k: t.encode() for k, t in texts.items()}
    seen = collections.Counter(b[j : j + 200] for b in data.values() for j in range(len(b) - 199))
    want = {k: [j for j in range(len(b) - 199) if seen[b[j : j + 200]] > 1] for k, b in data.items()}
    df = spark.createDataFrame(list(texts.items()), "key bigint, text string").repartition(3)
    for hot in (1, 5, 1 << 14):
        got = marked_starts(suffix.repeated(df, 200, chunk_bytes=2000, bucket_bytes=3000, hot=hot))
        assert got == {k: v for k, v in want.items() if v}


def test_digit_passes_decide_by_bytes():
    """Suffixes that are dealt together without being equal part at the byte where they differ; those dealt apart aren't compared."""
    import numpy as np

    g = np.random.default_rng(5)
    for length, ends in ((20, [8, 16, 20]), (24, [8, 16, 24]), (5, [5]), (20, [3, 8, 16, 20])):
        data = g.integers(97, 99, 4000).astype(np.uint8)
        data[2000:2300] = data[100:400]
        at = np.arange(len(data) - length + 1)
        weight = g.integers(1, 3, len(at))
        group = g.integers(0, 3, len(at)).astype(np.uint64)
        got = suffix.left_over(data.tobytes() + bytes(8), at, suffix.spread(group), weight, ends)
        names = [(int(group[i]), data[i : i + length].tobytes()) for i in at]
        total = collections.Counter()
        for x, w in zip(names, weight.tolist()):
            total[x] += w
        assert got.tolist() == [total[x] > 1 for x in names]
        assert 0 < got.sum() < len(got) or length == 5


def test_names_that_agree_in_their_leading_bits_are_sorted_in_full():
    import numpy as np

    g = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        for kind in (np.uint32, np.uint64):
            name = (g.integers(0, 9, n).astype(np.uint64) << np.uint64(20) | g.integers(0, 5, n).astype(np.uint64)).astype(kind)
            bucket = g.integers(0, 6, n).astype(np.uint64)
            for b in (None, bucket):
                order, first = suffix.ordered(name, b)
                keys = [(int(x), int(y)) for x, y in zip(bucket if b is not None else np.zeros(n), name)]
                ranked = [keys[i] for i in order]
                assert sorted(order.tolist()) == list(range(n))
                assert [ranked[i] for i in first] == list(dict.fromkeys(ranked)) and len(set(ranked)) == len(first)
                if b is not None:
                    assert [x for x, _ in ranked] == sorted(x for x, _ in ranked)


def test_very_long_texts_reach_the_workers_cut(spark):
    """Texts far longer than a stretch or a chunk share one passage at their ends and one across a cut."""
    from quantloom.llm import kernels

    g = random.Random(6)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(5))
    shared, other = [word() for _ in range(60)], [word() for _ in range(60)]
    first = [word() for _ in range(kernels.STRETCH + 2000)]
    second = [word() for _ in range(kernels.STRETCH + 2000)]
    first[-60:] = shared
    first[kernels.STRETCH - 30 : kernels.STRETCH + 30] = other
    second[5:65] = shared
    second[kernels.STRETCH - 25 : kernels.STRETCH + 35] = other
    df = spark.createDataFrame(rows([" ".join(first), " ".join(second)]), SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in phrases.remove_passages(df).collect()}
    assert got == {0: 0, 1: 120}
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(df).collect()}
    assert all(s == 2 and 2 * 359 <= n <= 2 * 359 + 4 for n, s in got.values())


def brute_passages(texts, width):
    seen = set()
    out = {}
    for i in sorted(texts):
        words = WORD.findall(texts[i])
        gone = [False] * len(words)
        for j in range(len(words) - width + 1):
            w = tuple(words[j : j + width])
            if w in seen:
                gone[j : j + width] = [True] * width
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_repeated_passages(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.remove_passages(docs).collect()}
    assert got == brute_passages(texts_of(docs), 20)
    assert any(v[1] for v in got.values())


def test_repeated_passages_awkward(awkward, empty):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in phrases.remove_passages(awkward).collect())
    # one of three equal texts keeps its first period of three words and what a window needs; the others keep nothing
    assert [x for x in got if x[1] == 120] == [(1, 120, 117), (1, 120, 120), (2, 120, 120)]
    assert phrases.remove_passages(empty).count() == 0


def test_automata_locate_every_occurrence(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 2)
    texts = ["a b c d e b c", "c d e\nx  y z", "é b c", None, "bc b", "b c b c b c"]
    wanted = [" b c ", " c d e ", " y z ", " b c b ", " é "]
    found = phrases.located(texts, wanted)
    for text, at in zip(texts, found):
        words = WORD.findall(text or "")
        want = sorted(j for p in wanted for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        assert sorted(at.tolist()) == want


def test_automata_decide(spark, monkeypatch):
    """Where the hashes of different phrases agree, only what is located letter by letter counts: without it words would go."""
    from quantloom.llm import kernels, windows

    texts = [" ".join(f"a{i}" for i in range(40)), " ".join(f"a{i}" for i in range(30)) + " tail", " ".join(f"b{i}" for i in range(40))]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    own = windows.keyed(df, "doc_id", "text")
    anchors = windows.anchor_rows(own, 20, 8)
    again = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "at")).alias("first")).where("c > 1").select("gram", "first.key", "first.at")
    tables = lambda *dfs: [written(df, "table") for df in dfs]  # noqa: E731  locate deletes what it takes over
    good = phrases.locate(own, *tables(anchors, again), 20, 8).collect()
    assert {r["key"] for r in good} == {0, 1}
    wrong = again.withColumn("key", F.lit(2).cast("bigint")).withColumn("at", F.lit(3))  # as if the hashes stood for other words
    assert phrases.locate(own, *tables(anchors, wrong), 20, 8).count() == 0
    assert kernels is not None


def test_without_phrases_no_place_is_found(spark):
    """The places come from the automata alone: anchors that recur, but whose phrases are not in the dictionary, lead to no run."""
    from quantloom.llm import windows

    own = windows.keyed(spark.createDataFrame(rows([" ".join(f"a{i}" for i in range(40))] * 2), SCHEMA), "doc_id", "text")
    anchors = written(windows.anchor_rows(own, 20, 8), "anchors")
    none = written(anchors.select("gram", "key", "at").limit(0), "again")
    assert phrases.locate(own, anchors, none, 20, 8).count() == 0


def test_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("x", text), ("b", text), (None, None), ("c", "one two")], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in phrases.remove_passages(df).collect()} == {"x": 60, "b": 0, None: 0, "c": 0}
    assert {r["doc_id"]: r["n_removed"] > 0 for r in suffix.remove_repeats(df).collect()} == {"x": True, "b": True, None: False, "c": False}
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in ordermin.classes(df).collect()} == {"x": ("b", False), "b": ("b", True), None: (None, True), "c": ("c", True)}
    clash = df.where("doc_id is not null").selectExpr("doc_id", "text", "1 as n_words", "2 as kept", "3 as n_removed", "4 as id", "5 as rest")
    out = phrases.drop_repeats(clash)
    assert out.columns == clash.columns and sorted(r["doc_id"] for r in out.collect()) == ["b", "c"]
    got = pieces.sampled(df, tokens.tokenizer_path("piece_bpe_32k.model"), k=1)
    assert got.count() == 4 and pieces.decode(got.withColumn("text", F.lit("old")), tokens.tokenizer_path("piece_bpe_32k.model")).where("text = 'one two'").count() == 1


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def test_near_duplicates_match_all_pairs(docs, awkward, empty):
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(docs).collect()}
    sets = shingle_sets(texts_of(docs))
    home = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(home[i], home[j]), min(home[i], home[j])
                home = {k: new if v == old else v for k, v in home.items()}
    assert got == home
    assert got[5] == 4 and got[9] == 8
    kept = [(r["doc_id"], r["kept"]) for r in ordermin.classes(awkward).collect()]
    assert len(kept) == 7 and sum(k for _, k in kept) == 5
    assert ordermin.classes(empty).count() == 0


def linked_classes(texts):
    """Classes of all pairs that agree in 0.8 of their shingles, by brute force; shingles of a text differ."""
    sets = shingle_sets(texts)
    home = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and home[i] != home[j]:
                old, new = max(home[i], home[j]), min(home[i], home[j])
                home = {k: new if v == old else v for k, v in home.items()}
    return home


def edited(words, places, mark):
    return " ".join(f"{mark}x{p}" if p in places else w for p, w in enumerate(words))


def test_short_texts_match_all_pairs(spark):
    texts = []
    for n in range(5, 13):
        for v in range(6):
            base = [f"s{n}.{v}.{i}" for i in range(n)]
            texts += [" ".join(base), " ".join(["before", *base]), " ".join([*base, "behind"])]
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == linked_classes(dict(enumerate(texts)))


def test_families_and_chains_of_near_duplicates_are_whole(spark):
    g = random.Random(8)
    texts = []
    for f in range(2):  # a few texts with one edit, many with two: these are linked by the former alone
        base = [f"f{f}w{i}" for i in range(150)]
        texts += [edited(base, {10 * i + 5}, f"a{f}.{i}.") for i in range(6)]
        texts += [edited(base, {p, p + 55 + g.randrange(30)}, f"b{f}.{i}.") for i in range(150) for p in [5 + g.randrange(50)]]
    chain = [f"c{i}" for i in range(150)]
    for i in range(40):  # each is linked with its neighbours alone
        texts.append(" ".join(chain))
        for p in ((37 * i) % 145, (37 * i + 70) % 145):
            chain[p] = f"c{i}.{p}"
    g.shuffle(texts)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    want = linked_classes(dict(enumerate(texts)))
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(df).collect()}
    assert len(set(want.values())) < len(texts) / 10
    assert got == want


def test_prefixes_find_every_pair(spark, monkeypatch):
    """The exact way through hot buckets: every similar pair of different classes is a pair, and few others are."""
    g = random.Random(12)
    texts = {}
    for f, n in ((0, 60), (1, 61), (2, 90)):
        base = [f"f{f}w{i}" for i in range(n)]
        for i in range(70):
            out = list(base)
            for _ in range(g.randrange(6)):
                at = g.randrange(len(out))
                out[at : at + g.randrange(2)] = [f"e{f}.{i}.{g.randrange(3)}"] * g.randrange(2)
            texts[len(texts)] = " ".join(out)
    sets = shingle_sets(texts)
    df = spark.createDataFrame(list(texts.items()), "key bigint, text string")
    seqs = ordermin.shingled(df, 5)
    hot = spark.createDataFrame([(i, len(s), i % 50) for i, s in sets.items()], "rep bigint, size int, label bigint")
    got = {(r["a"], r["b"]) for r in ordermin.prefix_pairs(hot, seqs, 0.8).collect()}
    same = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = {(i, j) for i in sets for j in sets if i < j and i % 50 != j % 50 and same(i, j) >= 0.8 and texts[i].split() != texts[j].split()}
    assert want <= got and len(got) < 210 * 209 / 2 * 0.6 and len(want) > 200
    # the whole operator, with all buckets hot
    monkeypatch.setattr(ordermin, "FEW", 0)
    df = spark.createDataFrame(rows([texts[i] for i in sorted(texts)]), SCHEMA)
    for rounds in (0, 4):
        assert {r["doc_id"]: r["class_id"] for r in ordermin.classes(df, rounds=rounds).collect()} == linked_classes(texts)


def test_alignment_is_the_longest_common_sequence():
    import numpy as np

    g = random.Random(5)
    for _ in range(200):
        a = g.sample(range(60), 40)
        b = [x for x in a if g.random() > 0.08]
        if g.random() < 0.5:
            i, j = sorted(g.sample(range(len(b)), 2))
            b[i], b[j] = b[j], b[i]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        m = table[-1][-1]
        want = m / (len(a) + len(b) - m)
        got = ordermin.alignment(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_packing_is_optimal_and_fits(docs, awkward, empty):
    import itertools

    import numpy as np

    g = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(g.integers(1, 40, 9))
        counts = g.integers(1, 20, len(lengths))
        bounds = packing.optimal_bounds(lengths, counts, 3)
        cost = lambda b: sum(int(n) * (min(x for x in b if x >= v) - int(v)) for v, n in zip(lengths, counts))
        best = min(cost([*c, int(lengths[-1])]) for k in range(3) for c in itertools.combinations(map(int, lengths[:-1]), k))
        assert cost(bounds) == best
    got = packing.pack(docs, packing.n_words(F.col("text")), n_buckets=4, token_budget=500, shard_rows=7).collect()
    assert len(got) == docs.count() and len({(r["batch_id"], r["slot"]) for r in got}) == len(got)
    by = collections.Counter(r["batch_id"] for r in got)
    for r in got:
        assert r["length"] + r["padding"] == r["padded_length"] >= r["length"]
        assert by[r["batch_id"]] * r["padded_length"] <= 500 or by[r["batch_id"]] == 1
    full = collections.Counter(r["bucket"] for r in got)
    for b, n in full.items():
        fits = max(1, 500 // next(r["padded_length"] for r in got if r["bucket"] == b))
        assert len({r["batch_id"] for r in got if r["bucket"] == b}) == -(-n // fits)
    assert packing.pack(awkward, packing.n_words(F.col("text"))).count() == 7
    assert packing.pack(empty, packing.n_words(F.col("text"))).count() == 0


def test_packing_is_optimal_over_thousands_of_lengths(spark):
    import numpy as np

    df = spark.range(1, 5000).select((F.col("id") * F.col("id") % 9973).alias("length"))
    lengths, counts = packing.histogram(df)
    assert counts.sum() == 4999 and len(lengths) > 2048 and (np.diff(lengths) > 0).all()
    bounds = packing.optimal_bounds(lengths, counts, 6)
    rows, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    best = np.append(0, np.full(len(lengths), 1 << 60))
    for _ in range(6):  # the plain quadratic program
        new = best.copy()
        for j in range(1, len(best)):
            new[j] = min(best[j], (best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])).min())
        best = new
    bound_of = np.array(bounds)[np.searchsorted(bounds, lengths)]
    assert ((bound_of - lengths) * counts).sum() == best[-1]
    assert packing.optimal_bounds(np.array([5]), np.array([2]), 4) == [5]


def test_segmentations(docs, awkward, empty):
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    texts = texts_of(docs)
    got = pieces.sampled(docs, path, k=3).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    lib = pieces.lattices(path, 0.4).model
    for i, found in by.items():
        found.sort(key=lambda r: r["sample"])
        assert len({tuple(r["ids"]) for r in found}) == len(found)
        assert [r["perturbed"] for r in found] == sorted((r["perturbed"] for r in found), reverse=True)
        for r in found:
            assert 0 <= r["inclusion"] <= 1
            assert lib.decode(r["ids"]) == texts[i] if texts[i] else not r["ids"]
    back = pieces.decode(pieces.sampled(docs, path, k=1), path).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in back)
    again = {(r["doc_id"], r["sample"]): r["ids"] for r in pieces.sampled(docs.repartition(5), path, k=3).collect()}
    assert again == {(r["doc_id"], r["sample"]): r["ids"] for r in got}
    assert pieces.sampled(awkward, path).count() >= 7
    assert pieces.sampled(empty, path).count() == 0


def every_path(lat, state):
    """All paths through one lattice, with their log probabilities."""
    _, then, piece, share = lat.flat
    stack = [(state, (), 0.0)]
    while stack:
        s, ids, p = stack.pop()
        if s < 0:
            yield ids, p
            continue
        for e in range(int(lat.first[s]), int(lat.first[s + 1])):
            stack.append((int(then[e]), (*ids, int(piece[e])), p + math.log(share[e])))


def test_segmentation_beside_those_taken():
    """The walk that avoids taken paths has the odds of the others, and ends when there are none."""
    import numpy as np

    lat = pieces.Lattices(tokens.tokenizer_path("piece_bpe_32k.model"), 0.4)
    state = int(lat.prepare([pieces.normal("that")])[0])
    paths = dict(every_path(lat, state))
    likely = sorted(paths, key=paths.get, reverse=True)
    for n in (1, 3, len(paths) - 2):
        taken = likely[:n]
        rest = {p: math.exp(paths[p]) for p in paths if p not in taken}
        got = collections.Counter(pieces.walk_beside(lat, state, taken, s * 7919)[0] for s in range(3000))
        assert set(got) <= set(rest)
        for p in sorted(rest, key=rest.get, reverse=True)[:3]:
            assert got[p] / 3000 == pytest.approx(rest[p] / sum(rest.values()), abs=0.04)
    assert pieces.walk_beside(lat, state, likely, 1) is None
    assert np.isclose(sum(lat.weight(state, p) for p in paths), 1)
    lat.done()


def test_the_librarys_own_segmentation_is_in_the_lattice():
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    lat = pieces.Lattices(path, 0.4)
    for text in ("if x:\n    return  1", "a   b", "   lead", "trail   ", "naïve 中文 \t x", "\n\n  \n"):
        found = pieces.STRETCHES.findall(pieces.normal(text))
        assert "".join(found) == pieces.normal(text)
        ways = [[list(lat.expanded(np_ids(p))) for p, _ in every_path(lat, int(s))] for s in lat.prepare(found)]
        left = [[]]
        want = lat.model.encode(text)
        for w in ways:
            left = [[*a, *b] for a in left for b in w if want[len(a) : len(a) + len(b)] == b]
        assert want in left, text
    lat.done()


def np_ids(ids):
    import numpy as np

    return np.array(ids, np.int32)


def test_segmentation_frequencies_without_replacement():
    import itertools

    import numpy as np

    lat = pieces.Lattices(tokens.tokenizer_path("piece_bpe_32k.model"), 0.4)
    text, n = "of th", 5000
    stretches = pieces.STRETCHES.findall(pieces.normal(text))
    paths = [list(every_path(lat, int(s))) for s in lat.prepare(stretches)]
    lat.done()
    p = {sum((x[0] for x in c), ()): float(np.exp(sum(x[1] for x in c))) for c in itertools.product(*paths)}
    assert sum(p.values()) == pytest.approx(1)
    first, pair, weight = collections.Counter(), collections.Counter(), collections.Counter()
    for found in list(pieces.samples_of(np.arange(n), [text] * n, lat, 3)):
        ids = [tuple(x[0].tolist()) for x in found]
        first[ids[0]] += 1
        pair[ids[0], ids[1]] += 1
        for i, x in zip(ids, found):
            assert x[1] == pytest.approx(np.log(p[i]))
            weight[i] += 1 / x[3] / n
    likely = sorted(p, key=p.get, reverse=True)[:3]
    for a in likely:
        assert first[a] / n == pytest.approx(p[a], abs=0.02)
        assert weight[a] == pytest.approx(1, abs=0.15)  # inverse inclusion weights are unbiased
    a, b = likely[:2]
    assert pair[a, b] / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.03)


def test_classifier_awkward(spark, docs, awkward, empty):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)] + [(31, None, None), (32, 1, 1)], "doc_id bigint, quality int, toxic int")
    for df in (docs, awkward, empty):
        out = classifier.score(df.select(*classifier.READ), classifier.fit(df, labels))
        assert out.count() == df.count()
    none = classifier.fit(docs, labels.where("false"))
    assert classifier.score(docs.select(*classifier.READ), none).where("quality_score.kept").count() == docs.count()


def test_names_of_anchors_spread_over_buckets():
    """An anchor is the gram with the least hash of some hundred: dealt by that hash, nearly all would go to the first bucket."""
    import numpy as np

    data = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8)
    runs, _, _ = suffix.anchored(200)(data, np.array([len(data)]), None)
    sizes = np.bincount(suffix.bucket_of(runs["name"], 8).astype(int), minlength=8)
    assert len(runs) > 2000 and sizes.max() < 1.3 * sizes.mean()
