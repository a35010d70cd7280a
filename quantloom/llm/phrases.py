"""Removal of repeated passages, located by Aho-Corasick automata.

Phrases of `gram` words that recur anywhere in the corpus are confirmed by their counts (windows.py) and make a dictionary: each
phrase once, with its words as they stand at the first place. The dictionary is cut into shards by where it is needed: every
part of the documents gets those phrases that the hashes of its own phrases ask for, whichever document they were taken from, in
automata of at most `SHARD` phrases. All documents that ask for any stream through the automata of their part, and the places that
these locate, letter by letter, are the only ones around which windows of `width` words go on to be compared in full: an occurrence of any of the part's
phrases counts, and a hash that agrees by chance finds nothing. So no document meets phrases that it can't hold, and the work grows with the
input, as it would not if all documents met all shards. Of equal windows the first (smallest id, then smallest start) stays, and
the words of all others go. Windows are judged on the input.

Defined results: a null text has no words, and the hash of the empty string. Texts shorter than a window stay whole
but for their blanks: what is kept is words joined by one space. Rows that repeat an id count as documents one after the
other, in the order of their texts' hashes; null ids come before all others. Ids may be of any type that can be sorted. An
empty table gives no rows. Only the two named columns are read; `drop_repeats` carries all others, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import cut, forget, written

WORD = re.compile("[^\x20\x09-\x0d]+")
SHARD = 16_000


def plain(text: str | None) -> tuple[str, np.ndarray]:
    """The words with one blank before, between and behind them, and where each begins."""
    words = WORD.findall(text or "")
    begins = np.cumsum([1] + [len(w) + 1 for w in words])
    return f" {' '.join(words)} ", begins


def dictionary(docs: DataFrame, again: DataFrame, gram: int) -> DataFrame:
    """gram, phrase: the words of each recurring phrase (again: gram, key, at), read at the one place given."""
    places = again.groupBy("key").agg(F.collect_list(F.struct("gram", "at")).alias("places"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 0):
            for text, own in zip(b.column(0), b.column(1), strict=True):
                words, begins = plain(text.as_py())
                at = own.values.field(1).to_numpy()
                found = [words[x - 1 : y] for x, y in zip(begins[at].tolist(), begins[at + gram].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.values.field(0), pa.array(found, pa.string())], ["gram", "phrase"])

    return docs.join(places, "key").select("text", "places").mapInArrow(task, "gram bigint, phrase string")


def located(texts: list[str | None], phrases: list[str]) -> list[np.ndarray]:
    """For each text, at which words one of the phrases stands: every occurrence. Phrases differ, and have a blank at both ends."""
    rows = [plain(t) for t in texts]
    found = [[] for _ in rows]
    for i in range(0, len(phrases), SHARD):
        automaton = ahocorasick.Automaton()
        for phrase in phrases[i : i + SHARD]:
            automaton.add_word(phrase, 2 - len(phrase))  # from a hit's end to where its first word begins
        automaton.make_automaton()
        for (words, _), at in zip(rows, found, strict=True):
            at += [end + back for end, back in automaton.iter(words)]
    return [np.searchsorted(begins, np.array(at, np.int64)) for (_, begins), at in zip(rows, found, strict=True)]


def locate(docs: DataFrame, anchors: DataFrame, again: DataFrame, width: int, gram: int) -> DataFrame:
    """The runs of windows (windows.RUN) around the places at which the automata locate a phrase. Takes the tables of anchors and phrases over.

    A part of the documents gets the phrases that it may hold, told by hashes; where they stand, only the automata say.
    """
    known = written(dictionary(docs, again, gram), "dictionary")
    forget(again)
    asks = written(anchors.select("key", "gram").join(known, "gram").select("key", "phrase"), "asked")
    forget(anchors)
    forget(known)
    asked = asks.groupBy("key").agg(F.collect_list("phrase").alias("asked"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, 1 << 19):
            phrases = pc.unique(b.column(2).flatten()).to_pylist()
            found = located(b.column(1).to_pylist(), phrases)
            span = 2 + (pc.max(pc.binary_length(b.column(1))).as_py() or 0)  # more than any text has words
            places = np.unique(np.concatenate([row * span + at for row, at in enumerate(found)] or [np.zeros(0, np.int64)]))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, start, n, place, gram_hash, whole in windows.anchored(b.column(1), width, gram, True):
                kept = np.flatnonzero(np.isin(row.astype(np.int64) * span + start + place, places))
                cols = [keys[row[kept]], start[kept], n[kept], place[kept], gram_hash[kept], whole[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "start", "n", "place", "gram", "whole"])

    out = written(docs.join(asked, "key").select("key", "text", "asked").mapInArrow(task, windows.RUN), "located")
    forget(asks)
    return out


def marked(docs: DataFrame, width: int, key: str, text: str, gram: int) -> DataFrame:
    own = windows.keyed(docs, key, text)
    marks = windows.repeated(own, width, gram, 4, lambda d, rows, again: locate(d, rows, again, width, gram))
    return own.join(marks, "key", "left").select("id", "text", "marks")


def split_kept(text: str | None, marks: pa.Scalar, width: int) -> tuple[int, list[str]]:
    """How many words the text has, and those that stay."""
    words = WORD.findall(text or "")
    if not marks.is_valid:
        return len(words), words
    flat = marks.values
    gone = windows.covered(len(words), flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64), width)
    return len(words), list(compress(words, ~gone))


def remove_passages(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text", gram: int = 8) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space)."""
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            n, removed, digest, rest = [], [], [], []
            for t, marks in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                total, words = split_kept(t, marks, width)
                kept = " ".join(words)
                n.append(total)
                removed.append(total - len(words))
                digest.append(hashlib.sha256(kept.encode("utf-8")).hexdigest())
                rest.append(kept)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    return marked(docs, width, key, text, gram).mapInArrow(task, schema).withColumnRenamed("id", key)


def drop_repeats(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with what remains of each text: a text that loses nothing is left as it is, one that loses all its words goes.

    For tables whose ids are unique and not null, as a pipeline's are.
    """
    kept = remove_passages(docs.select(key, text), width, key, text).where("n_removed > 0")
    told = kept.select(F.col(key).alias("id"), F.struct("n_words", "n_removed", "kept").alias("rest"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    both = whole.join(told, F.col(f"row.`{key}`") == F.col("id"), "left").where("rest is null or rest.n_removed < rest.n_words")
    return both.select(*[F.coalesce("rest.kept", f"row.`{text}`").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (
  select doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from w where len(words) >= 20)),
f as (select doc_id, i, row_number() over (partition by gram order by doc_id, i) > 1 as repeated from g),
c as (select distinct doc_id, unnest(range(i, i + 20)) as k from f where repeated),
l as (select doc_id, list(k) as gone from c group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when gone is null then words else list_filter(words, lambda x, k: not list_contains(gone, k)) end, ' '), '')) as kept_sha256
from w left join l on w.doc_id = l.doc_id
"""
