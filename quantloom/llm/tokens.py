"""Token counts with a whole-token shortcut.

Offline, from the vocabulary file alone: a vocabulary string that its own merge rules bring back to one token is a
*whole token*. A pre-token equal to such a string counts 1, by one lookup and without merging. Only the other pre-tokens are
merged, by the library's model, and the counts of recent ones are remembered (a bounded cache; it never changes a count).

Defined results: a null text counts as empty, 0 bytes and 0 tokens. Each row is counted for itself, so repeated rows,
null keys and empty tables need no care, and only the key and the text are read. Texts with characters past U+024F are cut
into pre-tokens by the library itself, since the character classes of two regex libraries may differ there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the vocabulary's format: how text is cut, and how bytes are written as printable characters.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_CLASSES = regex.compile(r"[^\x00-ɏ]")
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


def whole_tokens(vocab: dict[str, int], model) -> set[str]:
    """Vocabulary strings, as byte letters, that the merges alone turn back into one token."""
    return {s for s in vocab if len(model.tokenize(s)) == 1}


class Counter(dict):
    """Pre-token -> number of its tokens. Whole tokens are in it from the start; others are merged when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.write = {b: c for b, c in enumerate(letters)}
        read = {c: b for b, c in enumerate(letters)}
        super().__init__()
        for s in whole_tokens(spec["model"]["vocab"], self.library.model):
            try:
                self[bytes(read[c] for c in s).decode("utf-8")] = 1
            except (KeyError, UnicodeDecodeError):
                continue  # no text can be cut into a part of a character
        self.base = len(self)
        self.cut = regex.compile(PRE_TOKEN)
        self.rest = {}

    def __missing__(self, piece: str) -> int:
        n = self.rest.get(piece)
        if n is None:
            if len(self.rest) >= REMEMBERED:
                self.rest.clear()
            n = self.rest[piece] = len(self.library.model.tokenize("".join(map(self.write.__getitem__, piece.encode("utf-8")))))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        for s in self.special:
            if s in text:  # one token by itself; what lies between is cut anew
                return text.count(s) + sum(map(self.count, text.split(s)))
        if KNOWN_CLASSES.search(text):
            pieces = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            return sum(map(self.__getitem__, pieces))
        return sum(map(self.__getitem__, self.cut.findall(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit. path: the tokenizer's .json file, at the same place on every executor."""
    kind = docs.schema[key].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in cut(batches, 1):
            n = pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["k", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n"))
    out = rows.mapInArrow(counts, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
