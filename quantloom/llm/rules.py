"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once. A ledger row holds the measurements and one BIGINT whose bit i says that rule i failed.
Policies are versioned sets of rules: applying one, comparing two, or asking what dropping a rule would bring back are
bitwise operations on the ledger; the texts aren't read again.

Defined results: a null text has no words, so all its counts are 0 and `too_short` fails. A text of blanks only is the
same. Rows are judged one by one: repeated rows, ties and null keys are kept as they are. An empty table gives an empty
ledger. Extra columns of the input don't reach the ledger, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, written

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than blanks. Plain replacements and a plain split cost half of a pattern."""
    return F.array_remove(F.split(one_blank(text), " "), "")


def one_blank(text: Column) -> Column:
    for b in BLANKS[1:]:
        text = F.replace(text, F.lit(b), F.lit(" "))
    return text


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column, width: int) -> Column:
    """How many words lie in windows of `width` words that occur twice or more, the first occurrence included."""

    def wider(hashes: Column, by: Column, shift: int) -> Column:
        """Element i is a hash of hashes[i] and by[i + shift]."""
        later = F.slice(by, F.lit(shift + 1), F.greatest(F.size(by) - shift, F.lit(0)))
        return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))

    def marked(hashes: Column) -> Column:
        """Hashes of the windows, from hashes of 2, 4, 8 ... words and what is left to `width`."""

        def grown(h: Column, have: int) -> Column:
            if have == width:
                return let(F.slice(h, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0))), from_grams)
            if 2 * have <= width:
                return let(wider(h, h, have), lambda x: grown(x, 2 * have))
            return let(wider(h, hashes, have), lambda x: grown(x, have + 1))

        return grown(hashes, 1)

    def from_grams(grams: Column) -> Column:
        repeats = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(repeats, let(in_order(grams), covered)).otherwise(F.lit(0).cast("bigint"))

    def in_order(grams: Column) -> Column:
        """Positions of the repeated windows, ascending: sort by (hash, position), keep those with an equal neighbour."""
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def neighbours(p: Column) -> Column:
            same = lambda x, at: F.coalesce(F.get(p, at)["g"] == x["g"], F.lit(False))
            kept = F.filter(p, lambda x, at: same(x, at - 1) | same(x, at + 1))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        return let(pairs, neighbours)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    return let(F.transform(words, lambda w: F.xxhash64(w)), marked)


def measurements(text: Column) -> dict[str, Column]:
    """Columns over the whole text. Windows are compared by 64-bit hashes inside one document, of at most some 1e5 windows."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("words"), 5),
        "n_upper": F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("bigint"),
    }


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` is true; its bit is its place in RULES, which therefore only grows at its end."""

    name: str
    fails: str


RULES = (
    Rule("too_short", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * n_upper > word_chars and word_chars > 40"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
)
BASE = ("too_short", "repeated_windows")

#: Versioned policies: a document is kept if it fails none of the policy's rules.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "shouting", "word_length"),
}


def mask_of(names: tuple[str, ...]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements, and failed_bits."""
    return ledger_of(docs.select(F.col(key), F.col(text).alias("text")), [key])


def ledger_of(docs: DataFrame, carried: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*carried, text.alias("text"), words_of(text).alias("words"))
    measured = base.select(*carried, *[c.alias(n) for n, c in measurements(F.col("text")).items()])
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total)


def apply_policy(led: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept."""
    hit = lambda names: F.col("failed_bits").bitwiseAND(F.lit(mask_of(names)).cast("bigint")) != 0
    return led.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(POLICIES[version]) & ~hit(BASE))


def keep(docs: DataFrame, version: str = "v2", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, judged row by row without a shuffle; all their columns, as they were."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    led = ledger_of(docs.select(packed, F.col(text).alias("text")), ["row"])
    return apply_policy(led, version).where("kept").select("row.*")


def ablations(led: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of the policy: failures, those that fail no other rule of it, and those kept without it."""
    names = POLICIES[version]
    full = mask_of(names)
    bits = F.col("failed_bits").bitwiseAND(F.lit(full).cast("bigint"))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((bits == 0).cast("bigint")), F.lit(0)).alias("n_kept")]
    for name in names:
        one = mask_of((name,))
        aggs.append(F.coalesce(F.sum((bits.bitwiseAND(F.lit(one).cast("bigint")) != 0).cast("bigint")), F.lit(0)).alias(f"fail_{name}"))
        aggs.append(F.coalesce(F.sum((bits == one).cast("bigint")), F.lit(0)).alias(f"only_{name}"))
    row = led.agg(*aggs)
    return row.select(
        "n_rows",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("rule"),
                        F.col(f"fail_{n}").alias("n_failed"),
                        F.col(f"only_{n}").alias("n_failed_alone"),
                        (F.col("n_kept") + F.col(f"only_{n}")).alias("n_kept_without"),
                    )
                    for n in names
                ]
            )
        ).alias("r"),
    ).select("r.*", "n_rows")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits"
    )


def quality_rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy is worth, from a stored ledger: the texts are read once, whatever is asked of it."""
    return ablations(written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger"))


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (
  select doc_id, i, hash_of from (
    select doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') as hash_of
    from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5))),
d as (select *, count(*) over (partition by doc_id, hash_of) as n from g),
r as (
  select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from d where n > 1) group by doc_id),
m as (
  select w.doc_id, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper
  from w left join r on w.doc_id = r.doc_id),
b as (
  select *, (n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint + 4 * (10 * n_symbols > 3 * n_words)::bigint
    + 8 * (n_lines > 3 and 10 * n_dup_lines > 3 * n_lines)::bigint + 16 * (2 * n_upper > word_chars and word_chars > 40)::bigint
    + 32 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words))::bigint as failed_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, failed_bits = 0 as kept, failed_bits::bigint as failed_bits
from b
"""

ABLATIONS = f"""
with led as ({ORACLE}), r as (select unnest({[x.name for x in RULES]}) as rule, unnest({[1 << i for i in range(len(RULES))]})::bigint as one)
select rule, sum(((failed_bits & one) <> 0)::int)::bigint as n_failed, sum((failed_bits = one)::int)::bigint as n_failed_alone,
  (sum((failed_bits = 0)::int) + sum((failed_bits = one)::int))::bigint as n_kept_without, count(*) as n_rows from led, r group by rule
"""
