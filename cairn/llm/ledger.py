"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; its failures become bits of one
integer, beside the measurements they rest on. Policies are named masks over
those bits, so that a new policy, or the question what a rule costs, reads the
ledger alone and never the texts again.

Words are runs of characters other than space and U+0009 to U+000D. Null texts
count as empty: they have no word, so they fail ``few_words``. Whole texts are
measured. Repeated rows each have their own ledger row. Of the kept columns, one
that has the name of a measurement or is named fail_bits gives way to it; other
columns are neither read nor changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import with_columns

SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")
#: A document fails a rule where its condition holds. The place in this dict is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": "100 * n_upper_words > 60 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that a kept document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(RULES),
}


def mask_of(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly the characters of SPACE
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        again = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                again[j : j + 3] = again[i : i + 3] = b"\1\1\1"
        repeated = sum(again)
    upper = sum(map(bytes.isupper, words)) if raw.isascii() else sum(w.decode("utf-8", "surrogatepass").isupper() for w in words)
    return n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper


def ledger(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with the measurements and ``fail_bits``."""

    def make():
        def step(texts):
            got = [measure(t) for t in texts]
            return {name: [g[i] for g in got] for i, name in enumerate(MEASURES)}

        return step

    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(0) for name, rule in RULES.items()]
    kept = [c for c in keep if c.lower() != "fail_bits"]
    return with_columns(docs, kept, "text", make, ", ".join(f"{m} bigint" for m in MEASURES)).withColumn("fail_bits", reduce(Column.bitwiseOR, bits))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: documents that fail it, that fail it alone
    (and so would return without it), and the rules that every one of its failures also fails.

    One aggregation with partial sums, of a row for each rule.
    """
    mask = mask_of(policy)
    sums = []
    for r in POLICIES[policy]:
        fails = F.col("fail_bits").bitwiseAND(F.lit(BITS[r])) != 0
        alone = F.col("fail_bits").bitwiseAND(F.lit(mask)) == BITS[r]
        sums += [F.count_if(fails).alias(f"{r}_failed"), F.count_if(alone).alias(f"{r}_alone"), F.bit_and(F.when(fails, F.col("fail_bits"))).alias(f"{r}_always")]
    one = rows.agg(*sums)
    each = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("failed"), F.col(f"{r}_alone").alias("failed_alone"), F.coalesce(f"{r}_always", F.lit(0)).alias("fails_with_bits")) for r in POLICIES[policy]])
    return one.select(F.inline(each))


#: The query's columns for DuckDB.
SQL = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT doc_id, three FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows JOIN again USING (doc_id, three)) GROUP BY 1),
m AS (SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
(len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '[\p{{Ll}}\p{{Lt}}]')))::BIGINT AS n_upper_words FROM words LEFT JOIN covered USING (doc_id)),
bits AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & {mask_of("base")} <> 0 AS base_failed, bits & {mask_of("v2")} = 0 AS kept, n_lines, n_upper_words, bits::INTEGER AS fail_bits FROM bits"""
