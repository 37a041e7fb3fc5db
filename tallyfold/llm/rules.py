"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long of failure bits;
policies are versioned masks over those bits, so a new policy or an ablation never reads a text again.

Words are runs of characters other than the six ASCII white-space characters.

Edge cases: a null text has the measurements of an empty one; the ledger has one row per input row, so repeated
rows and null ids stay; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import WHITE, WORDS

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rule name and failure condition; the place in this list is the bit. New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    ("shouting", "n_upper > 2 * n_lower AND n_upper > 20"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that count.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_passages"],
    "v1": sum(BIT.values()),
}


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            reach = 0  # the end of what is counted so far
            for at, window in enumerate(windows):
                if seen[window] > 1:
                    repeated += at + WINDOW - max(at, reach)
                    reach = at + WINDOW
    return (
        n,
        sum(map(len, words)),
        int(sum(byte[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(byte[65:91].sum()),
        int(byte[97:123].sum()),
    )


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits for every row of docs (doc_id, text)."""
    measured = docs.select("doc_id", _measures("text").alias("_m")).select("doc_id", *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    bits: Column = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def passes(mask: int) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a versioned policy; what fails the base is never kept."""
    return book.withColumn("base_failed", ~passes(POLICIES["base"])).withColumn("kept", passes(POLICIES[policy] | POLICIES["base"]))


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, fail nothing else, and would be kept without it."""
    mask = POLICIES[policy]
    groups = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask])
    each = groups.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    clean = F.col("bits") == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(failed).alias("n_failed"), total(alone).alias("n_only"), total(clean | alone).alias("n_kept_without"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words,
             list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM n, unnest(generate_series(1, n_words - 7)) AS s(i) WHERE n_words > 8),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS r FROM rep, range(8) AS z(o) GROUP BY doc_id),
m AS (SELECT n.doc_id, n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
             (length(t) - length(regexp_replace(t, '[a-z]', '', 'g')))::BIGINT AS n_lower
      FROM n LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END
             + CASE WHEN n_upper > 2 * n_lower AND n_upper > 20 THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM f
"""


def quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    done = apply_policy(ledger(docs), policy)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept")
