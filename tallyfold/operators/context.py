"""Patterns that fit an alert: one search for each distinct question, its result joined back to all alerts that ask it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.explain import KNOWN_PATTERN, retrieval_query
from tallyfold.operators.retrieval import vector_topk
from tallyfold.session import written

#: Length of the vectors that `embedded` makes.
WIDTH = 64
#: Rows of the small side up to which a join back is a broadcast; beyond, the large side's rows are dealt into parts.
MOST_BROADCAST, PARTS = 10_000, 32


def embedded(text: Column) -> Column:
    """A vector of word counts, each word at a place that its hash gives. Stands in for a language model's embedding; a text
    without a word is a zero vector."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % WIDTH)
    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


def joined_back(rows: DataFrame, found: DataFrame, key: str, id_: str = "id", most: int = MOST_BROADCAST, parts: int = PARTS) -> DataFrame:
    """rows with the columns of found (one row for each key), a key of which may be that of half of all rows.

    found is counted first. Up to `most` rows it is broadcast; a larger one is repeated for each of `parts` parts, into which the rows of
    every key are dealt by a hash of their id, so that no key meets in one task.
    """
    found = written(found, "found")
    if found.count() <= most:
        return rows.join(F.broadcast(found), key, "left")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int"))
    spread = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(spread, [key, "_part"], "left").drop("_part")


def contexts(questions: DataFrame, patterns: DataFrame, k: int = 5) -> DataFrame:
    """query_text, context: for each of the distinct questions (query_text) the k nearest patterns (text), the nearest first."""
    asked = questions.select(F.col("query_text").alias("query_id"), embedded(F.col("query_text")).alias("q"))
    known = patterns.select(F.col("text").alias("doc_id"), embedded(F.col("text")).alias("embedding"))
    hits = vector_topk(asked, known, k).where("similarity IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))  # k patterns at most
    told = hits.groupBy(F.col("query_id").alias("query_text")).agg(listed.alias("_l"))
    return told.select("query_text", F.array_join(F.transform("_l", lambda p: F.concat(F.lit(f"\n{KNOWN_PATTERN}"), p["rank"].cast("string"), F.lit("\n"), p["doc_id"])), "\n").alias("context"))


def with_context(alerts: DataFrame, patterns: DataFrame, k: int = 5) -> DataFrame:
    """alerts (with the columns id, rule_triggered, transaction_type) with context: the text of the nearest patterns, or null.

    The question depends on the names of the rules and the kind of payment only, so there are as many searches as such pairs,
    however many alerts there are.
    """
    named = retrieval_query(alerts, *[c for c in alerts.columns if c != "id"])
    return joined_back(named, contexts(named.select("query_text").distinct(), patterns, k), "query_text").drop("query_text")
