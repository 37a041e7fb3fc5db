"""Packing by optimal length buckets.

Texts are cut into segments of at most max_tokens words. Dynamic programming over the global histogram of
segment lengths chooses the bucket boundaries that make the padded total smallest; inside each bucket, segments
in doc_id order form batches of token_budget padded tokens.

The histogram has at most max_tokens rows, so it is small on the driver whatever the input. Ranks inside a bucket
come from counts of blocks of neighbouring ids, so no task ever holds a bucket.

Edge cases: a text without a word (null, empty, white space) has one segment of no tokens in bucket 0 and no batch;
repeated rows and null ids (ranked first) are segments of their own, rows that tie on id and segment ranked by
length; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.blocks import id_blocks
from tallyfold.llm.common import WORD, written

MAX_TOKENS = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most `buckets` upper bounds with the smallest padded total; the fewest, then the lowest earlier bounds, on ties."""
    length = np.array(sorted(histogram), np.int64)
    if not len(length):
        return []
    upto = np.cumsum([histogram[int(x)] for x in length])
    cost, back = upto * length, []
    best = (int(cost[-1]), 1)
    for k in range(2, min(buckets, len(length)) + 1):
        new, came = np.full(len(length), np.iinfo(np.int64).max), np.zeros(len(length), np.int64)
        for j in range(k - 1, len(length)):
            options = cost[k - 2 : j] + (upto[j] - upto[k - 2 : j]) * length[j]
            at = int(options.argmin())
            new[j], came[j] = options[at], at + k - 2
        back.append(came)
        cost = new
        best = min(best, (int(cost[-1]), k))
    out, j = [], len(length) - 1
    for k in range(best[1], 0, -1):
        out.append(int(length[j]))
        if k > 1:
            j = int(back[k - 2][j])
    return out[::-1]


def segments(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, segment (from 0), n_tokens: whole texts in pieces of max_tokens words and a rest."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("words")
    count = F.greatest(F.lit(1), F.ceil(F.col("words") / max_tokens)).cast("int")
    cut = docs.select("doc_id", words).select("doc_id", "words", F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    return cut.select("doc_id", "segment", F.least(F.lit(max_tokens), F.col("words") - F.col("segment") * max_tokens).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, rows_per_block: int = 4000) -> DataFrame:
    """doc_id, segment, n_tokens, bucket (padded length), padding, batch (from 0 in its bucket, null in bucket 0), place (in the batch)."""
    own = written(segments(docs, max_tokens).withColumn("block", id_blocks(docs, rows_per_block)), "segments")
    counts = own.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    bounds = boundaries({r.n_tokens: r.n for r in counts.collect()}, buckets)
    bucket = F.lit(0).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    placed = own.withColumn("bucket", F.when(F.col("n_tokens") == 0, F.lit(0).cast("long")).otherwise(bucket))
    sizes = placed.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select("bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy("bucket", "block").orderBy(F.col("doc_id").asc_nulls_first(), "segment", "n_tokens")
    ranked = placed.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["bucket", "block"]).withColumn("rank", F.col("start") + F.col("r"))
    holds = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket"), F.lit(1))).cast("long"))
    real = F.col("bucket") > 0
    return ranked.select(
        "doc_id",
        "segment",
        "n_tokens",
        "bucket",
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
        F.when(real, F.floor(F.col("rank") / holds).cast("long")).alias("batch"),
        F.when(real, F.col("rank") % holds).alias("place"),
    )


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM documents),
s AS (SELECT doc_id, g::INT AS segment, least({MAX_TOKENS}, words - g * {MAX_TOKENS})::BIGINT AS n_tokens
      FROM d, unnest(generate_series(0, greatest(1, (words + {MAX_TOKENS - 1}) // {MAX_TOKENS}) - 1)) AS x(g)),
h0 AS (SELECT n_tokens AS len, count(*)::BIGINT AS n FROM s WHERE n_tokens > 0 GROUP BY 1),
h AS MATERIALIZED (SELECT len, row_number() OVER (ORDER BY len) AS j, sum(n) OVER (ORDER BY len)::BIGINT AS upto FROM h0),
dp AS (SELECT 1 AS k, j, upto * len AS cost, [len] AS path, upto FROM h
       UNION ALL
       SELECT dp.k + 1, h.j, min(dp.cost + (h.upto - dp.upto) * h.len)::BIGINT,
              list_append(arg_min(dp.path, (dp.cost + (h.upto - dp.upto) * h.len)::HUGEINT * 1000000 + dp.j), any_value(h.len)), any_value(h.upto)
       FROM dp JOIN h ON h.j > dp.j WHERE dp.k < {BUCKETS} AND dp.j >= dp.k GROUP BY dp.k, h.j),
best AS (SELECT path FROM dp WHERE j = (SELECT max(j) FROM h) ORDER BY cost, k LIMIT 1),
p AS (SELECT *, CASE WHEN n_tokens = 0 THEN 0 ELSE (SELECT min(b) FROM (SELECT unnest(path) AS b FROM best) WHERE b >= n_tokens) END::BIGINT AS bucket FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, segment, n_tokens) - 1 AS rank,
             greatest(1, {TOKEN_BUDGET} // greatest(bucket, 1)) AS holds FROM p)
SELECT doc_id, segment, n_tokens, bucket, bucket - n_tokens AS padding,
       CASE WHEN bucket > 0 THEN rank // holds END AS batch, CASE WHEN bucket > 0 THEN rank % holds END AS place FROM r
"""
