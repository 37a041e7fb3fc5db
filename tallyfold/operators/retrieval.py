"""Nearest documents by cosine similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.session import shared_path, written

#: Rows of documents whose similarities to a block of queries a task holds at once.
CHUNK = 1024


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(queries: DataFrame, docs: DataFrame, k: int = 5, most_queries: int = 10_000) -> DataFrame:
    """query_id, doc_id, rank, similarity of the k nearest docs (doc_id, embedding) of each of the queries (query_id, q).

    Of equal embeddings only the k smallest ids can be among the nearest; the others are left out first. Documents and queries of the
    usual length that have a direction meet as matrices: tasks hold a block of queries and some rows of documents, and keep
    each query's k best so far. What is null, zero, not finite or of another length meets the rest by a plain join, distinct
    queries only. Queries are dealt by hash into blocks of about four fifths of `most_queries`, if there are more, so any number is
    answered. A first top k is taken within hash shards of the documents, so that no query's whole list meets in one task.
    """
    spark, n = docs.sparkSession, queries.count()
    if not n:
        return _compared(queries, docs, k)
    width = queries.groupBy(F.size("q").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first().w
    plain = lambda v: F.coalesce((F.size(v) == width) & (F.abs(F.sqrt(_dot(v, v))) > 0) & (F.sqrt(_dot(v, v)) < float("inf")), F.lit(False))
    same = Window.partitionBy("embedding").orderBy("doc_id")
    few = docs.select("doc_id", "embedding").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = written(few.withColumn("_plain", plain("embedding")).repartition(tasks), "distinct")
    usual, odd = few.where("_plain").drop("_plain"), few.where("NOT _plain").drop("_plain")
    queries = written(queries.select("query_id", "q").withColumn("_plain", plain("q")), "asked")
    asked, rest = queries.where("_plain").drop("_plain"), queries.where("NOT _plain").drop("_plain")
    found = _in_blocks(asked, usual, k, most_queries, _multiplied)
    if not odd.isEmpty():
        found = found.unionByName(_in_blocks(asked, odd, k, most_queries, _pairs))
    if not rest.isEmpty():
        one = written(rest.groupBy("q").agg(F.min("query_id").alias("query_id")), "asked")
        theirs = _in_blocks(one, few.drop("_plain"), k, most_queries, _pairs).withColumnRenamed("query_id", "_one")
        named = one.select(F.col("query_id").alias("_one"), F.col("q").alias("_q"))
        each = rest.join(named, F.col("q").eqNullSafe(F.col("_q"))).select("query_id", "_one")
        found = found.unionByName(each.join(theirs, "_one").select("query_id", "doc_id", "similarity"))
    return nearest(found, k)


def _in_blocks(queries: DataFrame, docs: DataFrame, k: int, most: int, how: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """query_id, doc_id, similarity: what `how` finds for each block of at most about `most` queries; several are written in turn."""
    n = queries.count()
    if n <= most:
        return how(queries, docs, k)
    spark = docs.sparkSession
    path, blocks = shared_path(spark, "topk"), -(-5 * n // (4 * most))
    place = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for b in range(blocks):
        how(queries.where(place == b), docs, k).write.mode("append").parquet(path)
    return spark.read.schema(how(queries.limit(0), docs, k).schema).parquet(path)


def _pairs(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k nearest documents of each query by a join of all with all, without their ranks."""
    unit = docs.withColumn("_n", F.sqrt(_dot("embedding", "embedding")))
    asked = F.broadcast(queries.withColumn("_m", F.sqrt(_dot("q", "q"))))
    both = unit.crossJoin(asked).select("query_id", "doc_id", (_dot("embedding", "q") / F.nullif(F.col("_n") * F.col("_m"), F.lit(0.0))).alias("similarity"))
    return _best(both, k).select("query_id", "doc_id", "similarity")


def _compared(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return nearest(_pairs(queries, docs, k), k)


def _multiplied(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """As _pairs, for queries and documents of one length with a direction: each task's k nearest of each query."""
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *docs.schema)}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, similarity double"
    asked = queries.toPandas()
    if asked.empty:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.mapInPandas(_nearest_of(np.array(asked["q"].tolist(), float), asked["query_id"], k), schema)


def _sum_of_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added in the order of the places as _dot does, so that equal vectors tie and digits are those of a plain loop."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _nearest_of(q: np.ndarray, ids: pd.Series, k: int) -> Callable:
    def nearest_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.sqrt(_sum_of_products(q, q))
        unit = (q / m[:, None]).astype(np.float32)
        near = (q.shape[1] + 8) * 2.5e-7  # beyond the error of single precision, on both sides
        best = None  # rows (q, doc_id, similarity), k for each query
        bound = np.full(len(q), -np.inf, np.float32)
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                rows = batch[start : start + CHUNK]
                e = np.array(rows["embedding"].tolist(), float)
                n = np.sqrt(_sum_of_products(e, e))
                about = (e / n[:, None]).astype(np.float32) @ unit.T
                floor = bound
                if len(rows) > k and not np.isfinite(bound).all():
                    floor = np.maximum(bound, np.partition(about, len(rows) - k, axis=0)[len(rows) - k] - near)
                d, at = np.nonzero(about >= floor)
                exact = _sum_of_products(e[d], q[at]) / (n[d] * m[at])
                new = pd.DataFrame({"q": at, "doc_id": rows["doc_id"].to_numpy()[d], "similarity": exact})
                both = new if best is None else pd.concat([best, new])
                both = both.sort_values(["q", "similarity", "doc_id"], ascending=[True, False, True])
                best = both[both.groupby("q").cumcount() < k]
                full = best.groupby("q")["similarity"].agg(["size", "min"])
                full = full[full["size"] == k]
                bound[full.index] = full["min"] - near
        if best is not None:
            yield pd.DataFrame({"query_id": ids.to_numpy()[best["q"]], "doc_id": best["doc_id"], "similarity": best["similarity"]})

    return nearest_of


def _order() -> list[Column]:
    return [F.desc_nulls_last("similarity"), F.col("doc_id")]


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k rows of the highest similarity within each shard of documents."""
    local = Window.partitionBy("query_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*_order())
    return found.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank, similarity of each query's k rows of the highest similarity, first within shards of documents."""
    final = _best(found, k).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))).where(F.col("rank") <= k)
    return final.select("query_id", "doc_id", "rank", F.round("similarity", 5).alias("similarity"))
