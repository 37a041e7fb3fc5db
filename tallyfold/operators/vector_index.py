"""An inverted index over vectors: centroids, a stored list of vectors for each, searches that read the nearest lists only.

Vectors without a direction (null, empty or zero) have no similarity: they are stored in no list and never found, and queries
like that have no rows. All vectors of an index have one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.retrieval import nearest
from tallyfold.session import shared_path, written

#: About so many vectors, taken by a hash of their id, fit the centroids; every vector is indexed.
SAMPLE = 65_536
#: At most so many lists; so the centroids, and counts by list, fit the driver and every task.
MOST_LISTS = 16_384
#: Vectors of one list that one task writes; longer lists are dealt into parts.
PART = 100_000
#: Queries that are answered at once; more are answered in blocks.
MOST_QUERIES = 10_000
_FOUND = "query_id long, doc_id long, similarity double"


@dataclass(frozen=True)
class VectorIndex:
    """Where the lists are stored, the centroids (unit vectors), and for each list the least similarity to its centroid of the
    vectors that have no nearer one (nan if there are none)."""

    path: str
    centroids: np.ndarray
    least: np.ndarray


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which of the vectors have a direction; the others are zero."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    whole = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            whole[i] = np.asarray(v, float)
    norm = np.sqrt(np.einsum("ij,ij->i", whole, whole))
    good = np.isfinite(norm) & (norm > 0)
    whole[good] /= norm[good, None]
    whole[~good] = 0
    return whole, good


def fit_centroids(docs: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of at most `lists` clusters of about `sample` of docs (doc_id, embedding)."""
    n = docs.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = docs.where(share & (length > 0)).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    if rows.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=max(2, min(lists, MOST_LISTS)), distanceMeasure="cosine", seed=42, maxIter=15).fit(rows)
    return _units(pd.Series(list(model.clusterCenters())))[0]


def _assigner(centroids: np.ndarray, copies: int) -> Callable:
    """rows (doc_id, embedding) once for each of their nearest lists, with list, copy (0: the nearest) and cosine, the similarity to its
    centroid."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units, good = _units(batch["embedding"])
            if not good.any():
                continue
            near = units[good] @ centroids.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :copies]
            for copy, lists in enumerate(best.T):
                yield batch[good].assign(list=lists.astype(np.int32), copy=np.int32(copy), cosine=near[np.arange(len(lists)), lists])

    return assign


def build(docs: DataFrame, path: str | None = None, lists: int | None = None, copies: int = 2, centroids: np.ndarray | None = None) -> VectorIndex:
    """Index docs (doc_id, embedding) at a path. lists: by default the square root of the rows, at most MOST_LISTS. Given centroids
    (unit vectors) are taken as they are. Vectors are stored in their `copies` nearest lists, as neighbours often lie on two sides of
    a border.

    Every list is a partition of the stored table, dealt by a hash of doc_id into parts of about PART vectors, so that a list with
    a third of all vectors is written and read by many tasks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    if centroids is None:
        centroids = fit_centroids(docs, lists or max(2, round(docs.count() ** 0.5)))
    path = path or shared_path(spark, "vector-index")
    dealt = written(docs.mapInPandas(_assigner(centroids, copies), "doc_id long, embedding array<float>, list int, copy int, cosine double"), "assigned")
    sizes = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("copy") == 0, F.col("cosine"))).alias("least"))  # at most MOST_LISTS rows
    parts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / PART).alias("parts")))
    rows = dealt.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    rows.select("doc_id", "embedding", "list", "part").repartition("list", "part").drop("part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    known = {r.list: (r.n, r.least) for r in sizes.collect()}
    told = [(k, centroids[k].tolist(), *known.get(k, (0, None))) for k in range(len(centroids))]
    spark.createDataFrame(told, "list int, center array<double>, n long, least double").write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.list)
    return VectorIndex(path, np.array([r.center for r in rows]), np.array([np.nan if r.least is None else r.least for r in rows]))


def lists_of(spark: SparkSession, index: VectorIndex, lists: np.ndarray) -> DataFrame:
    """The stored vectors of some lists; the others' files are not read."""
    rows = spark.read.schema("doc_id long, embedding array<float>, list int").parquet(f"{index.path}/lists")
    return rows.where(F.col("list").isin([int(x) for x in lists]))


def _compare(asked: dict[int, np.ndarray], ids: np.ndarray, units: np.ndarray, k: int) -> Callable:
    """The k nearest of each batch and list of stored vectors, for each query that asks for the list (list -> places of queries)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, rows in batch.groupby("list", sort=False):
                at = asked.get(int(number))
                if at is None:
                    continue
                rows = rows.sort_values("doc_id")
                own, doc_ids, out = _units(rows["embedding"])[0], rows["doc_id"].to_numpy(), []
                near = own @ units[at].T
                for j, q in enumerate(at.tolist()):
                    column = near[:, j]
                    few = np.flatnonzero(column >= np.partition(column, -k)[-k] - 1e-9) if len(column) > k else np.arange(len(column))
                    exact = np.einsum("ij,j->i", own[few], units[q])  # row by row alike, so that copies tie
                    best = np.lexsort((doc_ids[few], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": ids[q], "doc_id": doc_ids[few[best]], "similarity": exact[best]}))
                yield pd.concat(out)

    return compare


def _probed(index: VectorIndex, units: np.ndarray, probes: int) -> list[np.ndarray]:
    """The nearest lists of each query, of those that are some vector's nearest."""
    full = np.flatnonzero(~np.isnan(index.least))
    found = []
    for start in range(0, len(units), 256):
        near = units[start : start + 256] @ index.centroids[full].T
        found += [full[np.argsort(-row, kind="stable")[:probes]] for row in near]
    return found


def _reaching(index: VectorIndex, units: np.ndarray, bound: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
    """Lists not yet seen that may hold a vector of at least a query's bound: no angle to a member is smaller than that to the
    centroid less the list's widest."""
    widest = np.arccos(np.clip(index.least, -1, 1))
    rest = []
    for q, before in enumerate(seen):
        angle = np.arccos(np.clip(index.centroids @ units[q], -1, 1))
        may = np.cos(np.maximum(0, angle - widest)) >= bound[q] - 1e-6
        may[before] = False
        rest.append(np.flatnonzero(may & ~np.isnan(index.least)))
    return rest


def _turned(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each list the places of the queries that ask for it."""
    pairs = np.array([(n, q) for q, row in enumerate(lists) for n in row.tolist()], int).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    return {int(part[0, 0]): part[:, 1] for part in np.split(pairs, cuts) if len(part)}


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int = 20, exact: bool = False) -> DataFrame:
    """query_id, doc_id, rank, similarity: the k nearest stored vectors of each of the queries (query_id, q) in its `probes` nearest
    lists. exact: lists that could still hold a nearer one than the k-th found are read, too, so the result is that of a
    comparison with every vector.

    Queries are answered in blocks of at most MOST_QUERIES, dealt by hash; a block's vectors are what tasks and driver hold.
    """
    spark = queries.sparkSession
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    blocks = max(1, -(-5 * queries.count() // (4 * MOST_QUERIES)))
    path = shared_path(spark, "index-search")
    schema = "query_id long, doc_id long, rank int, similarity double"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(0 if np.isnan(index.least).all() else blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        units, good = _units(asked["q"])
        units, ids = units[good], asked["query_id"].to_numpy()[good]
        if not len(ids):
            continue
        seen = _probed(index, units, probes)
        found = _candidates(spark, index, seen, ids, units, k)
        if exact:
            found = written(found, "found")
            kth = {r.query_id: r.similarity for r in nearest(found, k).where(F.col("rank") == k).collect()}
            rest = _reaching(index, units, np.array([kth.get(i, -1.0) - 1e-5 for i in ids.tolist()]), seen)  # similarities are rounded
            if any(map(len, rest)):
                found = found.unionByName(_candidates(spark, index, rest, ids, units, k)).dropDuplicates(["query_id", "doc_id"])
        nearest(found, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _candidates(spark: SparkSession, index: VectorIndex, lists: list[np.ndarray], ids: np.ndarray, units: np.ndarray, k: int) -> DataFrame:
    turned = _turned(lists)
    found = lists_of(spark, index, np.array(sorted(turned))).mapInPandas(_compare(turned, ids, units, k), _FOUND)
    return found.dropDuplicates(["query_id", "doc_id"])  # a vector may be found in two lists
