"""What the corpus operators share: word rules, tables in the shared folder, connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import removed, shared_path, written

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def subfolder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new folder inside the given one, or else in the application's shared folder."""
    return f"{folder}/{name}-{uuid.uuid4().hex}" if folder else shared_path(spark, name)


def components(edges: DataFrame, most_rounds: int = 60, inside: str | None = None) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps. Each step is a grouped minimum (combined before its shuffle)
    and a join whose two sides are plain scans, so that adaptive execution can split a hub's rows. A round's tables are
    deleted when the next round is written; the last one's, which the result reads, lie inside the given folder. Nulls and self-loops are ignored; nodes without an edge have no row. The rounds
    needed grow with the logarithm of the longest path; after most_rounds, more than any path that fits a cluster needs, it
    is an error.
    """
    spark = edges.sparkSession
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    folder = subfolder(spark, "components", inside)
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", folder)
    mark = _mark(now)
    for _ in range(most_rounds):
        last, folder = folder, subfolder(spark, "components", inside)
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", folder)
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large", folder)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least", folder)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links", folder)
        removed(spark, last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """A row count and an order-free checksum: two numbers reach the driver, whatever the size."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first())
