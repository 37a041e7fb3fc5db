"""Features of arriving payments from a stored state: the payments of recent weeks, and each pair's first payment.

The state has two tables, each partitioned by the batch that wrote it:

    rows    slim payments (id, timestamp, accounts, amount), partitioned by week, too
    pairs   first payments of pairs (sender, receiver), where a batch saw a new or an earlier one

A batch reads the weeks that its payments lie in and those before them, of its own senders, and the pairs that it has; never
the whole history. A batch that is run again reads the batches before it only and overwrites what it wrote, so it gives the same rows.

As in a full pass, a payment's features count what lies before it in time, in whatever order payments arrive; features that
were given once do not change when an earlier payment arrives later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import features
from tallyfold.session import made, written

ROWS = "id long, timestamp timestamp_ntz, sender_account string, receiver_account string, amount decimal(18,2)"
PAIRS = "sender_account string, receiver_account string, first struct<t:bigint,id:bigint>"
_PAIR = ["sender_account", "receiver_account"]
#: Payments of a batch's week that one task stores, about: a large batch's weeks are as many tasks as they need.
PART = 250_000


class FeatureState:
    def __init__(self, spark: SparkSession, path: str):
        """The state at a path; a new one is empty. Its payments are the table at the path itself."""
        self.spark, self.path, self.pairs_path = spark, path, f"{path.rstrip('/')}-pairs"
        for folder in (path, self.pairs_path):
            made(spark, folder)

    def rows(self, batch: int | None = None) -> DataFrame:
        """Stored payments with batch and week; of the batches before one."""
        stored = self.spark.read.schema(f"{ROWS}, batch long, week long").parquet(self.path)
        return stored if batch is None else stored.where(F.col("batch") < batch)

    def firsts(self, batch: int | None = None) -> DataFrame:
        """The first payment of each pair; of the batches before one."""
        stored = self.spark.read.schema(f"{PAIRS}, batch long").parquet(self.pairs_path)
        stored = stored if batch is None else stored.where(F.col("batch") < batch)
        return stored.groupBy(*_PAIR).agg(F.min("first").alias("first"))

    def _weeks(self, rows: DataFrame) -> list[int]:
        """The weeks that rows lie in: as many numbers as weeks."""
        return [r.week for r in rows.select(_week().alias("week")).distinct().collect() if r.week is not None]

    def fresh(self, new: DataFrame, batch: int) -> DataFrame:
        """The payments of new that are not stored, each id once. A stored copy lies in the same week, so only these are read."""
        stored = self.rows(batch).where(F.col("week").isin(self._weeks(new)))
        return new.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti").select(*new.columns)

    def features(self, new: DataFrame, batch: int, known: DataFrame | None = None) -> DataFrame:
        """new with its features, over the state before the batch and the batch itself. known: what known() gives, if it is there."""
        weeks = {w - back for w in self._weeks(new) for back in (0, 1)}
        near = self.rows(batch).where(F.col("week").isin(sorted(weeks))).drop("batch", "week")
        near = near.join(new.select("sender_account").distinct(), "sender_account", "left_semi")
        both = new.withColumn("_new", F.lit(True)).unionByName(near.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        found = features.with_features(both).where("_new").drop("_new")
        known = (self.known(new, batch) if known is None else known).withColumnRenamed("first", "_first")
        own = F.struct(features.micros().alias("t"), F.col("id").cast("long").alias("id"))
        first = F.col("is_new_receiver") & (F.col("_first").isNull() | (own < F.col("_first")))
        return found.join(known, _PAIR, "left").withColumn("is_new_receiver", first).drop("_first")

    def known(self, new: DataFrame, batch: int) -> DataFrame:
        """The stored first payments of the pairs that new has."""
        pairs = new.select(*_PAIR).distinct()
        stored = self.spark.read.schema(f"{PAIRS}, batch long").parquet(self.pairs_path).where(F.col("batch") < batch)
        return stored.join(pairs, _PAIR, "left_semi").groupBy(*_PAIR).agg(F.min("first").alias("first"))

    def add(self, new: DataFrame, batch: int, known: DataFrame | None = None) -> None:
        """Store a batch's payments and the pairs of which it has the first one. A week's payments are dealt into parts of about PART rows.
        known: what known() gives, if it is there."""
        slim = new.selectExpr("CAST(id AS bigint) AS id", "timestamp", "sender_account", "receiver_account", "CAST(amount AS decimal(18,2)) AS amount").withColumn("week", _week())
        parts = -(-max(1, slim.count()) // PART)
        slim.repartition(min(4 * parts, 1000), "week", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("overwrite").partitionBy("week").parquet(f"{self.path}/batch={batch}")
        own = slim.groupBy(*_PAIR).agg(F.min(F.struct(features.micros().alias("t"), "id")).alias("first"))
        earlier = (self.known(new, batch) if known is None else known).withColumnRenamed("first", "_first")
        kept = own.join(earlier, _PAIR, "left").where("_first IS NULL OR first < _first").drop("_first")
        kept.write.mode("overwrite").parquet(f"{self.pairs_path}/batch={batch}")

    def advance(self, new: DataFrame, batch: int) -> DataFrame:
        """Take a batch in: its payments that were not stored yet, with their features (written once)."""
        fresh = written(self.fresh(new, batch), "fresh")
        known = written(self.known(fresh, batch), "known")
        found = written(self.features(fresh, batch, known), "increment")
        self.add(fresh, batch, known)
        return found


def _week():
    return F.floor(features.micros() / F.lit(features.BLOCK)).cast("long")
