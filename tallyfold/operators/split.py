"""Temporal and stratified splits, folds and reproducible samples."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.features import micros
from tallyfold.operators.ranking import first_by_hash, hash_of_id, running


def cutoff(tx: DataFrame, ratio: float = 0.8, most: int = 1_000_000, bins: int = 4096) -> int | None:
    """The discrete percentile of time in microseconds, exact: the range that holds it is narrowed by counts in equal bins until
    it has at most `most` rows (or a single time), which are sorted. So no task and not the driver ever meets more."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    times = tx.select(micros().alias("t")).where("t IS NOT NULL")
    n, lo, hi = times.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    if not n:
        return None
    rank = math.ceil(Decimal(str(ratio)) * n)
    while n > most and lo < hi:
        width = (hi - lo) // bins + 1
        counts = times.where(F.col("t").between(lo, hi)).groupBy(F.expr(f"(t - {lo}L) div {width}L").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for bin_, n in sorted(counts.collect()):
            if rank <= n:
                lo, hi = lo + bin_ * width, min(hi, lo + (bin_ + 1) * width - 1)
                break
            rank -= n
    if lo == hi:
        return lo
    return times.where(F.col("t").between(lo, hi)).agg(F.element_at(F.array_sort(F.collect_list("t")), rank)).first()[0]


def temporal_split(tx: DataFrame, ratio: float = 0.8) -> DataFrame:
    """tx with is_training_set: before the discrete percentile of time, or not. The cut-off is a literal in the plan."""
    return tx.withColumn("is_training_set", micros() < F.lit(cutoff(tx, ratio)).cast("long"))


def split_summary(split: DataFrame, ratio: float = 0.8) -> DataFrame:
    test = ~F.col("is_training_set")
    return split.agg(
        F.min(F.when(test, F.col("timestamp"))).alias("cutoff"), F.count(F.lit(1)).alias("total"), F.count_if(~test).alias("train"), F.count_if(test).alias("test"), F.lit(ratio).alias("ratio")
    )


def stratified_split(tx: DataFrame) -> DataFrame:
    """Every fifth row of each label by id is test."""
    ranked = running(tx, [F.col("id")], {"_rank": F.lit(1)}, ("is_fraud",))
    return ranked.withColumn("is_training_set", F.col("_rank") % 5 != 0).drop("_rank")


def _hash32(column: str) -> str:
    return f"CAST(conv(substr(md5(CAST({column} AS STRING)), 1, 8), 16, 10) AS BIGINT)"


def assign_folds(split: DataFrame, k: int = 5) -> DataFrame:
    """Test rows fall in k folds by a hash of their id; training rows have none."""
    if k < 2:
        raise ValueError("at least two folds")
    return split.withColumn("fold", F.when(~F.col("is_training_set"), F.expr(f"CAST({_hash32('id')} % {k} AS INT)")))


def training_sample(split: DataFrame, max_legit: int = 200_000) -> DataFrame:
    train = split.where("is_training_set")
    return train.where("is_fraud").unionByName(first_by_hash(train.where("NOT is_fraud"), max_legit))


def auc_sample(split: DataFrame, n_legit: int, by_fold: bool = False) -> DataFrame:
    test = split.where("NOT is_training_set")
    fraud, legit = test.where("is_fraud"), test.where("NOT is_fraud")
    if not by_fold:
        return fraud.unionByName(first_by_hash(legit, n_legit))
    by = Window.partitionBy("fold").orderBy(hash_of_id(), "id")
    return fraud.unionByName(legit.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n_legit).drop("_r"))
