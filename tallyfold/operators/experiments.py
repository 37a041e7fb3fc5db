"""Experiment rows, run parameters and metric snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.evaluate import auc, counts, metrics


def experiment(split: DataFrame, alerts: DataFrame, scored: DataFrame, config: str, parameters: Column) -> DataFrame:
    """One configuration's result row: confusion metrics and areas over the test rows, and the run's parameters.

    No alert of the configuration gives a row with 0 alerts. scored: score, is_fraud of the test rows.
    """
    test = split.where("NOT is_training_set").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_fraud").alias("fraud"))
    hits = counts(split, alerts.where(F.col("detection_config") == config)).select("alerts", "tp")
    zero = F.lit(0).cast("long")
    one = test.join(hits, F.lit(True), "left").select(F.lit(config).alias("detection_config"), "total", "fraud", F.coalesce("alerts", zero).alias("alerts"), F.coalesce("tp", zero).alias("tp"))
    return metrics(one).crossJoin(F.broadcast(auc(scored))).withColumn("run_parameters", parameters)  # one row each


def benchmark(split: DataFrame, alerts: DataFrame, scored: DataFrame) -> DataFrame:
    """Every configuration and fold in one plan: metrics, and the fold's areas. scored: score, is_fraud, fold."""
    return metrics(counts(split, alerts, by_fold=True)).join(F.broadcast(auc(scored, ("fold",))), "fold")  # as many rows as folds


def parameters(thresholds: DataFrame, split: DataFrame, ratio: float, folds: int, cutoff: float) -> DataFrame:
    """One row: settings, thresholds and table sizes of a run, as JSON."""
    limits = thresholds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_name", F.col("current_value").cast("double").alias("v"))))).alias("thresholds"))
    sizes = split.agg(F.count(F.lit(1)).alias("transactions"), F.count_if("is_fraud").alias("fraud"), F.count_if("is_training_set").alias("training"))
    both = sizes.crossJoin(F.broadcast(limits)).withColumns({"ratio": F.lit(ratio), "folds": F.lit(folds), "cutoff": F.lit(cutoff)})
    return both.select("transactions", "fraud", "training", F.to_json(F.struct("cutoff", "folds", "fraud", "ratio", "thresholds", "training", "transactions")).alias("run_parameters"))


def latest_snapshot(history: DataFrame, live: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """The newest snapshot if it is at most `seconds` old, else the live counts. live: one row with history's columns."""
    fresh = history.where(F.col("snapshot_at") >= now - F.make_dt_interval(secs=F.lit(seconds))).orderBy(F.desc("snapshot_at")).limit(1)
    return fresh.withColumn("_r", F.lit(0)).unionByName(live.withColumn("_r", F.lit(1))).orderBy("_r").limit(1).drop("_r")


def snapshot_history(history: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Snapshots of the last 1 to 10,080 minutes (others are moved to that range), oldest first."""
    minutes = min(10_080, max(1, minutes))
    return history.where(F.col("snapshot_at") >= now - F.make_dt_interval(mins=F.lit(minutes))).orderBy("snapshot_at")
