"""The canonical tables, derived from a driver folder; those that others are made of are written once for each query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import detect, evaluate, features, rules, split
from tallyfold.session import written

#: Thresholds of the driver queries.
THRESHOLDS = {"LARGE_TRANSACTION": 200_000, "NEW_RECEIVER_HIGH_VALUE": 50_000, "RAPID_VELOCITY": 2, "STRUCTURING": 10_000}
METRICS = ("precision", "recall", "f1", "fpr", "auc_roc", "auc_pr", "quality", "hallucination_rate")
FOLDS = 5
#: A deterministic stand-in for a model's score, in hundredths.
POINTS = "CASE WHEN amount >= 50000 THEN 35 ELSE 0 END + CASE WHEN is_new_receiver THEN 20 ELSE 0 END + 5 * least(tx_velocity_24h, 5) + id % 20"


def _with_scores(rows: DataFrame) -> DataFrame:
    share = lambda n: (n / 100.0).cast("double")
    rows = rows.withColumn("_n", F.expr(POINTS))
    return rows.withColumns({"risk_score": share(F.col("_n")), "rf_score": share(F.col("_n")), "gbt_score": share(F.col("_n") + F.col("id") % 3 - 1)}).drop("_n")


class Canonical:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tx0(self) -> DataFrame:
        customer = self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("sender_balance_before"))
        kind = F.when(F.col("event_type") == "purchase", "PAYMENT").when(F.col("event_type") == "click", "TRANSFER").when(F.col("event_type") == "view", "CASH_OUT")
        fraud = ((F.col("value") >= 200) & (F.col("event_id") % 3 == 0)) | (F.col("event_id") % 211 == 0)
        return self.raw("events").join(customer, "user_id", "left").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("sender_account"),
            F.concat(F.lit("M"), F.get_json_object("props", "$.k")).alias("receiver_account"),
            kind.when(F.col("event_type") == "signup", "CASH_IN").otherwise("DEBIT").alias("transaction_type"),
            (F.col("value").cast("decimal(18,2)") * 1000).cast("decimal(18,2)").alias("amount"),
            "sender_balance_before",
            fraud.alias("is_fraud"),
            F.when(F.col("event_id") % 10 == 0, "CUSTOM").otherwise("PAYSIM").alias("dataset_source"),
        )

    @cached_property
    def tx(self) -> DataFrame:
        return split.assign_folds(split.temporal_split(self.tx0), FOLDS)

    @cached_property
    def fresh(self) -> DataFrame:
        """Payments with split, fold and features, not written: for queries that pass over them once."""
        return features.with_features(self.tx)

    @cached_property
    def base(self) -> DataFrame:
        """Payments with split, fold, all features and scores, written once. A query that needs them takes this table first."""
        return written(_with_scores(self.fresh), "base")

    @cached_property
    def judged(self) -> DataFrame:
        """Payments with split, fold, scores and the features that rules look at, written once: where alerts come from. The base, if
        there is one."""
        return self.base if "base" in self.__dict__ else written(_with_scores(features.signals(self.tx)), "judged")

    @cached_property
    def rows(self) -> DataFrame:
        """Transactions with their features."""
        return self.base.drop("risk_score", "rf_score", "gbt_score")

    @cached_property
    def feats(self) -> DataFrame:
        return self.base.select(F.col("id").alias("transaction_id"), *[n for n in features.FEATURE_NAMES if n != "amount"])

    @cached_property
    def scores(self) -> DataFrame:
        """A deterministic stand-in for model scores: id, risk_score, rf_score, gbt_score."""
        return self.base.select("id", "risk_score", "rf_score", "gbt_score")

    @cached_property
    def scored(self) -> DataFrame:
        """Test rows: id, is_fraud, fold, score. Where nothing else needs the other features, they are not computed."""
        if {"base", "judged"} & set(self.__dict__):
            rows = self.judged.withColumn("score", F.col("risk_score"))
        else:
            slim = self.tx.select("id", "timestamp", "sender_account", "receiver_account", "amount", "is_fraud", "fold", "is_training_set")
            rows = features.scoring(slim).withColumn("score", (F.expr(POINTS) / 100.0).cast("double"))
        return rows.where("NOT is_training_set").select("id", "is_fraud", "fold", "score")

    @cached_property
    def thresholds(self) -> DataFrame:
        return rules.threshold_table(self.spark, THRESHOLDS)

    @cached_property
    def alerts(self) -> DataFrame:
        found = detect.detect_all(self.judged.where("NOT is_training_set"), self.thresholds)
        status = F.when(F.col("transaction_id") % 5 == 0, "REVIEWED").when(F.col("transaction_id") % 7 == 0, "CONFIRMED").otherwise("NEW")
        return written(found.withColumn("status", status), "alerts")

    @cached_property
    def patterns(self) -> DataFrame:
        """A pattern for each rule and kind of payment that the alerts show: patternType, title."""
        seen = self.alerts.join(self.judged.select(F.col("id").alias("transaction_id"), "transaction_type"), "transaction_id")
        return seen.select(F.explode(F.split("rule_triggered", "; ")).alias("r"), "transaction_type").select(F.split("r", ":")[0].alias("patternType"), F.col("transaction_type").alias("title")).distinct()

    @cached_property
    def expl(self) -> DataFrame:
        made = self.spark.sql(EXPLANATIONS.replace("FROM alerts", "FROM {a}").replace("JOIN tx", "JOIN {t}"), a=self.alerts, t=self.judged)
        return written(made, "explanations")

    @cached_property
    def measured(self) -> DataFrame:
        """Each configuration's metrics on each fold, with the areas of the scores."""
        rows = evaluate.metrics(evaluate.counts(self.judged, self.alerts, by_fold=True))
        return written(rows.join(evaluate.auc(self.scored, ("fold",)), "fold"), "measured")

    @cached_property
    def folds(self) -> DataFrame:
        """Each configuration's metrics on each fold, with the areas of the scores and what its explanations are like."""
        flagged = F.count(F.when(~F.col("hallucination_free"), 1))
        told = self.expl.groupBy("detection_config", "fold").agg(
            F.round(F.avg(F.expr(ALL_FOUR)), 6).alias("quality"), F.round(flagged / F.nullif(F.count("hallucination_free"), F.lit(0)), 6).alias("hallucination_rate")
        )
        return written(self.measured.join(told, ["detection_config", "fold"], "left"), "folds")

    @cached_property
    def results(self) -> DataFrame:
        """Two experiments: every configuration, and a run of the rule set alone."""
        whole = evaluate.kfold_summary(self.folds, METRICS)
        named = whole.withColumn("experiment_name", F.lit("benchmark"))
        again = whole.where("detection_config = 'RULES_ONLY'").withColumn("experiment_name", F.lit("rules"))
        place = F.array_position(F.array(*map(F.lit, detect.CONFIGS)), F.col("detection_config")) * 10 + F.coalesce("fold", F.lit(9))
        both = named.unionByName(again)
        return written(both.withColumn("id", (place + F.when(F.col("experiment_name") == "rules", 100).otherwise(0)).cast("long")), "results")


#: Quality of an explanation with all four scores.
ALL_FOUR = "CASE WHEN completeness IS NOT NULL AND correctness IS NOT NULL AND actionability IS NOT NULL AND regulatory IS NOT NULL THEN (completeness + correctness + actionability + regulatory) / 4 END"

#: One explanation for each alert, with errors planted by id; both engines read it.
EXPLANATIONS = """
SELECT a.id, a.id AS alert_id, a.transaction_id, a.detection_config, a.ml_risk_score, t.amount, t.sender_account, t.receiver_account, t.fold, t.dataset_source,
       CASE WHEN a.transaction_id % 4 = 0 THEN 'LLM_RAG' WHEN a.transaction_id % 4 = 1 THEN 'LLM_DIRECT' ELSE 'LLM_RAG_VALIDATED' END AS explanation_type,
       CASE WHEN a.transaction_id % 11 = 0 THEN NULL
            WHEN a.transaction_id % 13 = 0 THEN 'The account Z12345678 behind this is unlikely fraud and low risk'
            WHEN a.transaction_id % 17 = 0 THEN 'This is certainly fraud by the sender'
            ELSE concat('Sender ', t.sender_account, ' moved ', CAST(t.amount AS VARCHAR(40)), ' to account ', t.receiver_account) END AS explanation_text,
       CASE WHEN a.transaction_id % 19 = 0 THEN '  ' ELSE concat('Risk of payment ', CAST(a.transaction_id AS VARCHAR(40))) END AS risk_summary,
       CASE WHEN a.transaction_id % 23 = 0 THEN 0 ELSE a.transaction_id % 3 + 1 END AS n_patterns, CASE WHEN a.transaction_id % 29 = 0 THEN 0 ELSE 2 END AS n_actions,
       CASE WHEN a.transaction_id % 31 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(a.transaction_id % 100 AS DOUBLE) / 100 END AS confidence_score,
       CASE WHEN a.transaction_id % 6 = 0 THEN NULL ELSE a.transaction_id % 5 <> 0 END AS hallucination_free,
       CASE WHEN a.transaction_id % 7 = 0 THEN NULL ELSE CAST(1 + a.transaction_id % 5 AS DOUBLE) END AS completeness,
       CASE WHEN a.transaction_id % 7 = 0 THEN NULL WHEN a.transaction_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + a.transaction_id % 4 AS DOUBLE) END AS correctness,
       CASE WHEN a.transaction_id % 7 = 0 OR a.transaction_id % 10 = 3 THEN NULL ELSE CAST(2 + a.transaction_id % 3 AS DOUBLE) END AS actionability,
       CASE WHEN a.transaction_id % 7 = 0 THEN NULL ELSE CAST(1 + a.transaction_id % 2 AS DOUBLE) END AS regulatory,
       CAST(200 + (a.id * 37) % 1800 AS BIGINT) AS latency_ms, CAST(100 + a.transaction_id % 400 AS BIGINT) AS prompt_tokens, CAST(50 + a.transaction_id % 90 AS BIGINT) AS completion_tokens
FROM alerts a JOIN tx t ON t.id = a.transaction_id
"""
