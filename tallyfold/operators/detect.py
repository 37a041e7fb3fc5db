"""Alerts from rules, scores, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.rules import evaluate

#: The detection configurations in their order.
CONFIGS = ("RULES_ONLY", "ML_ONLY", "ML_LLM_DIRECT", "ML_LLM_RAG", "FULL_SYSTEM")
CUTOFF = 0.5


def alert_id(config: Column) -> Column:
    return F.col("id") * 10 + F.array_position(F.array(*map(F.lit, CONFIGS)), config)


def candidates(split: DataFrame, feats: DataFrame, alerts: DataFrame | None = None, config: str | None = None) -> DataFrame:
    """Test rows with their features, if any, without those that the configuration has alerted."""
    rows = split.where("NOT is_training_set")
    if alerts is not None:
        done = alerts.where(F.col("detection_config") == config).select(F.col("transaction_id").alias("id"))
        rows = rows.join(done, "id", "left_anti")
    return rows.join(feats.withColumnRenamed("transaction_id", "id"), "id", "left")


def _alerts(rows: DataFrame, config: str, rules: Column, score: Column) -> DataFrame:
    name = F.lit(config)
    return rows.select(
        alert_id(name).alias("id"), F.col("id").alias("transaction_id"), name.alias("detection_config"), rules.alias("rule_triggered"), score.alias("ml_risk_score"), F.lit(True).alias("is_anomaly"), F.lit("NEW").alias("status")
    )


def detect_rules(rows: DataFrame, thresholds: DataFrame, config: str = "RULES_ONLY") -> DataFrame:
    return _alerts(evaluate(rows, thresholds).where("rule_triggered IS NOT NULL"), config, F.col("rule_triggered"), F.lit(None).cast("double"))


def detect_ml(rows: DataFrame, scores: DataFrame, config: str = "ML_ONLY", cutoff: float = CUTOFF) -> DataFrame:
    """rows joined with scores (id, risk_score); no score, no alert."""
    return _alerts(rows.join(scores, "id").where(F.col("risk_score") >= cutoff), config, F.lit(None).cast("string"), F.col("risk_score"))


def detect_full(rows: DataFrame, scores: DataFrame, thresholds: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    both = evaluate(rows.join(scores, "id", "left"), thresholds)
    flagged = F.when(F.col("risk_score") >= cutoff, F.col("risk_score"))
    return _alerts(both.where(F.col("rule_triggered").isNotNull() | flagged.isNotNull()), "FULL_SYSTEM", F.col("rule_triggered"), flagged)


def detect_all(rows: DataFrame, thresholds: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Alerts of the rule set, the scores and both (RULES_ONLY, ML_ONLY, FULL_SYSTEM) in one pass over rows with risk_score."""
    both = evaluate(rows, thresholds)
    fired, scored, none = F.col("rule_triggered"), F.when(F.col("risk_score") >= cutoff, F.col("risk_score")), F.lit(None)

    def alert(config: str, on: Column, rules: Column, score: Column) -> Column:
        name = F.lit(config)
        return F.when(on, F.struct(alert_id(name).alias("id"), name.alias("detection_config"), rules.cast("string").alias("rule_triggered"), score.cast("double").alias("ml_risk_score")))

    found = F.array(
        alert("RULES_ONLY", fired.isNotNull(), fired, none),
        alert("ML_ONLY", scored.isNotNull(), none, scored),
        alert("FULL_SYSTEM", fired.isNotNull() | scored.isNotNull(), fired, scored),
    )
    each = both.select(F.col("id").alias("transaction_id"), F.explode(F.array_compact(found)).alias("a"))
    return each.select("a.id", "transaction_id", "a.detection_config", "a.rule_triggered", "a.ml_risk_score", F.lit(True).alias("is_anomaly"), F.lit("NEW").alias("status"))


def capped(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("id").limit(limit)


def ensemble(scores: DataFrame) -> DataFrame:
    """id, rf_score, gbt_score: the larger one and its model; the forest on ties; the one there is, if one is missing."""
    rf, gbt = F.col("rf_score"), F.col("gbt_score")
    forest = gbt.isNull() | (rf >= gbt)
    return scores.select("id", F.when(forest, rf).otherwise(gbt).alias("risk_score"), F.when(rf.isNull() & gbt.isNull(), F.lit(None)).when(forest, "RANDOM_FOREST").otherwise("GRADIENT_BOOSTED").alias("model_name"))
