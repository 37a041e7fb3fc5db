"""Queries of dashboards, lookups, explanation checks, exports and maintenance; their oracles are in report_oracles."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import dashboards as d
from tallyfold.operators import explain
from tallyfold.operators import lookups as l
from tallyfold.plans.canonical import Canonical
from tallyfold.plans.register import query
from tallyfold.plans.report_oracles import ORACLES
from tallyfold.session import shared_path, written
from tallyfold.sources.tables import append_rows

_FROM, _TO = datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20)
_TX = ("id", "sender_account", "receiver_account", "amount")
_CONFIGS = ("RULES_ONLY", "ML_ONLY", "FULL_SYSTEM")
_VIEW = ("experiment_name", "detection_config", "fold", "precision", "recall", "f1", "fpr")


def _all(c: Canonical) -> tuple[DataFrame, ...]:
    return c.base, c.alerts, c.expl, c.patterns, c.results


def _accounts(c: Canonical, *names: str) -> DataFrame:
    return c.base.where(F.col("sender_account").isin(*names)).select("sender_account")


def _snapshot(c: Canonical) -> DataFrame:
    path = shared_path(c.spark, "snapshots")
    append_rows(d.metric_snapshot(*_all(c), F.lit("2025-01-01 00:00:00")), path)
    return c.spark.read.parquet(path)


def _statuses(c: Canonical) -> DataFrame:
    """Two updates for some alerts, the later one being the payment's."""
    ids = c.alerts.where("id % 10 = 1")
    first = ids.select("id", F.lit("DISMISSED").alias("status"), F.lit(1).alias("at"))
    return first.unionByName(ids.where("transaction_id % 2 = 0").select("id", F.lit("CONFIRMED").alias("status"), F.lit(2).alias("at")))


def _testset(c: Canonical) -> DataFrame:
    test = c.judged.where("NOT is_training_set")
    sources = d.datasets(test).select(F.lit("source").alias("kind"), F.col("source").alias("name"), "total", "fraud")
    hits = l.anomalies(c.alerts, c.judged, scope="test").join(test.select(F.col("id").alias("transaction_id"), "is_fraud"), "transaction_id")
    return sources.unionByName(hits.groupBy(F.lit("config").alias("kind"), F.col("detection_config").alias("name")).agg(d.count().alias("total"), F.count_if("is_fraud").alias("fraud")))


def _as_csv(c: Canonical, rows: DataFrame) -> DataFrame:
    """rows written as CSV with a header and read again; blanks stay blanks."""
    path = shared_path(c.spark, "export")
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    back = c.spark.read.option("header", True).option("emptyValue", "").schema(rows.schema).csv(path)
    return back.fillna("")


def _numbers(rows: DataFrame, *columns: str) -> DataFrame:
    """Exported text as numbers again, for comparison."""
    return rows.withColumns({x: F.round(F.nullif(F.col(x), F.lit("")).cast("double"), 6) for x in columns})


_QUERIES = {
    # dashboards and breakdowns
    "dash_overview": lambda c: d.overview(*_all(c)),
    "dash_detection": lambda c: d.detection(c.alerts),
    "dash_quality": lambda c: d.quality(c.expl),
    "dash_datasets": lambda c: d.datasets(c.tx0),
    "dash_types": lambda c: d.types(c.tx0),
    "dash_experiments": lambda c: d.experiments(c.results),
    "amount_averages": lambda c: d.amount_averages(c.tx0),
    "metric_snapshot": _snapshot,
    "quality_breakdown": lambda c: d.quality_breakdown(c.expl),
    "row_quality": lambda c: d.row_quality(c.expl),
    "cost_breakdown": lambda c: d.cost_breakdown(c.expl),
    "pending_stats": lambda c: d.pending_stats(c.base, c.feats),
    "experiment_summary": lambda c: d.experiments(c.results, "rules"),
    "experiment_names": lambda c: d.experiment_names(c.results),
    "risk_band": lambda c: d.risk_bands(c.alerts),
    "hallucination_breakdown": lambda c: d.hallucination_breakdown(explain.validate(c.expl)),
    "data_quality": lambda c: d.data_quality(c.base, c.feats, c.alerts, c.expl, c.patterns),
    # explanation jobs
    "explain_route": lambda c: explain.route(c.alerts),
    "explain_pending": lambda c: l.pending_explanations(c.alerts, c.expl, "FULL_SYSTEM", "LLM_DIRECT"),
    "rag_dedup_keys": lambda c: explain.retrieval_keys(c.alerts, c.judged),
    "validate_empty_fields": lambda c: explain.check(c.expl, **{n: n for n in ("empty_risk_summary", "empty_explanation_text", "empty_suspicious_patterns", "empty_recommended_actions")}),
    "validate_confidence": lambda c: explain.check(c.expl, flag="confidence"),
    "validate_risk_direction": lambda c: explain.check(c.expl, mismatch="mismatch", overclaim="overclaim"),
    "validate_all": lambda c: explain.validate(c.expl).select("id", F.array_join("flags", ",").alias("flags"), "hallucination_free", "explanation_type"),
    "score_null_sentinels": lambda c: l.null_sentinels(c.expl, d.DIMS).select("id", *d.DIMS),
    "unscored_explanations": lambda c: l.unscored(c.expl, ("LLM_RAG", "LLM_DIRECT")),
    "unscored_of_config": lambda c: l.unscored(c.expl, config="ML_ONLY", ids=c.alerts.where("transaction_id % 2 = 0").select(F.col("id").alias("alert_id")), n=30),
    "rescore_reset": lambda c: l.rescore_reset(c.expl, "LLM_RAG", 50, d.DIMS).select("id", *d.DIMS),
    "rating_sample": lambda c: l.rating_sample(c.expl, "LLM_RAG", 200, d.DIMS),
    # evaluation tables
    "testset_counts": _testset,
    "explanation_metrics": lambda c: d.explanation_metrics(c.expl, ("detection_config", "explanation_type")),
    "explanation_metrics_scoped": lambda c: d.explanation_metrics(
        c.expl, ("detection_config", "explanation_type"), "FULL_SYSTEM", ("LLM_RAG", "LLM_DIRECT"), c.alerts.where("status = 'NEW'").select(F.col("id").alias("alert_id"))
    ),
    "explanation_metrics_fold": lambda c: d.explanation_metrics(c.expl, ("detection_config", "fold")),
    "winners": lambda c: d.winners(c.results.where("experiment_name = 'benchmark'")),
    "compare_view": lambda c: d.compare_view(c.results).select(*_VIEW),
    "comparison_pivot": lambda c: d.comparison_pivot(c.results.where("experiment_name = 'benchmark'"), _CONFIGS),
    # lookups
    "tx_search": lambda c: l.search_transactions(c.tx0, fraud=True, type_="TRANSFER", account="c1").select(*_TX),
    "tx_search_source": lambda c: l.search_transactions(c.tx0, source="CUSTOM", page=2, size=20).select(*_TX),
    "alert_search": lambda c: l.search_alerts(c.alerts, "NEW", "FULL_SYSTEM").select("id", "transaction_id", "ml_risk_score"),
    "alert_search_all": lambda c: l.search_alerts(c.alerts, page=1, size=10).select("id", "transaction_id", "ml_risk_score"),
    "explanation_search": lambda c: l.search_explanations(c.expl, "LLM_RAG", "flagged").select("id"),
    "explanation_search_unscored": lambda c: l.search_explanations(c.expl, state="unscored", page=1).select("id"),
    "explanation_search_clean": lambda c: l.search_explanations(c.expl, state="clean", size=50).select("id"),
    "high_risk_alerts": lambda c: l.high_risk_alerts(c.alerts, 0.7).select("id", "ml_risk_score"),
    "high_risk_alerts_top": lambda c: l.high_risk_alerts(c.alerts, 0.3, 7).select("id", "ml_risk_score"),
    "sender_history": lambda c: l.sender_history(c.tx0, _accounts(c, "C1", "C7", "C20"), _FROM, _TO).select("id", "sender_account", "receiver_account", "timestamp", "amount"),
    "sender_history_all": lambda c: l.sender_history(c.tx0, _accounts(c, "C3")).select("id", "sender_account", "receiver_account", "timestamp", "amount"),
    "sender_statistics": lambda c: l.sender_statistics(c.tx0, _FROM, _TO),
    "pair_exists": lambda c: l.paid_before(c.tx0),
    "alerts_for_tx": lambda c: l.alerts_of(c.judged, c.alerts, c.expl),
    "config_anomalies": lambda c: l.anomalies(c.alerts, c.judged, scope="test").select("id", "detection_config", "fold"),
    "config_anomalies_fold": lambda c: l.anomalies(c.alerts, c.judged, "ML_ONLY", fold=2).select("id", "detection_config", "fold"),
    "patterns_of_type": lambda c: l.patterns(c.patterns, "RAPID_VELOCITY"),
    "results_by_config": lambda c: l.results_of(c.results, "RULES_ONLY").select("id", "experiment_name", "fold", "f1"),
    "results_newest": lambda c: l.results_of(c.results).select("id", "experiment_name", "fold", "f1"),
    "keyset_page": lambda c: l.keyset_page(c.tx, 100, 500, "test").select("id", "amount"),
    "keyset_page_pending": lambda c: l.keyset_page(c.tx0, 50, 40, "pending", c.tx0.where("id % 3 <> 0").select(F.col("id").alias("transaction_id"))).select("id", "amount"),
    # maintenance as rewritten tables, exports
    "alert_status_update": lambda c: written(l.update_status(c.alerts, _statuses(c)), "alerts").select("id", "status"),
    "delete_results": lambda c: written(l.delete_results(c.results, name="rules"), "results").select("id"),
    "delete_results_ids": lambda c: written(l.delete_results(c.results, [10, 11, 59]), "results").select("id"),
    "export_alerts": lambda c: _as_csv(c, d.alerts_csv(c.alerts)),
    "export_alerts_config": lambda c: _as_csv(c, d.alerts_csv(c.alerts, "FULL_SYSTEM")),
    "export_experiments": lambda c: _numbers(_as_csv(c, d.experiments_csv(c.results, "benchmark")), "quality", "hallucination_rate"),
}
for _name, _make in _QUERIES.items():
    query(_name, ORACLES[_name])(_make)
