"""Oracle SQL of dashboards, breakdowns, lookups, explanation checks and exports, over the canonical tables of oracles.py.

The queries themselves are DataFrame functions (dashboards, lookups, explain); nothing here is run by Spark.
"""

from __future__ import annotations

from tallyfold.operators.explain import NUMBER

_DIMS = ("completeness", "correctness", "actionability", "regulatory")
_ALL_FOUR = " AND ".join(f"{d} IS NOT NULL" for d in _DIMS)
_MEAN_OF = f"({' + '.join(f'coalesce({d}, 0)' for d in _DIMS)}) / ({' + '.join(f'CASE WHEN {d} IS NULL THEN 0 ELSE 1 END' for d in _DIMS)})"
_QUALITY = (
    "count(*) AS n, count(hallucination_free) AS evaluated, count(CASE WHEN hallucination_free = false THEN 1 END) AS flagged, "
    "round(avg(CAST(latency_ms AS DOUBLE)), 6) AS avg_latency, "
    f"round(avg(CASE WHEN {_ALL_FOUR} THEN (completeness + correctness + actionability + regulatory) / 4 END), 6) AS avg_quality"
)
_FLAGS = {
    "EMPTY_RISK_SUMMARY": "trim(coalesce(risk_summary, '')) = ''",
    "EMPTY_EXPLANATION_TEXT": "trim(coalesce(explanation_text, '')) = ''",
    "EMPTY_SUSPICIOUS_PATTERNS": "n_patterns = 0",
    "EMPTY_RECOMMENDED_ACTIONS": "n_actions = 0",
    "CONFIDENCE_OUT_OF_RANGE": "confidence_score < 0 OR confidence_score > 1",
    "RISK_DIRECTION_MISMATCH": "ml_risk_score > 0.9 AND (lower(explanation_text) LIKE '%low risk%' OR lower(explanation_text) LIKE '%unlikely fraud%')",
    "RISK_OVERCLAIM": "ml_risk_score < 0.6 AND (lower(explanation_text) LIKE '%certainly fraud%' OR lower(explanation_text) LIKE '%definitely fraudulent%')",
}


def _flag(name: str) -> str:
    return f"CASE WHEN {_FLAGS[name]} THEN '{name}' END"



_MONEY = "format('{:,}', floor(amount)::BIGINT) || CASE WHEN cents = 0 THEN '' WHEN cents % 10 = 0 THEN '.' || (cents // 10)::VARCHAR ELSE '.' || lpad(cents::VARCHAR, 2, '0') END"
#: Whether each explanation names its amount.
AMOUNT = f""", p AS (SELECT id, amount, (amount * 100)::BIGINT % 100 AS cents, coalesce(explanation_text, '') || coalesce(' ' || risk_summary, '') AS t, '{NUMBER}' AS re FROM expl),
q AS (SELECT *, contains(t, amount::VARCHAR) OR contains(t, round(amount, 0)::BIGINT::VARCHAR) OR contains(t, {_MONEY}) OR contains(t, format('{{:,}}', round_even(amount, 0)::BIGINT)) OR (round(amount / 1000) > 0 AND contains(lower(t), round(amount / 1000)::BIGINT::VARCHAR || 'k'))
OR len(list_filter(regexp_extract_all(t, re, 0), lambda x: replace(regexp_extract(x, re, 1), ',', '')::DOUBLE * CASE WHEN regexp_matches(x, '[Kk]$') THEN 1000 ELSE 1 END BETWEEN amount::DOUBLE * 0.8 AND amount::DOUBLE * 1.2)) > 0 AS said FROM p)
"""
#: Each explanation with the names of its flags, in the order of the checks.
FLAGGED = AMOUNT + f""", flagged AS (SELECT e.*, concat_ws(',', {", ".join(_flag(k) for k in list(_FLAGS)[:5])},
  CASE WHEN trim(q.t) <> '' AND NOT said THEN 'AMOUNT_NOT_REFERENCED' END,
  CASE WHEN regexp_matches(lower(explanation_text), 'sender|receiver|account') AND NOT contains(explanation_text, sender_account) AND NOT contains(explanation_text, receiver_account)
    AND regexp_matches(explanation_text, '[A-Z][0-9]{{7,}}') THEN 'POSSIBLE_ACCOUNT_FABRICATION' END,
  {", ".join(_flag(k) for k in list(_FLAGS)[5:])}) AS flags FROM expl e JOIN q ON q.id = e.id)
"""

ORACLES: dict[str, str] = {
    # dashboards and breakdowns
    "dash_overview": "SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(CASE WHEN is_fraud THEN 1 END) FROM tx) AS fraud, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM expl) AS explanations, (SELECT count(*) FROM pat) AS patterns, (SELECT count(*) FROM results) AS results, (SELECT round(100.0 * count(CASE WHEN is_fraud THEN 1 END) / count(*), 2) FROM tx) AS fraud_pct",
    "dash_detection": "SELECT status, detection_config, count(*) AS n, round(avg(ml_risk_score), 6) AS avg_score FROM alerts WHERE is_anomaly GROUP BY GROUPING SETS ((status), (detection_config), ())",
    "dash_quality": f"SELECT explanation_type, {', '.join(f'round(avg({d}), 6) AS {d}' for d in _DIMS)}, {_QUALITY}, round(100.0 * count(CASE WHEN hallucination_free = false THEN 1 END) / count(*), 6) AS flagged_pct, round(avg(confidence_score), 6) AS avg_confidence FROM expl GROUP BY explanation_type",
    "dash_datasets": "SELECT dataset_source AS source, count(*) AS total, count(CASE WHEN is_fraud THEN 1 END) AS fraud, round(100.0 * count(CASE WHEN is_fraud THEN 1 END) / count(*), 2) AS fraud_pct FROM tx GROUP BY 1",
    "dash_types": "SELECT transaction_type, count(*) AS n FROM tx GROUP BY transaction_type",
    "dash_experiments": "SELECT experiment_name, detection_config, fold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(fpr, 4) AS fpr, round(auc_roc, 4) AS auc_roc, round(auc_pr, 4) AS auc_pr FROM results",
    "amount_averages": "SELECT round(avg(CAST(amount AS DOUBLE)), 4) AS avg_amount, round(avg(CASE WHEN is_fraud THEN CAST(amount AS DOUBLE) END), 4) AS avg_fraud_amount FROM tx",
    "metric_snapshot": "SELECT TIMESTAMP '2025-01-01 00:00:00' AS snapshot_at, (SELECT count(*) FROM tx) AS total_transactions, (SELECT count(CASE WHEN is_fraud THEN 1 END) FROM tx) AS total_fraud_tx, (SELECT count(*) FROM alerts) AS total_alerts, (SELECT count(*) FROM expl) AS total_explanations, (SELECT count(*) FROM pat) AS total_fraud_patterns, (SELECT count(*) FROM results) AS total_experiments",
    "quality_breakdown": f"SELECT detection_config, {', '.join(f'round(avg({d}), 6) AS {d}' for d in _DIMS)}, round((avg(completeness) + avg(correctness) + avg(actionability) + avg(regulatory)) / 4, 6) AS overall, count(CASE WHEN {_ALL_FOUR} THEN 1 END) AS scored FROM expl GROUP BY detection_config",
    "row_quality": f"SELECT id, CASE WHEN coalesce(completeness, correctness, actionability, regulatory) IS NOT NULL THEN round({_MEAN_OF}, 6) END AS quality FROM expl",
    "cost_breakdown": "SELECT detection_config, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(avg(CAST(prompt_tokens + completion_tokens AS DOUBLE)), 6) AS avg_tokens, round(avg(CAST(latency_ms AS DOUBLE)), 6) AS avg_latency, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_latency FROM expl GROUP BY detection_config",
    "pending_stats": "SELECT count(*) AS total, count(f.transaction_id) AS with_features, greatest(0, count(*) - count(f.transaction_id)) AS pending FROM tx t LEFT JOIN feats f ON f.transaction_id = t.id",
    "experiment_summary": "SELECT experiment_name, detection_config, fold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(fpr, 4) AS fpr, round(auc_roc, 4) AS auc_roc, round(auc_pr, 4) AS auc_pr FROM results WHERE experiment_name = 'rules'",
    "experiment_names": "SELECT DISTINCT experiment_name FROM results",
    "risk_band": "SELECT detection_config, CASE WHEN ml_risk_score < 0.4 THEN 'low' WHEN ml_risk_score < 0.7 THEN 'medium' WHEN ml_risk_score IS NOT NULL THEN 'high' END AS band, count(*) AS n FROM alerts GROUP BY 1, 2",
    "hallucination_breakdown": FLAGGED
    + "SELECT detection_config, flag, count(*) AS n FROM (SELECT detection_config, unnest(string_split(flags, ',')) AS flag FROM flagged WHERE flags <> '') x GROUP BY ALL",
    "data_quality": """SELECT check_id, category, severity, CASE WHEN bool_or(severity = 'FAIL') OVER () THEN 'FAIL' WHEN bool_or(severity = 'WARN') OVER () THEN 'WARN' ELSE 'PASS' END AS overall FROM (
SELECT 'transactions' AS check_id, 'Data' AS category, CASE WHEN count(*) = 0 OR count_if(is_fraud) = 0 THEN 'FAIL' WHEN 100.0 * count_if(is_fraud) / count(*) > 20 THEN 'WARN' ELSE 'PASS' END AS severity FROM tx
UNION ALL SELECT 'features-coverage', 'Data', CASE WHEN (SELECT count(*) FROM feats) = 0 THEN 'FAIL' WHEN (SELECT count(*) FROM feats) < (SELECT count(*) FROM tx) THEN 'WARN' ELSE 'PASS' END
UNION ALL SELECT 'train-test-split', 'Data', CASE WHEN count_if(is_training_set) IN (0, count(*)) THEN 'FAIL' WHEN 100.0 * count_if(NOT is_training_set) / count(*) BETWEEN 10 AND 30 THEN 'PASS' ELSE 'WARN' END FROM tx
UNION ALL SELECT 'alerts', 'Results', CASE WHEN count(*) = 0 THEN 'WARN' ELSE 'PASS' END FROM alerts
UNION ALL SELECT 'explanations', 'Results', CASE WHEN count(*) = 0 OR count(hallucination_free) < 0.5 * count(*) THEN 'WARN' ELSE 'PASS' END FROM expl
UNION ALL SELECT 'cakr-coverage', 'Results', CASE WHEN count(completeness) < 0.5 * count(*) THEN 'WARN' ELSE 'PASS' END FROM expl
UNION ALL SELECT 'knowledge-base', 'LLM', CASE WHEN count(*) < 5 THEN 'WARN' ELSE 'PASS' END FROM pat) c""",
    # explanation jobs
    "explain_route": "SELECT id, CASE WHEN detection_config IN ('RULES_ONLY', 'ML_ONLY') THEN 'SKIP' WHEN ml_risk_score IS NULL THEN 'RAG' WHEN ml_risk_score < 0.5 THEN 'SKIP' WHEN ml_risk_score < 0.75 THEN 'DIRECT' ELSE 'RAG' END AS route, CASE WHEN ml_risk_score IS NULL THEN 'LLM_RAG' WHEN ml_risk_score < 0.5 THEN NULL WHEN ml_risk_score < 0.75 THEN 'LLM_DIRECT' ELSE 'LLM_RAG' END AS effective_type FROM alerts",
    "explain_pending": "SELECT a.id FROM alerts a WHERE a.is_anomaly AND a.detection_config = 'FULL_SYSTEM' AND NOT EXISTS (SELECT 1 FROM expl e WHERE e.alert_id = a.id AND e.explanation_type = 'LLM_DIRECT') ORDER BY a.id LIMIT 200",
    "rag_dedup_keys": "SELECT DISTINCT rule_triggered, transaction_type FROM alerts a JOIN tx t ON t.id = a.transaction_id WHERE rule_triggered IS NOT NULL",
    "validate_empty_fields": "SELECT id, " + ", ".join(f"{_flag(k)} AS {k.lower()}" for k in list(_FLAGS)[:4]) + " FROM expl",
    "validate_confidence": f"SELECT id, {_flag('CONFIDENCE_OUT_OF_RANGE')} AS flag FROM expl",
    "validate_risk_direction": f"SELECT id, {_flag('RISK_DIRECTION_MISMATCH')} AS mismatch, {_flag('RISK_OVERCLAIM')} AS overclaim FROM expl",
    "validate_all": FLAGGED
    + "SELECT id, flags, flags = '' AS hallucination_free, CASE WHEN explanation_type = 'LLM_RAG' AND flags = '' THEN 'LLM_RAG_VALIDATED' ELSE explanation_type END AS explanation_type FROM flagged",
    "score_null_sentinels": "SELECT id, " + ", ".join(f"nullif({d}, 0) AS {d}" for d in _DIMS) + " FROM expl",
    "unscored_explanations": "SELECT id FROM expl WHERE completeness IS NULL AND explanation_type IN ('LLM_RAG', 'LLM_DIRECT') ORDER BY id LIMIT 100",
    "rescore_reset": "SELECT e.id, " + ", ".join(f"CASE WHEN s.id IS NULL THEN {d} END AS {d}" for d in _DIMS) + " FROM expl e LEFT JOIN (SELECT id FROM expl WHERE explanation_type = 'LLM_RAG' ORDER BY id LIMIT 50) s ON s.id = e.id",
    "rating_sample": "SELECT id, alert_id, explanation_text, amount, completeness, correctness, actionability, regulatory, NULL::DOUBLE AS human_completeness, NULL::DOUBLE AS human_correctness, NULL::DOUBLE AS human_actionability, NULL::DOUBLE AS human_regulatory FROM expl WHERE explanation_type = 'LLM_RAG' ORDER BY id LIMIT 200",
    # evaluation tables
    "testset_counts": "SELECT 'source' AS kind, dataset_source AS name, count(*) AS total, count_if(is_fraud)::BIGINT AS fraud FROM tx WHERE NOT is_training_set GROUP BY 2 UNION ALL SELECT 'config', detection_config, count(*), count_if(is_fraud)::BIGINT FROM alerts JOIN tx ON tx.id = transaction_id WHERE is_anomaly GROUP BY 2",
    "explanation_metrics": f"SELECT detection_config, explanation_type, {_QUALITY} FROM expl GROUP BY detection_config, explanation_type",
    "explanation_metrics_fold": f"SELECT detection_config, fold, {_QUALITY} FROM expl GROUP BY detection_config, fold",
    "winners": "SELECT metric, detection_config, value FROM (SELECT 'f1' AS metric, detection_config, f1 AS value, row_number() OVER (ORDER BY f1 DESC, detection_config) AS r FROM results WHERE experiment_name = 'benchmark' AND f1 IS NOT NULL AND fold IS NULL) x WHERE r = 1 UNION ALL SELECT metric, detection_config, value FROM (SELECT 'quality' AS metric, detection_config, quality AS value, row_number() OVER (ORDER BY quality DESC, detection_config) AS r FROM results WHERE experiment_name = 'benchmark' AND quality IS NOT NULL AND fold IS NULL) x WHERE r = 1 UNION ALL SELECT metric, detection_config, value FROM (SELECT 'fpr' AS metric, detection_config, fpr AS value, row_number() OVER (ORDER BY fpr ASC, detection_config) AS r FROM results WHERE experiment_name = 'benchmark' AND fpr IS NOT NULL AND fold IS NULL) x WHERE r = 1 UNION ALL SELECT metric, detection_config, value FROM (SELECT 'hallucination_rate' AS metric, detection_config, hallucination_rate AS value, row_number() OVER (ORDER BY hallucination_rate ASC, detection_config) AS r FROM results WHERE experiment_name = 'benchmark' AND hallucination_rate IS NOT NULL AND fold IS NULL) x WHERE r = 1",
    "compare_view": "SELECT experiment_name, detection_config, fold, precision, recall, f1, fpr FROM results WHERE fold IS NULL",
    "comparison_pivot": "SELECT x.metric, rules_only, ml_only, full_system, round(ml_only - rules_only, 6) AS ml_only_delta, round(full_system - rules_only, 6) AS full_system_delta, CASE WHEN rules_only * s >= ml_only * s AND rules_only * s >= full_system * s THEN 'RULES_ONLY' WHEN ml_only * s >= full_system * s THEN 'ML_ONLY' ELSE 'FULL_SYSTEM' END AS winner FROM (SELECT metric, any_value(s) AS s, max(CASE WHEN detection_config = 'RULES_ONLY' THEN value END) AS rules_only, max(CASE WHEN detection_config = 'ML_ONLY' THEN value END) AS ml_only, max(CASE WHEN detection_config = 'FULL_SYSTEM' THEN value END) AS full_system FROM (SELECT 'precision' AS metric, 1 AS s, detection_config, precision AS value FROM results WHERE fold IS NULL AND experiment_name = 'benchmark' UNION ALL SELECT 'recall' AS metric, 1 AS s, detection_config, recall AS value FROM results WHERE fold IS NULL AND experiment_name = 'benchmark' UNION ALL SELECT 'f1' AS metric, 1 AS s, detection_config, f1 AS value FROM results WHERE fold IS NULL AND experiment_name = 'benchmark' UNION ALL SELECT 'fpr' AS metric, -1 AS s, detection_config, fpr AS value FROM results WHERE fold IS NULL AND experiment_name = 'benchmark') y GROUP BY metric) x",
    # lookups
    "tx_search": "SELECT id, sender_account, receiver_account, amount FROM tx WHERE transaction_type = 'TRANSFER' AND is_fraud AND (lower(sender_account) LIKE '%c1%' OR lower(receiver_account) LIKE '%c1%') ORDER BY id DESC LIMIT 25",
    "alert_search": "SELECT id, transaction_id, ml_risk_score FROM alerts WHERE status = 'NEW' AND detection_config = 'FULL_SYSTEM' ORDER BY id DESC LIMIT 25",
    "explanation_search": "SELECT id FROM expl WHERE explanation_type = 'LLM_RAG' AND hallucination_free = false ORDER BY id DESC LIMIT 25",
    "high_risk_alerts": "SELECT id, ml_risk_score FROM alerts WHERE ml_risk_score >= 0.7 ORDER BY ml_risk_score DESC, id LIMIT 100",
    "sender_history": "SELECT id, sender_account, receiver_account, timestamp, amount FROM tx WHERE sender_account IN ('C1', 'C7', 'C20') AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'",
    "pair_exists": "SELECT id, EXISTS (SELECT 1 FROM tx p WHERE p.sender_account = t.sender_account AND p.receiver_account = t.receiver_account AND p.timestamp < t.timestamp) AS paid_before FROM tx t",
    "alerts_for_tx": "SELECT t.id, a.id AS alert_id, a.detection_config, e.explanation_type FROM tx t JOIN alerts a ON a.transaction_id = t.id LEFT JOIN expl e ON e.alert_id = a.id",
    "config_anomalies": "SELECT a.id, a.detection_config, t.fold FROM alerts a JOIN tx t ON t.id = a.transaction_id WHERE a.is_anomaly AND NOT t.is_training_set",
    "results_by_config": "SELECT id, experiment_name, fold, f1 FROM results WHERE detection_config = 'RULES_ONLY'",
    "keyset_page": "SELECT id, amount FROM tx WHERE NOT is_training_set AND id > 100 ORDER BY id LIMIT 500",
    # maintenance as rewritten tables, exports
    "alert_status_update": "SELECT id, CASE WHEN id % 10 = 1 AND transaction_id % 2 = 0 THEN 'CONFIRMED' WHEN id % 10 = 1 THEN 'DISMISSED' ELSE status END AS status FROM alerts",
    "delete_results": "SELECT id FROM results WHERE experiment_name <> 'rules'",
    "export_alerts": "SELECT id, transaction_id, detection_config, coalesce(rule_triggered, '') AS rule_triggered, coalesce(CAST(CAST(ml_risk_score AS DECIMAL(10,6)) AS VARCHAR(20)), '') AS score, status FROM alerts",
    "export_experiments": "SELECT experiment_name, detection_config, coalesce(CAST(fold AS VARCHAR(9)), '') AS fold, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1, coalesce(fpr, 0) AS fpr, coalesce(auc_roc, 0) AS auc_roc, coalesce(auc_pr, 0) AS auc_pr, round(quality, 6) AS quality, round(hallucination_rate, 6) AS hallucination_rate FROM results WHERE experiment_name = 'benchmark'",
    # the same with other arguments
    "tx_search_source": "SELECT id, sender_account, receiver_account, amount FROM tx WHERE dataset_source = 'CUSTOM' ORDER BY id DESC LIMIT 20 OFFSET 40",
    "alert_search_all": "SELECT id, transaction_id, ml_risk_score FROM alerts ORDER BY id DESC LIMIT 10 OFFSET 10",
    "explanation_search_unscored": "SELECT id FROM expl WHERE completeness IS NULL ORDER BY id DESC LIMIT 25 OFFSET 25",
    "explanation_search_clean": "SELECT id FROM expl WHERE hallucination_free ORDER BY id DESC LIMIT 50",
    "high_risk_alerts_top": "SELECT id, ml_risk_score FROM alerts WHERE ml_risk_score >= 0.3 ORDER BY ml_risk_score DESC, id LIMIT 7",
    "sender_history_all": "SELECT id, sender_account, receiver_account, timestamp, amount FROM tx WHERE sender_account = 'C3'",
    "sender_statistics": "SELECT sender_account, count(*) AS n, count(DISTINCT receiver_account) AS receivers, round(avg(CAST(amount AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(amount AS DOUBLE)), 4) AS sd FROM tx WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY sender_account",
    "config_anomalies_fold": "SELECT a.id, a.detection_config, t.fold FROM alerts a JOIN tx t ON t.id = a.transaction_id WHERE a.is_anomaly AND t.fold = 2 AND detection_config = 'ML_ONLY'",
    "patterns_of_type": "SELECT patternType, title FROM pat WHERE patternType = 'RAPID_VELOCITY'",
    "results_newest": "SELECT id, experiment_name, fold, f1 FROM results",
    "keyset_page_pending": "SELECT id, amount FROM tx WHERE id > 50 AND id % 3 = 0 ORDER BY id LIMIT 40",
    "delete_results_ids": "SELECT id FROM results WHERE id NOT IN (10, 11, 59)",
    "unscored_of_config": "SELECT id FROM expl WHERE completeness IS NULL AND detection_config = 'ML_ONLY' AND alert_id IN (SELECT id FROM alerts WHERE transaction_id % 2 = 0) ORDER BY id LIMIT 30",
    "explanation_metrics_scoped": f"SELECT detection_config, explanation_type, {_QUALITY} FROM expl WHERE detection_config = 'FULL_SYSTEM' AND explanation_type IN ('LLM_RAG', 'LLM_DIRECT') AND alert_id IN (SELECT id FROM alerts WHERE status = 'NEW') GROUP BY ALL",
    "export_alerts_config": "SELECT id, transaction_id, detection_config, coalesce(rule_triggered, '') AS rule_triggered, coalesce(CAST(CAST(ml_risk_score AS DECIMAL(10,6)) AS VARCHAR(20)), '') AS score, status FROM alerts WHERE is_anomaly AND detection_config = 'FULL_SYSTEM'",
}
