"""DuckDB SQL of the canonical tables, as common table expressions in front of each oracle query."""

from __future__ import annotations

from tallyfold.plans.canonical import EXPLANATIONS, METRICS

_W = "OVER (PARTITION BY sender_account ORDER BY timestamp RANGE BETWEEN INTERVAL '{h} hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)"
_H, _D, _K = (_W.format(h=h) for h in (1, 24, 168))


def _rule_text() -> str:
    large = "CASE WHEN amount >= 200000 THEN 'LARGE_TRANSACTION: Transaction amount ' || amount::VARCHAR || ' exceeds threshold 200000' END"
    new = "CASE WHEN is_new_receiver AND amount >= 50000 THEN 'NEW_RECEIVER_HIGH_VALUE: High-value transfer of ' || amount::VARCHAR || ' to new receiver ' || receiver_account || ' (threshold: 50000)' END"
    rapid = "CASE WHEN tx_velocity_1h >= 2 THEN 'RAPID_VELOCITY: Sender ' || sender_account || ' has ' || tx_velocity_1h::VARCHAR || ' transactions in the last hour (threshold: 2)' END"
    small = "CASE WHEN is_round_amount AND amount > 0 AND amount <= 10000 AND tx_velocity_24h >= 3 THEN 'STRUCTURING: Potential structuring: round amount ' || amount::VARCHAR || ' at/below 10000 with ' || tx_velocity_24h::VARCHAR || ' transactions in 24h' END"
    return f"nullif(concat_ws('; ', {large}, {new}, {rapid}, {small}), '')"


BASE = f"""
WITH tx0 AS (SELECT e.event_id AS id, e.ts AS timestamp, 'C' || e.user_id::VARCHAR AS sender_account, 'M' || json_extract_string(e.props, '$.k') AS receiver_account,
  CASE e.event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'click' THEN 'TRANSFER' WHEN 'view' THEN 'CASH_OUT' WHEN 'signup' THEN 'CASH_IN' ELSE 'DEBIT' END AS transaction_type,
  (e.value::DECIMAL(18,2) * 1000)::DECIMAL(18,2) AS amount, c.c_acctbal::DECIMAL(18,2) AS sender_balance_before,
  ((e.value >= 200 AND e.event_id % 3 = 0) OR e.event_id % 211 = 0) AS is_fraud, CASE WHEN e.event_id % 10 = 0 THEN 'CUSTOM' ELSE 'PAYSIM' END AS dataset_source FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id),
cut AS MATERIALIZED (SELECT quantile_disc(epoch_us(timestamp), 0.8) AS c FROM tx0),
tx AS MATERIALIZED (SELECT tx0.*, epoch_us(timestamp) < c AS is_training_set,
  CASE WHEN epoch_us(timestamp) >= c THEN (('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 5)::INT END AS fold FROM tx0, cut),
win AS (SELECT *, (amount * 100)::BIGINT AS cents, (count(*) {_H})::INT AS tx_velocity_1h, (count(*) {_D})::INT AS tx_velocity_24h,
  count(*) {_K} AS n7, coalesce(sum((amount * 100)::HUGEINT) {_K}, 0)::HUGEINT AS s7, coalesce(sum((amount * 100)::HUGEINT * (amount * 100)::HUGEINT) {_K}, 0)::HUGEINT AS q7,
  (count(DISTINCT receiver_account) {_K})::INT AS receiver_diversity_7d,
  row_number() OVER (PARTITION BY sender_account, receiver_account ORDER BY timestamp, id) = 1 AS is_new_receiver FROM tx0),
sd AS (SELECT *, CASE WHEN n7 > 0 THEN ((2 * s7 + n7) // (2 * n7))::DOUBLE / 100 ELSE 0.0 END AS avg7,
  CASE WHEN n7 > 0 THEN sqrt((n7 * q7 - s7 * s7)::DOUBLE) / n7 / 100 ELSE 0.0 END AS stddev_7d FROM win),
feats AS MATERIALIZED (SELECT id AS transaction_id,
  CASE WHEN stddev_7d > 0 THEN round((amount::DOUBLE - avg7) / stddev_7d, 6) ELSE 0.0 END AS amount_zscore, tx_velocity_1h, tx_velocity_24h, avg7::DECIMAL(18,2) AS avg_amount_7d,
  CASE WHEN avg7 > 0 THEN round(amount::DOUBLE / avg7, 6) ELSE 0.0 END AS amount_ratio_to_avg,
  CASE WHEN sender_balance_before > 0 THEN round(amount::DOUBLE / sender_balance_before::DOUBLE, 6) ELSE 0.0 END AS balance_change_ratio,
  is_new_receiver, receiver_diversity_7d, hour(timestamp)::SMALLINT AS hour_of_day, isodow(timestamp)::SMALLINT AS day_of_week,
  (amount > 0 AND amount % 1000 = 0) AS is_round_amount, transaction_type IN ('TRANSFER', 'CASH_OUT') AS is_high_risk_type FROM sd),
rows_ AS MATERIALIZED (SELECT tx.*, f.* EXCLUDE (transaction_id) FROM tx LEFT JOIN feats f ON f.transaction_id = tx.id),
ruled AS MATERIALIZED (SELECT *, {_rule_text()} AS rule_triggered FROM rows_),
pts AS (SELECT id, CASE WHEN amount >= 50000 THEN 35 ELSE 0 END + CASE WHEN is_new_receiver THEN 20 ELSE 0 END + 5 * least(tx_velocity_24h, 5) + id % 20 AS n FROM rows_),
scores AS MATERIALIZED (SELECT id, n::DOUBLE / 100 AS risk_score, n::DOUBLE / 100 AS rf_score, (n + id % 3 - 1)::DOUBLE / 100 AS gbt_score FROM pts),
found AS (SELECT id * 10 + 1 AS id, id AS transaction_id, 'RULES_ONLY' AS detection_config, rule_triggered, NULL::DOUBLE AS ml_risk_score FROM ruled WHERE NOT is_training_set AND rule_triggered IS NOT NULL
  UNION ALL SELECT id * 10 + 2, id, 'ML_ONLY', NULL, risk_score FROM ruled JOIN scores USING (id) WHERE NOT is_training_set AND risk_score >= 0.5
  UNION ALL SELECT id * 10 + 5, id, 'FULL_SYSTEM', rule_triggered, CASE WHEN risk_score >= 0.5 THEN risk_score END FROM ruled JOIN scores USING (id) WHERE NOT is_training_set AND (rule_triggered IS NOT NULL OR risk_score >= 0.5)),
alerts AS MATERIALIZED (SELECT *, true AS is_anomaly, CASE WHEN transaction_id % 5 = 0 THEN 'REVIEWED' WHEN transaction_id % 7 = 0 THEN 'CONFIRMED' ELSE 'NEW' END AS status FROM found),
expl AS MATERIALIZED ({EXPLANATIONS}),
pat AS (SELECT DISTINCT string_split(p, ':')[1] AS patternType, transaction_type AS title FROM (SELECT unnest(string_split(rule_triggered, '; ')) AS p, transaction_type FROM alerts a JOIN tx t ON t.id = a.transaction_id) x),
sizes AS (SELECT fold, count(*) AS total, count_if(is_fraud)::BIGINT AS fraud FROM tx WHERE NOT is_training_set GROUP BY fold),
hits AS (SELECT detection_config, fold, count(*) AS alerts, count_if(is_fraud)::BIGINT AS tp FROM alerts JOIN tx ON tx.id = transaction_id GROUP BY ALL),
fc AS (SELECT *, greatest(0, alerts - tp) AS fp, greatest(0, fraud - tp) AS fn, greatest(0, total - tp - greatest(0, alerts - tp) - greatest(0, fraud - tp)) AS tn FROM hits JOIN sizes USING (fold)),
sc AS MATERIALIZED (SELECT risk_score AS score, is_fraud, fold FROM tx JOIN scores USING (id) WHERE NOT is_training_set),
ftie AS (SELECT fold, score, count_if(is_fraud) AS p, count_if(NOT is_fraud) AS n FROM sc GROUP BY ALL),
fcum AS (SELECT fold, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS neg FROM ftie WINDOW d AS (PARTITION BY fold ORDER BY score DESC)),
fcv AS (SELECT fold, score, pos, neg, tp::DOUBLE / nullif(pos, 0) AS tpr, fp::DOUBLE / nullif(neg, 0) AS fpr, tp::DOUBLE / (tp + fp) AS pc FROM fcum),
fst AS (SELECT fold, pos, neg, (fpr - lag(fpr, 1, 0.0) OVER w) * (tpr + lag(tpr, 1, 0.0) OVER w) / 2 AS roc, (tpr - lag(tpr, 1, 0.0) OVER w) * (pc + lag(pc, 1, 1.0) OVER w) / 2 AS pr FROM fcv WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
fareas AS (SELECT fold, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(roc), 6) ELSE 'NaN'::DOUBLE END AS auc_roc, CASE WHEN max(pos) = 0 THEN 0.0 WHEN max(neg) = 0 THEN 1.0 ELSE round(sum(pr), 6) END AS auc_pr FROM fst GROUP BY fold),
ftold AS (SELECT detection_config, fold, round(avg((completeness + correctness + actionability + regulatory) / 4), 6) AS quality, round(count_if(NOT hallucination_free)::DOUBLE / nullif(count(hallucination_free), 0), 6) AS hallucination_rate FROM expl GROUP BY ALL),
folds AS MATERIALIZED (SELECT fc.*, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 6) ELSE 0.0 END AS fpr, auc_roc, auc_pr, quality, hallucination_rate
  FROM fc JOIN fareas USING (fold) LEFT JOIN ftold USING (detection_config, fold)),
results0 AS MATERIALIZED (SELECT detection_config, fold, {", ".join(METRICS)}, {", ".join(f"NULL::DOUBLE AS {m}_std" for m in METRICS)} FROM folds
  UNION ALL SELECT detection_config, NULL, {", ".join(f"round(avg({m}), 6)" for m in METRICS)}, {", ".join(f"CASE WHEN count({m}) > 1 THEN round(stddev_samp({m}), 6) ELSE 0.0 END" for m in METRICS)} FROM folds GROUP BY detection_config),
results AS MATERIALIZED (SELECT *, list_position(['RULES_ONLY', 'ML_ONLY', 'ML_LLM_DIRECT', 'ML_LLM_RAG', 'FULL_SYSTEM'], detection_config) * 10 + coalesce(fold, 9) + CASE WHEN experiment_name = 'rules' THEN 100 ELSE 0 END AS id
  FROM (SELECT *, 'benchmark' AS experiment_name FROM results0 UNION ALL SELECT *, 'rules' FROM results0 WHERE detection_config = 'RULES_ONLY') x)
"""


def over(sql: str) -> str:
    """An oracle over the canonical tables."""
    return f"{BASE}\n{sql}"
