"""The library's queries by name, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import detect, evaluate, features, retrieval, rules, split
from tallyfold.plans.canonical import METRICS, Canonical
from tallyfold.plans import reports, stores, workflows  # noqa: F401  register their own
from tallyfold.plans.register import ORACLES, QUERIES, query  # noqa: F401
from tallyfold.session import shared_path, written
from tallyfold.sources import imports


# features
_F = "amount_zscore tx_velocity_1h tx_velocity_24h avg_amount_7d amount_ratio_to_avg balance_change_ratio is_new_receiver receiver_diversity_7d hour_of_day day_of_week is_round_amount is_high_risk_type".split()
query("canonical_transactions", "SELECT * FROM tx0")(lambda c: c.tx0)
query("feat_velocity", "SELECT transaction_id AS id, tx_velocity_1h, tx_velocity_24h FROM feats")(lambda c: features.velocity(c.tx0).select("id", "tx_velocity_1h", "tx_velocity_24h"))
query("feat_amount_stats_7d", "SELECT id, avg7::DECIMAL(18,2) AS avg_amount_7d, round(stddev_7d, 6) AS stddev_7d FROM sd")(
    lambda c: features.amount_stats_7d(c.tx0).select("id", "avg_amount_7d", F.round("stddev_7d", 6).alias("stddev_7d"))
)
query("feat_zscore_ratio", "SELECT transaction_id AS id, amount_zscore, amount_ratio_to_avg FROM feats")(
    lambda c: features.zscore_and_ratio(features.amount_stats_7d(c.tx0)).select("id", "amount_zscore", "amount_ratio_to_avg")
)
query("feat_balance_ratio", "SELECT transaction_id AS id, balance_change_ratio FROM feats")(lambda c: features.balance_ratio(c.tx0).select("id", "balance_change_ratio"))
query("feat_new_receiver", "SELECT transaction_id AS id, is_new_receiver FROM feats")(lambda c: features.new_receiver(c.tx0).select("id", "is_new_receiver"))
query("feat_receiver_diversity", "SELECT transaction_id AS id, receiver_diversity_7d FROM feats")(lambda c: features.receiver_diversity(c.tx0).select("id", "receiver_diversity_7d"))
query("feat_calendar_flags", "SELECT transaction_id AS id, hour_of_day, day_of_week, is_round_amount, is_high_risk_type FROM feats")(
    lambda c: features.calendar_flags(c.tx0).select("id", "hour_of_day", "day_of_week", "is_round_amount", "is_high_risk_type")
)
query(
    "feat_vector_json",
    "SELECT transaction_id, amount::DOUBLE AS amount, " + ", ".join(f"{f}::{'BOOLEAN' if f.startswith('is_') else 'DOUBLE'} AS {f}" for f in _F) + " FROM feats JOIN tx0 ON id = transaction_id",
)(
    # read again field by field, as the engines write numbers differently
    lambda c: features.feature_vector(c.tx0, c.feats).select("transaction_id", F.from_json("feature_vector", ", ".join(f"{f} {'boolean' if f.startswith('is_') else 'double'}" for f in features.FEATURE_NAMES)).alias("v")).select("transaction_id", "v.*")
)
query("features_full", "SELECT * FROM feats")(lambda c: features.features_full(c.tx0))
query("features_incremental", "SELECT * FROM feats WHERE transaction_id % 4 = 0")(lambda c: features.features_incremental(c.tx0, c.tx0.where("id % 4 <> 0").select(F.col("id").alias("transaction_id"))))
query("features_subset", "SELECT * FROM feats WHERE transaction_id IN (SELECT id FROM tx0 WHERE id % 2 = 1 ORDER BY id LIMIT 1000)")(
    lambda c: features.features_subset(c.tx0, c.tx0.where("id % 2 = 0").select(F.col("id").alias("transaction_id")), 1000)
)
query(
    "feature_assemble",
    "SELECT id, is_fraud::INT AS label, amount::DOUBLE AS f_amount, " + ", ".join(f"coalesce({f}::{'INT::' if f.startswith('is_') else ''}DOUBLE, 0.0) AS f_{f}" for f in _F) + " FROM rows_",
)(lambda c: features.assemble(c.tx0, c.feats))

# splits, folds, samples
_ID = "SELECT id FROM "
#: Sizes of the samples: the operators' defaults.
N_TRAIN, N_AUC = 200_000, 20_000
_BY = "ORDER BY md5(id::VARCHAR), id LIMIT"
query("split_temporal", "SELECT id, is_training_set FROM tx")(lambda c: split.temporal_split(c.tx0).select("id", "is_training_set"))
query("split_summary", "SELECT min(CASE WHEN NOT is_training_set THEN timestamp END) AS cutoff, count(*) AS total, count(CASE WHEN is_training_set THEN 1 END) AS train, count(CASE WHEN NOT is_training_set THEN 1 END) AS test, 0.8::DOUBLE AS ratio FROM tx")(
    lambda c: split.split_summary(c.tx)
)
query("split_stratified", "SELECT id, row_number() OVER (PARTITION BY is_fraud ORDER BY id) % 5 <> 0 AS is_training_set FROM tx0")(lambda c: split.stratified_split(c.tx0).select("id", "is_training_set"))
query("fold_assign", "SELECT id, fold FROM tx")(lambda c: c.tx.select("id", "fold"))
query("train_sample", f"{_ID} tx WHERE is_training_set AND is_fraud UNION ALL ({_ID} tx WHERE is_training_set AND NOT is_fraud {_BY} {N_TRAIN})")(lambda c: split.training_sample(c.tx, N_TRAIN).select("id"))
query("auc_sample", f"{_ID} tx WHERE NOT is_training_set AND is_fraud UNION ALL ({_ID} tx WHERE NOT is_training_set AND NOT is_fraud {_BY} {N_AUC})")(lambda c: split.auc_sample(c.tx, N_AUC).select("id"))
query("sample_eligible_alerts", f"{_ID} alerts a WHERE is_anomaly AND detection_config = 'FULL_SYSTEM' AND NOT EXISTS (SELECT 1 FROM expl e WHERE e.alert_id = a.id AND explanation_type = 'LLM_RAG') {_BY} 100")(
    lambda c: split.first_by_hash(
        c.alerts.where("is_anomaly AND detection_config = 'FULL_SYSTEM'").join(c.expl.where("explanation_type = 'LLM_RAG'").select(F.col("alert_id").alias("id")), "id", "left_anti"), 100
    ).select("id")
)

# rules and detection
_RULE_KEYS = {"rule_large": "LARGE_TRANSACTION", "rule_new_receiver": "NEW_RECEIVER_HIGH_VALUE", "rule_rapid_velocity": "RAPID_VELOCITY", "rule_structuring": "STRUCTURING"}
for _key, _rule in _RULE_KEYS.items():
    query(_key, f"SELECT id, coalesce(contains('; ' || rule_triggered, '; {_rule}: '), false) AS triggered, nullif(regexp_extract(rule_triggered, '{_rule}: ([^;]*)', 1), '') AS reason FROM ruled")(
        lambda c, r=_rule: rules.rule(c.rows, c.thresholds, r)
    )
query("rules_evaluate", "SELECT id, rule_triggered FROM ruled")(lambda c: rules.evaluate(c.rows, c.thresholds).select("id", "rule_triggered"))
query(
    "rule_thresholds",
    """SELECT rule_name, current_value::DOUBLE AS current_value, default_value::BIGINT AS default_value, current_value = default_value AS at_default, current_value < low OR current_value > high AS outside_range
FROM (VALUES ('LARGE_TRANSACTION', 200000, 1000000, 10000, 10000000), ('NEW_RECEIVER_HIGH_VALUE', 50000, 500000, 1000, 100000), ('RAPID_VELOCITY', 2, 3, 2, 20), ('STRUCTURING', 10000, 10000, 5000, 10000)) x(rule_name, current_value, default_value, low, high)""",
)(lambda c: rules.threshold_view(c.thresholds))
_CAND = "SELECT id, amount, tx_velocity_1h FROM rows_ WHERE NOT is_training_set AND id NOT IN (SELECT transaction_id FROM alerts WHERE detection_config = 'RULES_ONLY' AND transaction_id % 2 = 0)"
query("detect_candidates", _CAND)(lambda c: detect.candidates(c.base.select(*c.tx0.columns, "is_training_set", "fold"), c.feats, c.alerts.where("transaction_id % 2 = 0"), "RULES_ONLY").select("id", "amount", "tx_velocity_1h"))
_ALERT = "SELECT id, transaction_id, detection_config, rule_triggered, ml_risk_score FROM alerts WHERE detection_config"
_A = ("id", "transaction_id", "detection_config", "rule_triggered", "ml_risk_score")
query("detect_rules_only", f"{_ALERT} = 'RULES_ONLY'")(lambda c: detect.detect_rules(c.fresh.where("NOT is_training_set"), c.thresholds).select(*_A))
query("detect_ml", f"{_ALERT} = 'ML_ONLY'")(lambda c: detect.detect_ml(detect.candidates(c.base.select(*c.tx0.columns, "is_training_set", "fold"), c.feats), c.scores.select("id", "risk_score")).select(*_A))
query("detect_full_system", f"{_ALERT} = 'FULL_SYSTEM'")(lambda c: detect.detect_full(detect.candidates(c.base.select(*c.tx0.columns, "is_training_set", "fold"), c.feats), c.scores.select("id", "risk_score"), c.thresholds).select(*_A))
query("detect_capped", f"{_ALERT} = 'RULES_ONLY' AND transaction_id IN (SELECT id FROM tx WHERE NOT is_training_set ORDER BY id LIMIT 1000)")(
    lambda c: detect.detect_rules(detect.capped(detect.candidates(c.base.select(*c.tx0.columns, "is_training_set", "fold"), c.feats), 1000), c.thresholds).select(*_A)
)
query("detect_single", f"{_ALERT} = 'RULES_ONLY' AND transaction_id = (SELECT max(transaction_id) FROM alerts WHERE detection_config = 'RULES_ONLY')")(
    lambda c: detect.detect_rules(
        detect.candidates(c.base.select(*c.tx0.columns, "is_training_set", "fold"), c.feats).join(F.broadcast(c.alerts.where("detection_config = 'RULES_ONLY'").agg(F.max("transaction_id").alias("id"))), "id", "left_semi"), c.thresholds
    ).select(*_A)
)
query("ml_ensemble", "SELECT id, CASE WHEN rf_score >= gbt_score THEN rf_score ELSE gbt_score END AS risk_score, CASE WHEN rf_score >= gbt_score THEN 'RANDOM_FOREST' ELSE 'GRADIENT_BOOSTED' END AS model_name FROM scores")(
    lambda c: detect.ensemble(c.scores)
)

# evaluation
_M = "total, fraud, alerts, tp, fp, fn, tn, precision, recall, f1, fpr"
_TOTAL = """, s AS (SELECT count(*) AS total, count_if(is_fraud)::BIGINT AS fraud FROM tx WHERE NOT is_training_set), h AS (SELECT detection_config, sum(alerts)::BIGINT AS alerts, sum(tp)::BIGINT AS tp FROM hits GROUP BY 1),
m AS (SELECT *, greatest(0, alerts - tp) AS fp, greatest(0, fraud - tp) AS fn, greatest(0, total - tp - greatest(0, alerts - tp) - greatest(0, fraud - tp)) AS tn FROM h, s)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 6) ELSE 0.0 END AS fpr FROM m"""
query("metrics_from_counts", _TOTAL)(lambda c: evaluate.metrics(evaluate.counts(c.judged, c.alerts)))
query("confusion_metrics", f"SELECT detection_config, fold, {_M} FROM folds")(lambda c: evaluate.metrics(evaluate.counts(c.judged, c.alerts, by_fold=True)))
query("fold_counts", "SELECT detection_config, fold, alerts, tp, total, fraud FROM hits JOIN sizes USING (fold)")(lambda c: evaluate.counts(c.judged, c.alerts, by_fold=True))
query("kfold_summary", "SELECT * FROM results0")(lambda c: evaluate.kfold_summary(c.folds, METRICS))


_CURVE = """, tie AS (SELECT {by} score, count_if(is_fraud) AS p, count_if(NOT is_fraud) AS n FROM sc GROUP BY ALL),
cum AS (SELECT {by} score, sum(p) OVER (PARTITION BY {part} ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {part} ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY {part}) AS pos, sum(n) OVER (PARTITION BY {part}) AS neg FROM tie),
cv AS (SELECT {by} score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::DOUBLE / nullif(pos, 0) AS tpr, fp::DOUBLE / nullif(neg, 0) AS fpr, tp::DOUBLE / (tp + fp) AS precision FROM cum)"""
_AUC = """, st AS (SELECT {by} pos, neg, (fpr - lag(fpr, 1, 0.0) OVER w) * (tpr + lag(tpr, 1, 0.0) OVER w) / 2 AS roc, (tpr - lag(tpr, 1, 0.0) OVER w) * (precision + lag(precision, 1, 1.0) OVER w) / 2 AS pr FROM cv WINDOW w AS (PARTITION BY {part} ORDER BY score DESC))
SELECT {by} CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(roc), 6) ELSE 'NaN'::DOUBLE END AS auc_roc, CASE WHEN max(pos) = 0 THEN 0.0 WHEN max(neg) = 0 THEN 1.0 ELSE round(sum(pr), 6) END AS auc_pr FROM st {group}"""
query("curve_points", _CURVE.format(by="", part="1") + " SELECT score, pos, neg, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM cv")(
    lambda c: evaluate.curve(c.scored).select("score", "pos", "neg", *[F.round(x, 6).alias(x) for x in ("tpr", "fpr", "precision")])
)
query("auc_roc_pr", (_CURVE + _AUC).format(by="", part="1", group=""))(lambda c: evaluate.auc(c.scored))
query("auc_by_fold", (_CURVE + _AUC).format(by="fold,", part="fold", group="GROUP BY fold"))(lambda c: evaluate.auc(c.scored, ("fold",)))
_TH = (0.2, 0.4, 0.5, 0.6, 0.8)
query(
    "metrics_at_thresholds",
    f", g AS (SELECT threshold, count(*) AS total, count_if(is_fraud)::BIGINT AS fraud, count_if(score >= threshold)::BIGINT AS alerts, count_if(score >= threshold AND is_fraud)::BIGINT AS tp FROM sc, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _TH)}]) AS threshold) GROUP BY threshold), m AS (SELECT *, alerts - tp AS fp, fraud - tp AS fn, total - alerts - fraud + tp AS tn FROM g)" + _TOTAL[_TOTAL.index("\nSELECT") :],
)(lambda c: evaluate.threshold_metrics(c.scored, list(_TH)))
_TESTED = ("f1", "precision", "recall", "auc_roc", "auc_pr")
query(
    "significance",
    ", l AS (" + " UNION ALL ".join(f"SELECT detection_config AS cfg, list_position(['RULES_ONLY', 'ML_ONLY', 'FULL_SYSTEM'], detection_config) AS o, fold, '{m}' AS metric, {m} AS x FROM folds" for m in _TESTED) + """),
pr AS (SELECT a.metric, a.cfg AS config_a, b.cfg AS config_b, count(*) AS n, avg(a.x) AS mean_a, avg(b.x) AS mean_b, avg(a.x - b.x) AS mean_diff, stddev_samp(a.x - b.x) AS sd, max(abs(a.x - b.x)) AS most, bool_or(isnan(a.x) OR isnan(b.x)) AS odd FROM l a JOIN l b ON a.fold = b.fold AND a.metric = b.metric AND a.o < b.o GROUP BY ALL),
tt AS (SELECT *, CASE WHEN odd THEN NULL WHEN most = 0 THEN 0.0 ELSE mean_diff / (sd / sqrt(n)) END AS t FROM pr),
pp AS (SELECT *, CASE WHEN odd THEN NULL WHEN most = 0 THEN 1.0 ELSE 1 - sin(atan(abs(t) / 2)) * (1 + 0.5 * power(cos(atan(abs(t) / 2)), 2)) END AS p FROM tt)
SELECT metric, config_a, config_b, n, CASE WHEN NOT odd THEN round(mean_a, 6) END AS mean_a, CASE WHEN NOT odd THEN round(mean_b, 6) END AS mean_b, CASE WHEN NOT odd THEN round(mean_diff, 6) END AS mean_diff, round(t, 4) AS t, round(p, 6) AS p,
  round(0.05::DOUBLE / 3, 6) AS alpha_corrected, coalesce(most > 0 AND p < 0.05 / 3, false) AS significant, CASE WHEN odd THEN 'NaN values in metric' WHEN most = 0 THEN 'zero variance' END AS skip_reason FROM pp""",
)(lambda c: evaluate.significance(c.measured, _TESTED, order=detect.CONFIGS))

# retrieval
query(
    "vector_topk",
    """, n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.e, d.e) / (q.m * d.m) AS x FROM n q, n d WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id))::INT AS rank, round(x, 5) AS similarity FROM s)
SELECT * FROM r WHERE rank <= 5""",
)(
    lambda c: retrieval.vector_topk(
        c.raw("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), c.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    )
)

# imports: raw rows derived from the payments, with faults planted by id
_RAW = """SELECT id AS row_num, CAST(id % 800 - 10 AS VARCHAR(20)) AS step, CASE WHEN id % 37 = 0 THEN 'BARTER' ELSE transaction_type END AS type,
CASE WHEN id % 41 = 0 THEN 'n/a' WHEN id % 43 = 0 THEN '-5.00' ELSE CAST(amount AS VARCHAR(30)) END AS amount,
CASE WHEN id % 53 = 0 THEN ' ' ELSE sender_account END AS nameOrig, '1.00' AS oldbalanceOrg, '1.00' AS newbalanceOrig, receiver_account AS nameDest, '1.00' AS oldbalanceDest, '1.00' AS newbalanceDest,
CASE WHEN is_fraud THEN '1' ELSE '0' END AS isFraud, '0' AS isFlaggedFraud FROM {t}"""
_REASON = "CASE WHEN row_num % 41 = 0 THEN 'unparsable' WHEN step::INT NOT BETWEEN 0 AND 744 THEN 'step out of range' WHEN amount::DECIMAL(18,2) < 0 THEN 'negative amount' WHEN type = 'BARTER' THEN 'unknown type' WHEN trim(nameOrig) = '' THEN 'blank account' END"
_VALID = f", raw AS ({_RAW.format(t='tx0')}), val AS (SELECT *, {_REASON} AS reason FROM raw)"
_EXT = "'PAYSIM-' || step || '-' || nameOrig || '-' || nameDest || '-' || amount"


def _validated(c: Canonical) -> DataFrame:
    return imports.validate(c.spark.sql(_RAW, t=c.tx0))


def _from_files(c: Canonical) -> DataFrame:
    """The raw rows written as CSV files and read back: typed payments."""
    path = shared_path(c.spark, "raw")
    c.spark.sql(_RAW, t=c.tx0).select(*imports.COLUMNS).write.option("header", True).csv(path)
    return imports.typed(imports.validate(imports.read_raw(c.spark, path)))


query(
    "src_transactions",
    _VALID + f""" SELECT {_EXT} AS external_id, TIMESTAMP '2025-01-01 00:00:00' + to_hours(step::INT) AS timestamp, nameOrig AS sender_account, nameDest AS receiver_account, type AS transaction_type,
amount::DECIMAL(18,2) AS amount, 1::DECIMAL(18,2) AS sender_balance_before, isFraud = '1' AS is_fraud FROM val WHERE reason IS NULL""",
)(lambda c: _from_files(c).drop("row_num"))


query("import_validate", _VALID + " SELECT row_num, reason FROM val")(lambda c: _validated(c).select("row_num", "reason"))
query("import_report", _VALID + " SELECT coalesce(reason, 'imported') AS reason, count(*) AS n FROM val GROUP BY 1")(lambda c: imports.import_report(_validated(c)))
query("import_errors", _VALID + " SELECT row_num, reason FROM val WHERE reason IS NOT NULL ORDER BY row_num LIMIT 100")(lambda c: imports.import_errors(_validated(c)))
query("import_typed", _VALID + f" SELECT row_num, {_EXT} AS external_id, TIMESTAMP '2025-01-01 00:00:00' + to_hours(step::INT) AS timestamp, amount::DECIMAL(18,2) AS amount FROM val WHERE reason IS NULL")(
    lambda c: imports.typed(_validated(c)).select("row_num", "external_id", "timestamp", "amount")
)


def _twice(c: Canonical) -> DataFrame:
    rows = written(imports.typed(_validated(c)).select("row_num", "external_id"), "typed")  # read by each branch below
    again = rows.where("row_num % 5 = 0").withColumn("row_num", F.col("row_num") + 1_000_000_000)
    return imports.dedup_new(rows.unionByName(again), rows.where("row_num % 3 = 0")).select("row_num", "external_id")


_DEDUP = _VALID + f", e AS (SELECT row_num, {_EXT} AS external_id FROM val WHERE reason IS NULL), every AS (SELECT * FROM e UNION ALL SELECT row_num + 1000000000, external_id FROM e WHERE row_num % 5 = 0) SELECT min(row_num) AS row_num, external_id FROM every WHERE external_id NOT IN (SELECT external_id FROM e WHERE row_num % 3 = 0) GROUP BY external_id"
query("import_dedup", _DEDUP)(_twice)
query("import_dedup_bucketed", _DEDUP)(stores._bucketed)
