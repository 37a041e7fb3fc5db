"""Queries of models, experiments, texts around explanations, and tables that are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import dashboards, experiments, explain, features, models, split
from tallyfold.plans.canonical import METRICS, Canonical
from tallyfold.plans.register import query
from tallyfold.plans.report_oracles import AMOUNT, FLAGGED
from tallyfold.plans.report_oracles import ORACLES as REPORTS
from tallyfold.session import shared_path, written
from tallyfold.sources import tables

# models
LEGIT, TREES, DEPTH, ROUNDS = 200_000, 50, 5, 100


def _training_rows(c: Canonical) -> DataFrame:
    return written(features.numbers(split.training_sample(c.base, LEGIT)), "training")  # read by every training job


def _test_rows(c: Canonical) -> DataFrame:
    return features.numbers(c.base.where("NOT is_training_set"))


def _trained(c: Canonical) -> tuple[DataFrame, dict]:
    rows = _training_rows(c)
    return rows, models.train(rows, TREES, DEPTH, ROUNDS)


query(
    "ml_train",
    f"SELECT fraud + least(legit, {LEGIT}) AS n_rows, fraud AS n_fraud, least(legit, {LEGIT}) AS n_legit, {TREES}::INT AS trees, {ROUNDS}::INT AS rounds FROM (SELECT count_if(is_fraud)::BIGINT AS fraud, count_if(NOT is_fraud)::BIGINT AS legit FROM tx WHERE is_training_set) x",
)(lambda c: (lambda rows, m: models.training_summary(rows).withColumns({"trees": F.lit(m[models.FOREST].getNumTrees), "rounds": F.lit(m[models.BOOSTED].getNumTrees)}))(*_trained(c)))
query("ml_score")(lambda c: models.score(_test_rows(c), _trained(c)[1]))
query("ml_importances")(lambda c: (lambda rows, m: models.importances(m, [x for x in rows.columns if x.startswith("f_")], c.spark))(*_trained(c)))


def _saved_and_loaded(c: Canonical) -> DataFrame:
    folder = shared_path(c.spark, "models")
    models.save(_trained(c)[1], folder)
    return models.score(_test_rows(c), models.load(folder))


query("ml_save_load")(_saved_and_loaded)


# experiments
_AREAS = """, tie AS (SELECT {k} AS k, score, count_if(is_fraud) AS p, count_if(NOT is_fraud) AS n FROM sc GROUP BY ALL),
cum AS (SELECT k, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY k) AS pos, sum(n) OVER (PARTITION BY k) AS neg FROM tie WINDOW d AS (PARTITION BY k ORDER BY score DESC)),
cv AS (SELECT k, score, pos, neg, tp::DOUBLE / nullif(pos, 0) AS tpr, fp::DOUBLE / nullif(neg, 0) AS fpr, tp::DOUBLE / (tp + fp) AS pc FROM cum),
st AS (SELECT k, pos, neg, (fpr - lag(fpr, 1, 0.0) OVER w) * (tpr + lag(tpr, 1, 0.0) OVER w) / 2 AS roc, (tpr - lag(tpr, 1, 0.0) OVER w) * (pc + lag(pc, 1, 1.0) OVER w) / 2 AS pr FROM cv WINDOW w AS (PARTITION BY k ORDER BY score DESC)),
areas AS (SELECT k, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(roc), 6) ELSE 'NaN'::DOUBLE END AS auc_roc, CASE WHEN max(pos) = 0 THEN 0.0 WHEN max(neg) = 0 THEN 1.0 ELSE round(sum(pr), 6) END AS auc_pr FROM st GROUP BY k)"""
_CELLS = "total, fraud, alerts, tp, fp, fn, tn"
query(
    "experiment_run",
    _AREAS.format(k="1")
    + """, x AS (SELECT count(*) AS total, count_if(is_fraud)::BIGINT AS fraud FROM tx WHERE NOT is_training_set), h AS (SELECT sum(alerts)::BIGINT AS alerts, sum(tp)::BIGINT AS tp FROM hits WHERE detection_config = 'RULES_ONLY'),
m AS (SELECT *, greatest(0, alerts - tp) AS fp, greatest(0, fraud - tp) AS fn, greatest(0, total - tp - greatest(0, alerts - tp) - greatest(0, fraud - tp)) AS tn FROM x, h)
SELECT 'RULES_ONLY' AS detection_config, total, fraud, alerts, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0.0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 6) ELSE 0.0 END AS fpr, auc_roc, auc_pr, '{"cutoff":0.5,"split":0.8}' AS run_parameters FROM m, areas""",
)(lambda c: experiments.experiment(c.judged, c.alerts, c.scored, "RULES_ONLY", F.to_json(F.struct(F.lit(0.5).alias("cutoff"), F.lit(0.8).alias("split")))))
query("benchmark_all", f"SELECT detection_config, fold, {_CELLS}, {', '.join(METRICS[:6])} FROM folds")(lambda c: experiments.benchmark(c.judged, c.alerts, c.scored))
query("run_snapshot", """SELECT *, '{"cutoff":0.5,"folds":5,"fraud":' || fraud || ',"ratio":0.8,"thresholds":{"LARGE_TRANSACTION":200000.0,"NEW_RECEIVER_HIGH_VALUE":50000.0,"RAPID_VELOCITY":2.0,"STRUCTURING":10000.0},"training":' || training || ',"transactions":' || transactions || '}' AS run_parameters
FROM (SELECT count(*) AS transactions, count_if(is_fraud)::BIGINT AS fraud, count_if(is_training_set)::BIGINT AS training FROM tx) x""")(
    lambda c: experiments.parameters(c.thresholds, c.tx, 0.8, 5, 0.5)
)

# snapshots: one for each hour of payments
_HISTORY = "SELECT date_trunc('hour', timestamp) AS snapshot_at, count(*) AS total_transactions, count(CASE WHEN is_fraud THEN 1 END) AS total_fraud_tx FROM {t} GROUP BY 1"
_NOW = "TIMESTAMP_NTZ '2024-01-10 00:00:00'"


def _history(c: Canonical) -> DataFrame:
    return c.spark.sql(_HISTORY, t=c.tx0).withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp_ntz"))


query("snapshot_history", f", s AS ({_HISTORY.format(t='tx0')}) SELECT snapshot_at::TIMESTAMP AS snapshot_at, total_transactions, total_fraud_tx FROM s WHERE snapshot_at >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 10080 MINUTE")(
    lambda c: experiments.snapshot_history(_history(c), F.expr(_NOW), 10_080)
)
query("snapshot_latest", f", s AS ({_HISTORY.format(t='tx0')}) SELECT snapshot_at::TIMESTAMP AS snapshot_at, total_transactions, total_fraud_tx FROM s ORDER BY snapshot_at DESC LIMIT 1")(
    lambda c: experiments.latest_snapshot(_history(c), _history(c).limit(0), _history(c).agg(F.max("snapshot_at")).scalar())
)

# texts
_JOINED = "FROM alerts a JOIN rows_ r ON r.id = a.transaction_id"


def _with_payment(c: Canonical) -> DataFrame:
    rows = c.rows.withColumnRenamed("id", "transaction_id")
    return c.alerts.join(rows, "transaction_id")


query(
    "rag_query_text",
    f"SELECT a.id, concat_ws(' ', CASE WHEN trim(rule_triggered) <> '' THEN list_aggregate(list_transform(string_split(rule_triggered, ';'), lambda p: lower(replace(trim(string_split(p, ':')[1]), '_', ' '))), 'string_agg', ' ') END, lower(replace(transaction_type, '_', ' ')), 'fraud anomaly suspicious transaction') AS query_text {_JOINED}",
)(lambda c: explain.retrieval_query(_with_payment(c)))
_rounded = lambda c, n: f"CASE WHEN {c} < 0 AND round({c}::DECIMAL(30,6), {n}) = 0 THEN '-' ELSE '' END || round({c}::DECIMAL(30,6), {n})::VARCHAR"
_LINES = ["'- Amount: ' || amount::VARCHAR", "'- Type: ' || transaction_type", "'- Sender: ' || sender_account", "'- Receiver: ' || receiver_account", "'- Sender Balance Before: ' || sender_balance_before::VARCHAR", "'## Computed Features'"]
_LINES += [f"'- {label}: ' || {f'{c}::VARCHAR' if places is None else _rounded(c, places)}" for c, (label, places) in explain.FEATURE_LINES.items()]
_LINES += ["'## Detection Signals'", "'- Detection Config: ' || detection_config", "'- Rules Triggered: ' || nullif(trim(rule_triggered), '')", "'- ML Risk Score: ' || round(ml_risk_score::DECIMAL(30,6), 4)::VARCHAR"]
query(
    "prompt_table",
    f"""SELECT a.id, CASE WHEN contains(coalesce(rule_triggered, ''), 'VELOCITY') OR coalesce(tx_velocity_1h > 3, false) THEN 'VELOCITY' WHEN contains(coalesce(rule_triggered, ''), 'STRUCTURING') OR coalesce(is_round_amount AND tx_velocity_24h > 2, false) THEN 'STRUCTURING'
WHEN contains(coalesce(rule_triggered, ''), 'NEW_RECEIVER') OR coalesce(is_new_receiver, false) THEN 'NEW_RECEIVER' WHEN contains(coalesce(rule_triggered, ''), 'LARGE') OR coalesce(amount_zscore > 2, false) THEN 'LARGE_AMOUNT' ELSE 'GENERIC' END AS template,
concat_ws(chr(10), '## Transaction Details', {', '.join(_LINES)}) AS prompt {_JOINED}""",
)(lambda c: explain.prompt_table(_with_payment(c)))
query(
    "validate_amount",
    f"""{AMOUNT}SELECT id, CASE WHEN trim(t) <> '' AND NOT said THEN 'AMOUNT_NOT_REFERENCED' END AS flag FROM q""",
)(lambda c: explain.validate_amount(c.expl))
query(
    "validate_accounts",
    "SELECT id, CASE WHEN regexp_matches(lower(explanation_text), 'sender|receiver|account') AND NOT contains(explanation_text, sender_account) AND NOT contains(explanation_text, receiver_account) AND regexp_matches(explanation_text, '[A-Z][0-9]{7,}') THEN 'POSSIBLE_ACCOUNT_FABRICATION' END AS flag FROM expl",
)(lambda c: explain.validate_accounts(c.expl))


def _over_explanations(c: Canonical, sql: str) -> DataFrame:
    return c.spark.sql(sql.replace("{", "{{").replace("}", "}}") + "{e}", e=c.expl)


#: Raw answers derived from the explanations, with faults planted by id; both engines read them.
_OPEN, _SHUT = "'```json\n'", "'\n```'"
_BODY = """'{"riskSummary": "', coalesce(risk_summary, ''), '", "explanation"""
_RAW = f"""SELECT id, transaction_id, risk_summary, CASE WHEN transaction_id % 20 = 19 THEN concat({_BODY}T') WHEN transaction_id % 4 = 3 THEN 'no answer' WHEN transaction_id % 4 = 2 THEN concat({_BODY}Text": "cut o')
WHEN transaction_id % 4 = 1 THEN concat({_OPEN}, {_BODY}Text": "t", "confidenceScore": 0.5}}', {_SHUT}) ELSE concat({_BODY}Text": "t"}}') END AS raw FROM """
query(
    "response_parse",
    """, o AS (SELECT id, risk_summary, CASE WHEN transaction_id % 20 = 19 THEN 'partial' WHEN transaction_id % 4 = 3 THEN 'error' WHEN transaction_id % 4 = 2 THEN 'repaired' ELSE 'parsed' END AS outcome FROM expl) SELECT id, outcome, CASE WHEN outcome <> 'error' THEN risk_summary END AS risk_summary FROM o""",
)(lambda c: explain.parse_responses(_over_explanations(c, _RAW)).select("id", "outcome", "risk_summary"))
_ANSWER = """'{"score": ', CAST(CAST(completeness + transaction_id % 2 AS INT) AS VARCHAR(9)), ', "reason": "r"}'"""
_JUDGED = f"SELECT id, CASE WHEN transaction_id % 8 = 0 THEN 'none' WHEN completeness IS NULL THEN NULL WHEN transaction_id % 3 = 0 THEN concat({_OPEN}, {_ANSWER}, {_SHUT}) ELSE concat({_ANSWER}) END AS raw FROM "
query(
    "score_parse",
    f""", j AS ({_JUDGED} expl), n AS (SELECT id, try_cast(regexp_extract(raw, '"score": ([0-9]+)', 1) AS DOUBLE) AS s FROM j) SELECT id, CASE WHEN s BETWEEN 1 AND 5 THEN s END AS score FROM n""",
)(lambda c: explain.parse_scores(_over_explanations(c, _JUDGED)))


# tables that are written
def _appended(c: Canonical) -> DataFrame:
    path = shared_path(c.spark, "transactions")
    for half in (0, 1):
        tables.append_rows(c.tx0.where(f"id % 2 = {half}"), path)
    return c.spark.read.parquet(path)


def _appended_alerts(c: Canonical) -> DataFrame:
    path = shared_path(c.spark, "alerts")
    rows = c.alerts.select("id", "transaction_id", "detection_config")
    tables.append_alerts(rows.where("id % 3 = 0"), path)
    tables.append_alerts(rows, path, c.spark.read.parquet(path))
    return c.spark.read.parquet(path)


def _exported(c: Canonical) -> DataFrame:
    folder = shared_path(c.spark, "report")
    made = dashboards.report_tables(c.results, c.expl, explain.validate(c.expl), "benchmark")
    tables.export_tables(made, folder)
    read = lambda n: c.spark.read.csv(f"{folder}/{n}", header=True, schema=made[n].schema)
    value = {"folds": "f1", "summary": "f1", "winners": "value", "quality": "overall", "cost": "avg_tokens", "hallucinations": "n"}
    return reduce(DataFrame.unionByName, [read(n).select(F.lit(n).alias("name"), "detection_config", F.col(v).cast("double").alias("value")) for n, v in value.items()])


query("sink_transactions", "SELECT * FROM tx0")(_appended)
query("sink_alerts", "SELECT id, transaction_id, detection_config FROM alerts")(_appended_alerts)
query(
    "export_report",
    FLAGGED
    + f"""SELECT CASE WHEN fold IS NULL THEN 'summary' ELSE 'folds' END AS name, detection_config, round(f1, 4) AS value FROM results WHERE experiment_name = 'benchmark'
UNION ALL SELECT 'winners', detection_config, value FROM ({REPORTS['winners']}) x UNION ALL SELECT 'quality', detection_config, overall FROM ({REPORTS['quality_breakdown']}) x
UNION ALL SELECT 'cost', detection_config, avg_tokens FROM ({REPORTS['cost_breakdown']}) x
UNION ALL SELECT 'hallucinations', detection_config, count(*)::DOUBLE FROM (SELECT detection_config, unnest(string_split(flags, ',')) AS flag FROM flagged WHERE flags <> '') x GROUP BY detection_config, flag""",
)(_exported)


def _library(c: Canonical) -> DataFrame:
    """A pattern for each rule and kind of payment that the alerts show."""
    return c.patterns.select("patternType", "title", F.concat_ws(" by ", "patternType", "title").alias("description"), F.array("patternType").alias("indicators"), F.lit(None).cast("string").alias("regulatoryReference"), F.lit(None).cast("string").alias("exampleScenario"), F.lit("alerts").alias("source"))


query(
    "seed_patterns",
    """ SELECT md5('fraud-pattern:' || title) AS doc_id, patternType, title, concat_ws(chr(10) || chr(10), 'Fraud Pattern: ' || title, 'Type: ' || patternType, 'Description: ' || patternType || ' by ' || title, 'Key Indicators:' || chr(10) || '- ' || patternType) AS text FROM pat WHERE title <> 'PAYMENT'""",
)(lambda c: tables.seed_patterns(_library(c), _library(c).where("title = 'PAYMENT'")))
query("patterns_by_type", " SELECT patternType, count(*) AS n FROM pat GROUP BY 1")(lambda c: _library(c).groupBy("patternType").agg(F.count(F.lit(1)).alias("n")))


def _purged(c: Canonical) -> DataFrame:
    left = tables.purge(c.tx.where("id % 3 <> 0"), c.feats, c.alerts, c.expl)
    ids = [left[0].select(F.lit("features").alias("name"), F.col("transaction_id").alias("id")), left[1].select(F.lit("alerts").alias("name"), "id"), left[2].select(F.lit("explanations").alias("name"), "id")]
    return ids[0].unionByName(ids[1]).unionByName(ids[2])


query(
    "delete_cascade",
    "SELECT 'features' AS name, transaction_id AS id FROM feats WHERE transaction_id % 3 <> 0 UNION ALL SELECT 'alerts', id FROM alerts WHERE transaction_id % 3 <> 0 UNION ALL SELECT 'explanations', id FROM expl WHERE transaction_id % 3 <> 0",
)(_purged)
