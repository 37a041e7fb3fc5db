"""Queries over stored tables: indexes, states, buckets, changed partitions, and what is retrieved for alerts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import context, detect, experiments, explain, features, lookups, models, rules, search_index, split, vector_index
from tallyfold.operators.state import FeatureState
from tallyfold.plans.canonical import Canonical
from tallyfold.plans.register import query
from tallyfold.plans.report_oracles import ORACLES as REPORTS
from tallyfold.plans.reports import _statuses
from tallyfold.plans.workflows import _JOINED, _LINES, _history, _library, _test_rows, _trained, _with_payment
from tallyfold.session import shared_path, written
from tallyfold.sources import bucketed, imports, stored, tables

# vectors
_NEAR = """, n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.e, d.e) / (q.m * d.m) AS x FROM n q, n d WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id))::INT AS rank, round(x, 5) AS similarity FROM s) SELECT * FROM r WHERE rank <= 5"""


def _searched(c: Canonical, exact: bool) -> DataFrame:
    vectors = c.raw("embeddings")
    index = vector_index.build(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"))
    return vector_index.search(index, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), exact=exact)


query("vector_index_topk")(lambda c: _searched(c, False))
query("vector_index_exact", _NEAR)(lambda c: _searched(c, True))

# retrieval: one search for each question
_TEXT = "concat_ws(chr(10) || chr(10), 'Fraud Pattern: ' || title, 'Type: ' || patternType, 'Description: ' || patternType || ' by ' || title, 'Key Indicators:' || chr(10) || '- ' || patternType)"
_ASKED = f"concat_ws(' ', CASE WHEN trim(rule_triggered) <> '' THEN list_aggregate(list_transform(string_split(rule_triggered, ';'), lambda p: lower(replace(trim(string_split(p, ':')[1]), '_', ' '))), 'string_agg', ' ') END, lower(replace(transaction_type, '_', ' ')), '{explain.QUERY_SUFFIX}')"
_VECTOR = f"list_transform(range({context.WIDTH}), lambda i: len(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {context.WIDTH}), lambda p: p = i))::DOUBLE)"
_CONTEXT = f""", pt AS (SELECT text, {_VECTOR} AS e FROM (SELECT {_TEXT} AS text FROM pat) x), asks AS (SELECT a.id, {_ASKED} AS query_text {_JOINED}),
dq AS (SELECT text, {_VECTOR} AS q FROM (SELECT DISTINCT query_text AS text FROM asks) x),
sims AS (SELECT dq.text AS query_text, pt.text, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS s FROM dq, pt),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY s DESC, text) AS k FROM sims),
ctx AS (SELECT query_text, string_agg(chr(10) || '{explain.KNOWN_PATTERN}' || k || chr(10) || text, chr(10) ORDER BY k) AS context FROM rk WHERE k <= 5 GROUP BY query_text)"""


def _patterns(c: Canonical) -> DataFrame:
    return tables.seed_patterns(_library(c), _library(c).limit(0))


query("rag_context", _CONTEXT + " SELECT id, context FROM asks LEFT JOIN ctx USING (query_text)")(lambda c: context.with_context(_with_payment(c), _patterns(c)).select("id", "context"))
query(
    "prompt_context",
    _CONTEXT
    + f""" SELECT a.id, concat_ws(chr(10), '## Transaction Details', {', '.join(_LINES)}, CASE WHEN context IS NOT NULL THEN chr(10) || '{explain.KNOWN_HEADING}' END, context, CASE WHEN context IS NOT NULL THEN chr(10) || '{explain.KNOWN_CLOSING}' END) AS prompt
{_JOINED} JOIN asks ON asks.id = a.id LEFT JOIN ctx USING (query_text)""",
)(lambda c: explain.prompt_table(context.with_context(_with_payment(c), _patterns(c))).select("id", "prompt"))


# state
def _from_state(c: Canonical) -> DataFrame:
    """The payments in three increments by time, each from the state that the ones before left."""
    state = FeatureState(c.spark, shared_path(c.spark, "state"))
    rows = written(c.tx0, "payments")
    cuts = [split.cutoff(rows, share) for share in (0.4, 0.7)]
    part = reduce(lambda n, cut: n + F.when(features.micros() >= cut, 1).otherwise(0), [x for x in cuts if x is not None], F.lit(0))
    names = [n for n in features.FEATURE_NAMES if n != "amount"]
    found = [state.advance(rows.where(part == k), k) for k in range(3)]
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias("transaction_id"), *names)


query("features_from_state", "SELECT * FROM feats")(_from_state)

# ranges of accounts
_RANGES = ", asked AS (SELECT id AS asked_id, sender_account AS account, timestamp - to_days((id % 9)::INT) AS start, timestamp AS \"end\" FROM tx0 WHERE id % 10 = 7)"


def _asked(c: Canonical) -> DataFrame:
    rows = c.tx0.where("id % 10 = 7")
    return rows.select(F.col("id").alias("asked_id"), F.col("sender_account").alias("account"), F.expr("timestamp - make_dt_interval(CAST(id % 9 AS INT))").alias("start"), F.col("timestamp").alias("end"))


query("sender_ranges", _RANGES + ' SELECT asked_id, t.id, t.receiver_account, t.amount FROM asked JOIN tx0 t ON t.sender_account = account AND t.timestamp BETWEEN start AND "end"')(
    lambda c: lookups.in_ranges(c.tx0, _asked(c)).select("asked_id", "id", "receiver_account", "amount")
)
query(
    "sender_range_statistics",
    _RANGES
    + ', ranges AS (SELECT DISTINCT account, start, "end" FROM asked) SELECT account, start, "end", count(t.id) AS n, count(DISTINCT t.receiver_account) AS receivers, round(avg(t.amount::DOUBLE), 6) AS mean, round(stddev_pop(t.amount::DOUBLE), 4) AS sd FROM ranges LEFT JOIN tx0 t ON t.sender_account = account AND t.timestamp BETWEEN start AND "end" GROUP BY ALL',
)(lambda c: lookups.range_statistics(c.tx0, _asked(c)))

# stored tables that change
_BY = {"explanations": "detection_config", "alerts": "detection_config", "features": "week", "transactions": "week"}


def _store_all(c: Canonical) -> str:
    folder, week = shared_path(c.spark, "stored"), F.floor(features.micros() / features.BLOCK).cast("long")
    base = c.base  # alerts and payments are taken from it, too
    paid = base.select(*c.tx0.columns)
    c.alerts.write.partitionBy("detection_config").parquet(f"{folder}/alerts")
    c.expl.write.partitionBy("detection_config").parquet(f"{folder}/explanations")
    base.withColumn("week", week).select(F.col("id").alias("transaction_id"), "amount_zscore", "week").write.partitionBy("week").parquet(f"{folder}/features")
    paid.withColumn("week", week).write.partitionBy("week").parquet(f"{folder}/transactions")
    paid.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/snapshots")
    return folder


def _updated(c: Canonical) -> DataFrame:
    path = shared_path(c.spark, "alerts")
    c.alerts.write.partitionBy("detection_config").parquet(path)
    stored.update_status(c.spark, path, _statuses(c))
    return c.spark.read.parquet(path).select("id", "status")


def _left(c: Canonical, folder: str) -> DataFrame:
    ids = {"features": "transaction_id", "alerts": "id", "explanations": "id", "transactions": "id"}
    return reduce(DataFrame.unionByName, [c.spark.read.parquet(f"{folder}/{t}").select(F.lit(t).alias("name"), F.col(i).alias("id")) for t, i in ids.items()])


def _deleted(c: Canonical) -> DataFrame:
    folder = _store_all(c)
    stored.delete_transactions(c.spark, folder, c.base.where("id % 3 = 0"), _BY)
    return _left(c, folder)


def _cleared(c: Canonical) -> DataFrame:
    folder = _store_all(c)
    schemas = {t: c.spark.read.parquet(f"{folder}/{t}").schema for t in (*_BY, "snapshots")}
    stored.clear(c.spark, folder, "alerts")
    return reduce(DataFrame.unionByName, [c.spark.read.schema(s).parquet(f"{folder}/{t}").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t, s in schemas.items()])


query("alert_status_stored", REPORTS["alert_status_update"])(_updated)
query(
    "delete_cascade_stored",
    "SELECT 'features' AS name, transaction_id AS id FROM feats WHERE transaction_id % 3 <> 0 UNION ALL SELECT 'alerts', id FROM alerts WHERE transaction_id % 3 <> 0 UNION ALL SELECT 'explanations', id FROM expl WHERE transaction_id % 3 <> 0 UNION ALL SELECT 'transactions', id FROM tx0 WHERE id % 3 <> 0",
)(_deleted)
query("clear_alerts", "SELECT unnest(['explanations', 'alerts', 'features', 'transactions', 'snapshots']) AS name, unnest([0, 0, n, n, 0])::BIGINT AS n FROM (SELECT count(*) AS n FROM tx0) x")(_cleared)


# buckets
def _bucketed(c: Canonical) -> DataFrame:
    from tallyfold.plans.registry import _validated

    rows, name, path = imports.typed(_validated(c)), f"tx_{uuid.uuid4().hex}", shared_path(c.spark, "bucketed")
    rows = written(rows, "typed")
    again = rows.where("row_num % 5 = 0").withColumn("row_num", F.col("row_num") + 1_000_000_000)
    bucketed.add_transactions(rows.where("row_num % 3 = 0"), name, path)
    return bucketed.add_transactions(rows.unionByName(again), name, path).select("row_num", "external_id")


def _bucketed_alerts(c: Canonical) -> DataFrame:
    rows, name, path = c.alerts.select("id", "transaction_id", "detection_config"), f"alerts_{uuid.uuid4().hex}", shared_path(c.spark, "bucketed")
    for part in (rows.where("id % 3 = 0"), rows):
        bucketed.add_alerts(part, name, path)
    return c.spark.table(name)


query("sink_alerts_bucketed", "SELECT id, transaction_id, detection_config FROM alerts")(_bucketed_alerts)


# searches
def _indexed_search(c: Canonical) -> DataFrame:
    path = shared_path(c.spark, "accounts")
    search_index.index_accounts(c.tx0, path)
    return search_index.search_by_account(c.spark, path, "C12", page=1, size=20, source="PAYSIM").select("id", "sender_account", "receiver_account", "amount")


query("tx_search_indexed", "SELECT id, sender_account, receiver_account, amount FROM tx0 WHERE dataset_source = 'PAYSIM' AND (contains(lower(sender_account), 'c12') OR contains(lower(receiver_account), 'c12')) ORDER BY id DESC LIMIT 20 OFFSET 20")(_indexed_search)


def _sorted(c: Canonical) -> str:
    path = shared_path(c.spark, "sorted")
    search_index.store_sorted(c.tx0, path, files=16)
    return path


query("tx_page_stored", "SELECT id, amount FROM tx0 WHERE is_fraud ORDER BY id DESC LIMIT 5 OFFSET 5")(lambda c: search_index.stored_page(c.spark, _sorted(c), 1, 5, where=F.col("is_fraud")).select("id", "amount"))
query("keyset_page_stored", "SELECT id, amount FROM tx0 WHERE id > 100 ORDER BY id LIMIT 500")(lambda c: search_index.page_after(c.spark, _sorted(c), 100, 500).select("id", "amount"))

# what is live, what is set
query("snapshot_live", "SELECT max(timestamp) + INTERVAL 1 DAY AS snapshot_at, count(*) AS total_transactions, count_if(is_fraud)::BIGINT AS total_fraud_tx FROM tx0")(
    lambda c: experiments.latest_snapshot(
        _history(c), c.tx0.agg((F.max("timestamp") + F.expr("INTERVAL 1 DAY")).alias("snapshot_at"), F.count(F.lit(1)).alias("total_transactions"), F.count_if("is_fraud").alias("total_fraud_tx")), c.tx0.agg(F.max("timestamp") + F.expr("INTERVAL 1 DAY")).scalar()
    )
)


def _thresholds(c: Canonical) -> DataFrame:
    """Thresholds stored, one updated to the largest payment, one reset, stored again."""
    first = written(c.thresholds, "thresholds")
    changed = rules.update_threshold(first, "LARGE_TRANSACTION", float(c.tx0.agg(F.max("amount")).first()[0]))
    return rules.threshold_view(written(rules.reset_thresholds(changed, "NEW_RECEIVER_HIGH_VALUE"), "thresholds"))


query(
    "rule_thresholds_stored",
    """SELECT rule_name, current_value::DOUBLE AS current_value, default_value::BIGINT AS default_value, current_value = default_value AS at_default, current_value < low OR current_value > high AS outside_range
FROM (SELECT 'LARGE_TRANSACTION' AS rule_name, max(amount)::DECIMAL(19,4) AS current_value, 1000000 AS default_value, 10000 AS low, 10000000 AS high FROM tx0 UNION ALL SELECT * FROM (VALUES ('NEW_RECEIVER_HIGH_VALUE', 500000, 500000, 1000, 100000), ('RAPID_VELOCITY', 2, 3, 2, 20), ('STRUCTURING', 10000, 10000, 5000, 10000)) y) x""",
)(_thresholds)


# alerts of trained models
def _model_scores(c: Canonical) -> DataFrame:
    return models.score(_test_rows(c), _trained(c)[1])


query("detect_ml_trained")(lambda c: detect.detect_ml(c.rows.where("NOT is_training_set"), _model_scores(c).select("id", "risk_score")))
query("detect_full_trained")(lambda c: detect.detect_full(c.rows.where("NOT is_training_set"), _model_scores(c).select("id", "risk_score"), c.thresholds))
