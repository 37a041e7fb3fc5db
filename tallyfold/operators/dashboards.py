"""Dashboards, breakdowns, health checks and comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.ranking import percentiles

DIMS = ("completeness", "correctness", "actionability", "regulatory")


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """part of whole in percent, half rounded up; null for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), places)


def count() -> Column:
    return F.count(F.lit(1))


def _mean(c: str, places: int = 6) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), places)


def _side_by_side(*ones: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), ones)


def all_four() -> Column:
    """The mean of the four scores where all are there."""
    return F.when(reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in DIMS]), sum((F.col(d) for d in DIMS[1:]), F.col(DIMS[0])) / 4)


def _fraud_counts(tx: DataFrame) -> DataFrame:
    return tx.agg(count().alias("transactions"), F.count_if("is_fraud").alias("fraud"))


def table_counts(tx: DataFrame, alerts: DataFrame, expl: DataFrame, patterns: DataFrame, results: DataFrame) -> DataFrame:
    """One row: transactions, fraud, alerts, explanations, patterns, results."""
    named = {"alerts": alerts, "explanations": expl, "patterns": patterns, "results": results}
    return _side_by_side(_fraud_counts(tx), *[df.agg(count().alias(n)) for n, df in named.items()])


def overview(tx: DataFrame, alerts: DataFrame, expl: DataFrame, patterns: DataFrame, results: DataFrame) -> DataFrame:
    return table_counts(tx, alerts, expl, patterns, results).withColumn("fraud_pct", percent(F.col("fraud"), F.col("transactions")))


def metric_snapshot(tx: DataFrame, alerts: DataFrame, expl: DataFrame, patterns: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """One row of counts to be appended to the snapshots, taken at `at`."""
    names = {"transactions": "total_transactions", "fraud": "total_fraud_tx", "alerts": "total_alerts", "explanations": "total_explanations", "patterns": "total_fraud_patterns", "results": "total_experiments"}
    return table_counts(tx, alerts, expl, patterns, results).select(at.cast("timestamp_ntz").alias("snapshot_at"), *[F.col(c).alias(n) for c, n in names.items()])


def detection(alerts: DataFrame) -> DataFrame:
    """Anomalies by status, by configuration and in all, with their mean score; null stands for all."""
    found = alerts.where("is_anomaly").groupingSets([["status"], ["detection_config"], []], "status", "detection_config")
    return found.agg(count().alias("n"), _mean("ml_risk_score").alias("avg_score"))


def _explained() -> list[Column]:
    return [
        count().alias("n"), F.count("hallucination_free").alias("evaluated"), F.count_if(~F.col("hallucination_free")).alias("flagged"),
        _mean("latency_ms").alias("avg_latency"), F.round(F.avg(all_four()), 6).alias("avg_quality"),
    ]


def quality(expl: DataFrame) -> DataFrame:
    """Each explanation type's mean scores, counts and share of flagged among all."""
    flagged = percent(F.count_if(~F.col("hallucination_free")), count(), 6)
    return expl.groupBy("explanation_type").agg(*[_mean(d).alias(d) for d in DIMS], *_explained(), flagged.alias("flagged_pct"), _mean("confidence_score").alias("avg_confidence"))


def explanation_metrics(expl: DataFrame, by: tuple[str, ...], config: str | None = None, types: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """Counts and means of explanations by the given columns; of one configuration, of some types, of the alerts in ids (alert_id)."""
    rows = expl if config is None else expl.where(F.col("detection_config") == config)
    rows = rows.where(F.col("explanation_type").isin(*types)) if types else rows
    rows = rows if ids is None else rows.join(ids.select("alert_id").distinct(), "alert_id", "left_semi")
    return rows.groupBy(*by).agg(*_explained())


def datasets(tx: DataFrame) -> DataFrame:
    """Payments and fraud of each source that has any."""
    found = tx.groupBy(F.col("dataset_source").alias("source")).agg(count().alias("total"), F.count_if("is_fraud").alias("fraud"))
    return found.withColumn("fraud_pct", percent(F.col("fraud"), F.col("total")))


def types(tx: DataFrame) -> DataFrame:
    return tx.groupBy("transaction_type").agg(count().alias("n"))


def amount_averages(tx: DataFrame) -> DataFrame:
    amount = F.col("amount").cast("double")
    return tx.agg(F.round(F.avg(amount), 4).alias("avg_amount"), F.round(F.avg(F.when(F.col("is_fraud"), amount)), 4).alias("avg_fraud_amount"))


def quality_breakdown(expl: DataFrame) -> DataFrame:
    """Each configuration's mean of every score, the mean of those means, and how many explanations have all four."""
    means = expl.groupBy("detection_config").agg(*[F.avg(d).alias(d) for d in DIMS], F.count(all_four()).alias("scored"))
    there = F.array_compact(F.array(*DIMS))
    overall = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))
    return means.select("detection_config", *[F.round(d, 6).alias(d) for d in DIMS], F.round(overall, 6).alias("overall"), "scored")


def row_quality(expl: DataFrame) -> DataFrame:
    """Each explanation's mean of the scores that it has."""
    there = F.array_compact(F.array(*DIMS))
    return expl.select("id", F.when(F.size(there) > 0, F.round(F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there), 6)).alias("quality"))


def cost_breakdown(expl: DataFrame) -> DataFrame:
    """Tokens (sums, mean of both), mean and 95th percentile (nearest rank) of latency by configuration."""
    tokens = (F.col("prompt_tokens") + F.col("completion_tokens")).cast("double")
    high = percentiles(expl, ("detection_config",), "latency_ms", 0.95, "p95_latency").withColumnRenamed("detection_config", "_of")
    sums = expl.groupBy("detection_config").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.avg(tokens), 6).alias("avg_tokens"),
        _mean("latency_ms").alias("avg_latency"),
    )
    return sums.join(high, F.col("detection_config").eqNullSafe(F.col("_of"))).drop("_of")


def hallucination_breakdown(flagged: DataFrame) -> DataFrame:
    """How often each flag was raised by configuration. flagged: detection_config, flags (array of names, after which details may follow)."""
    each = flagged.select("detection_config", F.explode("flags").alias("f"))
    return each.groupBy("detection_config", F.substring_index("f", ":", 1).alias("flag")).agg(count().alias("n"))


def pending_stats(tx: DataFrame, feats: DataFrame) -> DataFrame:
    found = _side_by_side(tx.agg(count().alias("total")), feats.agg(count().alias("with_features")))
    return found.withColumn("pending", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("with_features")))


def risk_bands(alerts: DataFrame) -> DataFrame:
    """Alerts by configuration and band of score: below 0.4 low, below 0.7 medium, else high; null without a score."""
    s = F.col("ml_risk_score")
    band = F.when(s < 0.4, "low").when(s < 0.7, "medium").when(s.isNotNull(), "high")
    return alerts.groupBy("detection_config", band.alias("band")).agg(count().alias("n"))


def data_quality(tx: DataFrame, feats: DataFrame, alerts: DataFrame, expl: DataFrame, patterns: DataFrame) -> DataFrame:
    """check_id, category, severity, overall (the worst of all): seven checks of the tables, each table read once."""
    one = _side_by_side(
        tx.agg(count().alias("t"), F.count_if("is_fraud").alias("fraud"), F.count_if("is_training_set").alias("train")),
        feats.agg(count().alias("f")), alerts.agg(count().alias("a")), patterns.agg(count().alias("k")),
        expl.agg(count().alias("e"), F.count("hallucination_free").alias("evaluated"), F.count("completeness").alias("scored")),
    )
    c = {n: F.col(n) for n in one.columns}
    test = c["t"] - c["train"]
    rules = {
        ("transactions", "Data"): F.when((c["t"] == 0) | (c["fraud"] == 0), "FAIL").when(c["fraud"] * 5 > c["t"], "WARN"),
        ("features-coverage", "Data"): F.when(c["t"] == 0, "WARN").when(c["f"] == 0, "FAIL").when(c["f"] < c["t"], "WARN"),
        ("train-test-split", "Data"): F.when(c["t"] == 0, "WARN").when((c["train"] == 0) | (test == 0), "FAIL").when(~(test * 100).between(c["t"] * 10, c["t"] * 30), "WARN"),
        ("alerts", "Results"): F.when(c["a"] == 0, "WARN"),
        ("explanations", "Results"): F.when(c["a"] == 0, "PASS").when((c["e"] == 0) | (c["evaluated"] * 2 < c["e"]), "WARN"),
        ("cakr-coverage", "Results"): F.when(c["e"] == 0, "PASS").when(c["scored"] * 2 < c["e"], "WARN"),
        ("knowledge-base", "LLM"): F.when(c["k"] < 5, "WARN"),
    }
    checks = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(g).alias("category"), F.coalesce(s, F.lit("PASS")).alias("severity")) for (i, g), s in rules.items()])
    has = lambda v: F.exists("checks", lambda x: x["severity"] == v)
    judged = one.select(checks.alias("checks")).withColumn("overall", F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").otherwise("PASS"))
    return judged.select(F.explode("checks").alias("c"), "overall").select("c.*", "overall")


# experiments


def experiments(results: DataFrame, name: str | None = None, columns: tuple[str, ...] = ("precision", "recall", "f1", "fpr", "auc_roc", "auc_pr")) -> DataFrame:
    """Result rows of one experiment or all, metrics in 4 decimals."""
    rows = results if name is None else results.where(F.col("experiment_name") == name)
    return rows.select("experiment_name", "detection_config", "fold", *[F.round(c, 4).alias(c) for c in columns])


def experiment_names(results: DataFrame) -> DataFrame:
    return results.select("experiment_name").distinct().orderBy("experiment_name")


#: Metrics of which a table names the best, and whether more is better.
BEST = {"f1": True, "quality": True, "fpr": False, "hallucination_rate": False}


def winners(results: DataFrame, best: dict[str, bool] | None = None) -> DataFrame:
    """metric, detection_config, value of the best summary row of each metric; nulls don't take part, ties go by configuration.

    One pass: each metric is a minimum of (signed value, configuration, fold) over the rows.
    """
    best = BEST if best is None else best
    whole = results.where("fold IS NULL")
    keys = [F.min(F.when(F.col(m).isNotNull(), F.struct((F.col(m) * (-1 if more else 1)).alias("v"), "detection_config"))).alias(m) for m, more in best.items()]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.detection_config"), (F.col(f"{m}.v") * (-1 if more else 1)).alias("value")) for m, more in best.items()])
    return whole.agg(*keys).select(F.explode(each).alias("w")).select("w.*").where("value IS NOT NULL")


def compare_view(results: DataFrame, name: str | None = None) -> DataFrame:
    """The summary rows of an experiment if it has any, else all its rows."""
    rows = results if name is None else results.where(F.col("experiment_name") == name)
    return rows.withColumn("_has", F.max(F.col("fold").isNull()).over(Window.partitionBy("experiment_name"))).where(F.col("fold").isNull() | ~F.col("_has")).drop("_has")


#: Metrics of the comparison, and whether more is better.
COMPARED = {"precision": True, "recall": True, "f1": True, "fpr": False}


def comparison_pivot(results: DataFrame, configs: tuple[str, ...], compared: dict[str, bool] | None = None) -> DataFrame:
    """metric, a column for each configuration (in lower case) and its difference to the first one (_delta), and the winner (ties go
    by the order of configs) of the summary rows."""
    compared = COMPARED if compared is None else compared
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(more).alias("more"), F.col(m).alias("value")) for m, more in compared.items()])
    long = results.where("fold IS NULL").select("detection_config", F.explode(pairs).alias("m")).select("detection_config", "m.*")
    wide = long.groupBy("metric", "more").agg(*[F.max(F.when(F.col("detection_config") == c, F.col("value"))).alias(c.lower()) for c in configs])
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c.lower()).isNotNull(), F.struct((F.col(c.lower()) * F.when(F.col("more"), -1).otherwise(1)).alias("v"), F.lit(k).alias("k"), F.lit(c).alias("c"))) for k, c in enumerate(configs)])))
    deltas = [F.round(F.col(c.lower()) - F.col(configs[0].lower()), 6).alias(f"{c.lower()}_delta") for c in configs[1:]]
    return wide.select("metric", *[c.lower() for c in configs], *deltas, F.get(ranked, F.lit(0))["c"].alias("winner"))


# exports


def alerts_csv(alerts: DataFrame, config: str | None = None) -> DataFrame:
    """Alerts by id as they are exported: all, or the anomalies of one configuration; scores in 6 decimals, blanks for nulls."""
    rows = alerts if config is None else alerts.where((F.col("detection_config") == config) & F.col("is_anomaly"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    score = blank(F.format_string("%.6f", F.col("ml_risk_score")))
    return rows.select("id", "transaction_id", "detection_config", blank(F.col("rule_triggered")).alias("rule_triggered"), F.when(F.col("ml_risk_score").isNull(), "").otherwise(score).alias("score"), "status").orderBy("id")


def experiments_csv(results: DataFrame, name: str | None = None) -> DataFrame:
    """Result rows as they are exported: 0 for null metrics, blanks for the optional columns."""
    rows = results if name is None else results.where(F.col("experiment_name") == name)
    needed = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "auc_roc", "auc_pr", "fpr")]
    optional = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("quality", "hallucination_rate")]
    return rows.select("experiment_name", "detection_config", F.coalesce(F.col("fold").cast("string"), F.lit("")).alias("fold"), *needed, *optional).orderBy("experiment_name", "detection_config", "fold")


def report_tables(results: DataFrame, expl: DataFrame, flagged: DataFrame, name: str) -> dict[str, DataFrame]:
    """The tables of an experiment's report: folds, summary, winners, and breakdowns of quality, cost and hallucinations."""
    own = results.where(F.col("experiment_name") == name)
    return {
        "folds": experiments(own.where("fold IS NOT NULL")), "summary": experiments(own.where("fold IS NULL")), "winners": winners(own),
        "quality": quality_breakdown(expl), "cost": cost_breakdown(expl), "hallucinations": hallucination_breakdown(flagged),
    }
