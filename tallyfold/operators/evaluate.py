"""Confusion metrics, tie-aware curves, folds and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.ranking import running


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """counts (…, total, fraud, alerts, tp) with fp, fn, tn (never below 0), precision, recall, f1, fpr (0 for 0/0)."""
    zero = F.lit(0).cast("long")
    c = counts.withColumn("fp", F.greatest(zero, F.col("alerts") - F.col("tp"))).withColumn("fn", F.greatest(zero, F.col("fraud") - F.col("tp")))
    c = c.withColumn("tn", F.greatest(zero, F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return (
        c.withColumn("precision", _share(tp, tp + fp))
        .withColumn("recall", _share(tp, tp + fn))
        .withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))
        .withColumn("fpr", _share(fp, fp + tn))
    )


def counts(split: DataFrame, alerts: DataFrame, by_fold: bool = False) -> DataFrame:
    """detection_config(, fold), total, fraud, alerts, tp over the test rows; one pass over each table."""
    keys = ["fold"] if by_fold else []
    test = split.where("NOT is_training_set")
    sizes = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_fraud").alias("fraud"))
    hits = alerts.where("is_anomaly").join(test.select(F.col("id").alias("transaction_id"), "is_fraud", *keys), "transaction_id")
    hits = hits.groupBy("detection_config", *keys).agg(F.count(F.lit(1)).alias("alerts"), F.count_if("is_fraud").alias("tp"))
    return hits.join(F.broadcast(sizes), keys) if keys else hits.crossJoin(F.broadcast(sizes))


def threshold_metrics(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """scored (score, is_fraud): metrics at each threshold, by one aggregate."""
    marks = F.array(*map(F.lit, thresholds))
    each = scored.select("is_fraud", "score", F.explode(marks).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    return metrics(each.groupBy("threshold").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_fraud").alias("fraud"), F.count_if(hit).alias("alerts"), F.count_if(hit & F.col("is_fraud")).alias("tp")))


def _points(scored: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, score, p, n (rows of that score by label), tp, fp (so far, from the highest score down), pos, neg (in all)."""
    ties = scored.groupBy(*by, "score").agg(F.count_if("is_fraud").alias("p"), F.count_if(~F.col("is_fraud")).alias("n"))
    summed = running(ties, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}, by)
    whole = scored.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.count_if("is_fraud").alias("pos"), F.count_if(~F.col("is_fraud")).alias("neg"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return summed.join(F.broadcast(whole), same).select(*summed.columns, "pos", "neg")  # one row, or one for each group


def curve(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The polyline of ROC and precision-recall: a point for each distinct score, from the highest down."""
    tp, fp = F.col("tp"), F.col("fp")
    return _points(scored, by).select(*by, "score", "pos", "neg", (tp / F.nullif("pos", F.lit(0))).alias("tpr"), (fp / F.nullif("neg", F.lit(0))).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoid areas. One class only: ROC NaN; PR 0 without positives, 1 without negatives."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    seen = tp + fp - p - n  # rows before this score; there precision is 1 if there are none
    steps = _points(scored, by).select(
        *by, "pos", "neg", (n * (2 * tp - p) / 2.0).alias("roc"), (p * (tp / (tp + fp) + F.when(seen > 0, (tp - p) / seen).otherwise(1.0)) / 2).alias("pr")
    )
    pos, neg = F.max("pos"), F.max("neg")
    roc = F.when((pos > 0) & (neg > 0), F.round(F.sum("roc") / pos / neg, 6)).otherwise(F.lit(float("nan")))
    pr = F.when(pos == 0, 0.0).when(neg == 0, 1.0).otherwise(F.round(F.sum("pr") / pos, 6))
    return steps.groupBy(*by).agg(roc.alias("auc_roc"), pr.alias("auc_pr"))


def kfold_summary(folds: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows of each fold, and one per configuration (fold null) with mean and sample deviation (0 for one fold)."""
    n = lambda m: F.count(m)
    summary = folds.groupBy("detection_config").agg(
        *[F.round(F.avg(m), 6).alias(m) for m in names], *[F.when(n(m) > 1, F.round(F.stddev_samp(m), 6)).otherwise(F.lit(0.0)).alias(f"{m}_std") for m in names]
    )
    rows = folds.select("detection_config", "fold", *names, *[F.lit(None).cast("double").alias(f"{m}_std") for m in names])
    return rows.unionByName(summary.withColumn("fold", F.lit(None).cast("int")))


def student_p(t: Column, nu: Column) -> Column:
    """Two-sided p-value of Student's t with whole degrees of freedom: the finite series of the distribution."""
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    sine, cosine = F.sin(theta), F.cos(theta)

    def series(first: Column, odd: int) -> Column:
        steps = F.floor((nu - 2 - odd) / 2).cast("int")
        start = F.struct(first.alias("term"), first.alias("sum"))

        def step(s: Column, k: Column) -> Column:
            factor = (2 * k - (0 if odd else 1)) / (2 * k + (1 if odd else 0)) * cosine * cosine
            return F.struct((s["term"] * factor).alias("term"), (s["sum"] + s["term"] * factor).alias("sum"))

        ks = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(ks, start, step, lambda s: s["sum"])

    even = 1 - sine * series(F.lit(1.0), 0)
    odd = 1 - 2 / F.pi() * (theta + F.when(nu > 1, sine * series(cosine, 1)).otherwise(0.0))
    return F.when(nu % 2 == 0, even).otherwise(odd)


def significance(folds: DataFrame, names: tuple[str, ...], alpha: float = 0.05, order: tuple[str, ...] = ()) -> DataFrame:
    """Paired t-tests of every two configurations and each metric over the folds, at alpha over the number of pairs.

    skip_reason: no test if the configurations have other numbers of folds, or a null or NaN among them; t 0 and p 1 if no
    fold differs. Pairs are in the given order of configurations, others after them by name. Rows: pairs times metrics.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("detection_config")), F.lit(0)) if order else F.lit(0)
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1), "detection_config")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in names])
    long = folds.where("fold IS NOT NULL").select("detection_config", "fold", rank.alias("rank"), F.explode(values).alias("m"))
    # a configuration's folds of one metric are a short list: pairs are made of lists, and folds are read once
    lists = long.groupBy("m.metric", "detection_config", "rank").agg(F.array_sort(F.collect_list(F.struct("fold", F.col("m.x").alias("x")))).alias("xs"))
    every = lists.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("rank", "detection_config", "xs"))).alias("c"))
    pairs = every.select("metric", (F.size("c") * (F.size("c") - 1) / 2).alias("pairs"), F.posexplode("c").alias("i", "a"), "c").select("metric", "pairs", "a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    x = lambda c: F.transform(F.col(c)["xs"], lambda s: s["x"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    bad = lambda xs: F.exists(xs, lambda v: v.isNull() | F.isnan(v))
    p = pairs.select("metric", "pairs", F.col("a.detection_config").alias("config_a"), F.col("b.detection_config").alias("config_b"), x("a").alias("a"), x("b").alias("b"))
    uneven, odd = F.size("a") != F.size("b"), F.coalesce(bad(F.col("a")) | bad(F.col("b")), F.lit(True))
    p = p.withColumn("skip_reason", F.when(uneven, "fold-count mismatch or empty").when(odd, "NaN values in metric"))
    usable = F.col("skip_reason").isNull()
    p = p.withColumn("d", F.when(usable, F.zip_with("a", "b", lambda u, v: u - v))).withColumn("n", F.size("a").cast("long"))
    mean = lambda c: F.when(usable, total(F.col(c)) / F.col("n"))
    p = p.withColumn("mean_a", mean("a")).withColumn("mean_b", mean("b")).withColumn("mean_diff", mean("d"))
    spread = F.aggregate(F.transform("d", lambda v: F.pow(v - F.col("mean_diff"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    p = p.withColumn("sd", F.when(usable & (F.col("n") > 1), F.sqrt(spread / (F.col("n") - 1))))
    flat = usable & ~F.coalesce(F.exists("d", lambda v: v != 0), F.lit(False))
    p = p.withColumn("skip_reason", F.when(flat, "zero variance").when(usable & (F.col("n") < 2), "fewer than two folds").otherwise(F.col("skip_reason")))
    tested = F.col("skip_reason").isNull()
    still = F.col("skip_reason") == "zero variance"
    t = F.when(still, 0.0).when(tested & (F.col("sd") == 0), F.signum("mean_diff") * float("inf")).when(tested, F.col("mean_diff") / (F.col("sd") / F.sqrt("n")))
    p = p.withColumn("t", t)
    value = F.when(still, 1.0).when(tested & (F.col("sd") == 0), 0.0).when(tested, student_p(F.col("t"), F.col("n") - 1))
    p = p.withColumn("p", value).withColumn("alpha_corrected", F.lit(alpha) / F.col("pairs"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff")]
    return p.select(
        "metric", "config_a", "config_b", "n", *rounded, F.round("t", 4).alias("t"), F.round("p", 6).alias("p"), F.round("alpha_corrected", 6).alias("alpha_corrected"),
        F.coalesce(tested & (F.col("p") < F.col("alpha_corrected")), F.lit(False)).alias("significant"), "skip_reason",
    )
