"""Searches and listings with optional filters, sorted and paged; maintenance as rewritten tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.features import HOUR, micros

PAGE_SIZE = 25


def paged(rows: DataFrame, order: list[Column], page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """A page of rows in a unique order, from 0."""
    if page < 0 or size < 1:
        raise ValueError("pages count from 0 and have a positive size")
    ordered = rows.orderBy(*order)
    return (ordered.offset(page * size) if page else ordered).limit(size)


def _equal(rows: DataFrame, **filters) -> DataFrame:
    """rows whose columns have the given values; those given as None are not looked at."""
    for column, value in filters.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def _window(rows: DataFrame, start: datetime.datetime | None, end: datetime.datetime | None) -> DataFrame:
    for bound, fits in ((start, lambda b: F.col("timestamp") >= b), (end, lambda b: F.col("timestamp") <= b)):
        rows = rows if bound is None else rows.where(fits(F.lit(str(bound)).cast("timestamp_ntz")))
    return rows


def search_transactions(tx: DataFrame, source: str | None = None, fraud: bool | None = None, type_: str | None = None, account: str | None = None, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Payments, latest id first; account: part of either account, in any case of letters."""
    rows = _equal(tx, dataset_source=source, is_fraud=fraud, transaction_type=type_)
    if account is not None:
        rows = rows.where(F.lower("sender_account").contains(account.lower()) | F.lower("receiver_account").contains(account.lower()))
    return paged(rows, [F.desc("id")], page, size)


def search_alerts(alerts: DataFrame, status: str | None = None, config: str | None = None, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Alerts, newest first (by id, which rises with time)."""
    return paged(_equal(alerts, status=status, detection_config=config), [F.desc("id")], page, size)


#: What a listing of explanations can be narrowed to: checked and clean, checked and flagged, never scored.
STATES = {"all": "true", "clean": "hallucination_free", "flagged": "NOT hallucination_free", "unscored": "completeness IS NULL"}


def search_explanations(expl: DataFrame, type_: str | None = None, state: str = "all", page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    return paged(_equal(expl, explanation_type=type_).where(STATES[state]), [F.desc("id")], page, size)


def high_risk_alerts(alerts: DataFrame, least: float, n: int = 100) -> DataFrame:
    """The n alerts of the highest score of at least `least`."""
    return paged(alerts.where(F.col("ml_risk_score") >= least), [F.desc("ml_risk_score"), F.col("id")], size=n)


def sender_history(tx: DataFrame, senders: DataFrame, start: datetime.datetime | None = None, end: datetime.datetime | None = None) -> DataFrame:
    """The payments of the senders (sender_account) between two times, each sender's newest first."""
    rows = _window(tx, start, end).join(senders.select("sender_account").distinct(), "sender_account", "left_semi")
    return rows.orderBy("sender_account", F.desc("timestamp"), F.desc("id"))


def sender_statistics(tx: DataFrame, start: datetime.datetime | None = None, end: datetime.datetime | None = None) -> DataFrame:
    """Each sender's number of payments and receivers, mean and deviation of amounts between two times."""
    amount = F.col("amount").cast("double")
    return _window(tx, start, end).groupBy("sender_account").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("receiver_account").alias("receivers"), F.round(F.avg(amount), 6).alias("mean"), F.round(F.stddev_pop(amount), 4).alias("sd")
    )


#: An asked range is cut into at most about so many buckets of time.
RANGE_BUCKETS = 64


def in_ranges(tx: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked (account, start, end and any others) with each payment of the account from start to end, both included;
    null ends are open. The payment's columns have their own names.

    Payments and ranges meet by account and bucket of time: a range asks for the buckets that it covers, at most about
    RANGE_BUCKETS, as their width follows from the longest range. So the join has equal keys, an account with a third of all
    payments is cut by time, and ranges may overlap and repeat.
    """
    t, start, end = micros(), micros("start"), micros("end")
    said = asked.select(F.min(start).alias("s"), F.max(end).alias("e"), F.max(end - start).alias("longest"), F.count_if(start.isNull() | end.isNull()).alias("open")).first()
    lo, hi = tx.agg(F.min(t), F.max(t)).first() if said.open else (None, None)
    longest = max([x for x in (said.longest, hi - lo if hi is not None else None) if x is not None], default=0)
    width = max(HOUR, longest // RANGE_BUCKETS + 1)
    start, end = F.coalesce(start, F.lit(lo).cast("long")), F.coalesce(end, F.lit(hi).cast("long"))
    bucket = lambda at: F.floor(at / F.lit(width)).cast("long")
    ranges = asked.withColumns({"_s": start, "_e": end}).where("_s <= _e")
    ranges = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e")))))
    rows = tx.withColumns({"_t": t, "_bucket": bucket(t)})
    met = (F.col("q.account") == F.col("p.sender_account")) & (F.col("q._bucket") == F.col("p._bucket")) & F.col("p._t").between(F.col("q._s"), F.col("q._e"))
    return ranges.alias("q").join(rows.alias("p"), met).select(*[F.col(f"q.{c}") for c in asked.columns], *[F.col(f"p.{c}") for c in tx.columns])


def range_statistics(tx: DataFrame, asked: DataFrame) -> DataFrame:
    """account, start, end of the distinct ranges asked for, with the number of payments and receivers in each, mean and deviation of
    their amounts; ranges without a payment have 0 and nulls."""
    keys = ["account", "start", "end"]
    ranges = asked.select(*keys).distinct()
    amount = F.col("amount").cast("double")
    found = in_ranges(tx, ranges).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("receiver_account").alias("receivers"), F.round(F.avg(amount), 6).alias("mean"), F.round(F.stddev_pop(amount), 4).alias("sd"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    both = ranges.alias("r").join(found.alias("f"), same, "left")
    zero = F.lit(0).cast("long")
    return both.select(*[F.col(f"r.{k}") for k in keys], F.coalesce("n", zero).alias("n"), F.coalesce("receivers", zero).alias("receivers"), "mean", "sd")


def paid_before(tx: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, paid_before of the asked payments (default: all): whether their sender has paid their receiver earlier.

    A pair's first time is a grouped minimum, so that a pair with many payments meets no single task.
    """
    asked = tx if asked is None else asked
    pair = ["sender_account", "receiver_account"]
    first = tx.groupBy(*pair).agg(F.min("timestamp").alias("_first"))
    return asked.select("id", "timestamp", *pair).join(first, pair, "left").select("id", F.coalesce(F.col("_first") < F.col("timestamp"), F.lit(False)).alias("paid_before"))


def alerts_of(tx: DataFrame, alerts: DataFrame, expl: DataFrame) -> DataFrame:
    """Every alert of the payments with its explanations, if any: id (of the payment), alert_id, detection_config, explanation_type."""
    found = tx.select("id").join(alerts.select(F.col("transaction_id").alias("id"), F.col("id").alias("alert_id"), "detection_config"), "id")
    return found.join(expl.select("alert_id", "explanation_type"), "alert_id", "left")


def anomalies(alerts: DataFrame, tx: DataFrame, config: str | None = None, scope: str = "all", fold: int | None = None) -> DataFrame:
    """Anomalies with their payment's fold. scope: all, or test rows; fold narrows to one."""
    rows = _equal(alerts, detection_config=config).where("is_anomaly").join(tx.select(F.col("id").alias("transaction_id"), "is_training_set", "fold"), "transaction_id")
    return _equal(rows.where("NOT is_training_set") if scope == "test" or fold is not None else rows, fold=fold)


def patterns(library: DataFrame, type_: str | None = None) -> DataFrame:
    return _equal(library, patternType=type_).orderBy("patternType", "title")


def results_of(results: DataFrame, config: str | None = None) -> DataFrame:
    """Result rows, newest first (by id)."""
    return _equal(results, detection_config=config).orderBy(F.desc("id"))


def keyset_page(tx: DataFrame, after: int, n: int, scope: str = "all", feats: DataFrame | None = None) -> DataFrame:
    """The next n payments by id after `after`: all, test rows, or (scope pending) those without a row in feats."""
    rows = tx.where(F.col("id") > after)
    rows = rows.where("NOT is_training_set") if scope == "test" else rows
    rows = rows.join(feats.select(F.col("transaction_id").alias("id")), "id", "left_anti") if scope == "pending" else rows
    return paged(rows, [F.col("id")], size=n)


# explanations


def pending_explanations(alerts: DataFrame, expl: DataFrame, config: str, type_: str, n: int = 200) -> DataFrame:
    """id of the first n anomalies of a configuration that have no explanation of a type."""
    done = expl.where(F.col("explanation_type") == type_).select(F.col("alert_id").alias("id"))
    return paged(_equal(alerts, detection_config=config).where("is_anomaly").join(done, "id", "left_anti").select("id"), [F.col("id")], size=n)


def unscored(expl: DataFrame, types: tuple[str, ...] = (), config: str | None = None, ids: DataFrame | None = None, n: int = 100) -> DataFrame:
    """id of the first n explanations without scores: of some types, of a configuration, of the alerts in ids (alert_id)."""
    rows = _equal(expl, detection_config=config).where("completeness IS NULL")
    rows = rows.where(F.col("explanation_type").isin(*types)) if types else rows
    rows = rows if ids is None else rows.join(ids.select("alert_id").distinct(), "alert_id", "left_semi")
    return paged(rows.select("id"), [F.col("id")], size=n)


def rescore_reset(expl: DataFrame, type_: str, n: int, dims: tuple[str, ...]) -> DataFrame:
    """expl with the scores of the first n (1 to 500, others are moved there) of a type cleared."""
    first = paged(_equal(expl, explanation_type=type_).select("id"), [F.col("id")], size=min(500, max(1, n)))
    marked = expl.join(F.broadcast(first.withColumn("_reset", F.lit(True))), "id", "left")  # at most 500 rows
    return marked.withColumns({d: F.when(F.col("_reset").isNull(), F.col(d)) for d in dims}).drop("_reset")


def null_sentinels(expl: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """expl with scores of 0, which mean none, as null."""
    return expl.withColumns({d: F.nullif(F.col(d), F.lit(0)) for d in dims})


def rating_sample(expl: DataFrame, type_: str, n: int, dims: tuple[str, ...]) -> DataFrame:
    """The first n (1 to 200) explanations of a type for people to rate: text, scores and blank columns for theirs."""
    rows = paged(_equal(expl, explanation_type=type_), [F.col("id")], size=min(200, max(1, n)))
    return rows.select("id", "alert_id", "explanation_text", "amount", *dims, *[F.lit(None).cast("double").alias(f"human_{d}") for d in dims])


# maintenance


def update_status(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """alerts with the statuses of updates (id, status, at); of several for an alert the latest holds."""
    last = updates.groupBy("id").agg(F.max_by("status", "at").alias("_new"))
    return alerts.join(last, "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*alerts.columns)


MOST_IDS = 1000


def delete_results(results: DataFrame, ids: list[int] | None = None, name: str | None = None, everything: bool = False) -> DataFrame:
    """results without those of the given ids (at most 1,000), of an experiment, or without any."""
    if everything:
        return results.limit(0)
    if ids is not None and len(ids) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids at a time")
    left = results if not ids else results.where(~F.col("id").isin(ids))
    return left if name is None else left.where(F.col("experiment_name") != name)
