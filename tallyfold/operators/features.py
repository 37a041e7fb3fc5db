"""Behavioural features over each sender's history: strictly causal windows, exact in integer cents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names and order of the feature vector.
FEATURE_NAMES = (
    "amount", "amount_zscore", "tx_velocity_1h", "tx_velocity_24h", "avg_amount_7d", "amount_ratio_to_avg", "balance_change_ratio",
    "is_new_receiver", "receiver_diversity_7d", "hour_of_day", "day_of_week", "is_round_amount", "is_high_risk_type",
)
HIGH_RISK = ("TRANSFER", "CASH_OUT")


HOUR, DAY, WEEK = 3_600_000_000, 86_400_000_000, 604_800_000_000
#: Each sender's time is cut into blocks of a week, the longest window; a block's rows are one task's at most.
BLOCK = WEEK


def micros(at: str = "timestamp") -> Column:
    """Microseconds of a local time since 1970, from its date and clock: the same in any session time zone."""
    return F.expr(f"unix_date(CAST(`{at}` AS DATE)) * {DAY}L + hour(`{at}`) * {HOUR}L + minute(`{at}`) * 60000000L + CAST(extract(SECOND FROM `{at}`) * 1000000 AS BIGINT)")


def _block(at: Column) -> Column:
    return F.floor(at / F.lit(BLOCK)).cast("long")


def _in_pairs(tx: DataFrame, ties_are_new: bool = False) -> DataFrame:
    """tx with is_new_receiver and _next, the time of the pair's next payment if that lies within the next block.

    A pair's history is windowed by blocks. What a block must know of the others are two rows: that the pair has been seen
    before, and when the next block begins. They come from the first payment of each block, a grouped minimum.
    """
    pair = ["sender_account", "receiver_account"]
    rows = tx.select(*pair, micros().alias("_t"), "id", F.struct("*").alias("_row")).withColumn("_b", _block(F.col("_t")))
    firsts = rows.groupBy(*pair, "_b").agg(F.min("_t").alias("_t"))
    before = F.lag("_b").over(Window.partitionBy(*pair).orderBy("_b"))
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    marks = firsts.withColumn("_before", before).where("_before IS NOT NULL")
    each = F.array(
        F.struct(F.col("_b"), (F.col("_b") * BLOCK - 1).alias("_t")),  # the pair has been seen
        F.when(F.col("_before") == F.col("_b") - 1, F.struct(F.col("_before").alias("_b"), F.col("_t"))),  # the next payment
    )
    marks = marks.select(*pair, F.explode(F.array_compact(each)).alias("m")).select(*pair, "m._t", F.lit(None).cast("long").alias("id"), none.alias("_row"), "m._b")
    inside = Window.partitionBy(*pair, "_b")
    first = F.rank().over(inside.orderBy("_t")) if ties_are_new else F.row_number().over(inside.orderBy("_t", "id"))
    told = rows.withColumn("id", F.col("id").cast("long")).unionByName(marks).select("_row", (first == 1).alias("is_new_receiver"), F.lead("_t").over(inside.orderBy("_t", "id")).alias("_next"))
    return told.where("_row IS NOT NULL").select("_row.*", "is_new_receiver", "_next")


def _history(tx: DataFrame, leaves: dict[str, Column], amounts: dict[str, Column]) -> DataFrame:
    """tx with a column for each of `leaves`: how many of the sender's earlier payments have not yet left at the row's time,
    leaves being the last time at which a payment counts; and for each of `amounts` its sum over those of "_n7".

    A payment enters the running sums at its time and leaves them when it is over; whatever is still there when a block ends
    enters the next one once more, so that blocks are summed apart. Equal times never see each other.
    """
    names = [*leaves, *amounts]
    t = F.col("_t")
    timed = tx.withColumn("_t", micros())
    rows = timed.select("sender_account", F.struct(*tx.columns).alias("_row"), "_t", *[c.alias(f"_out{n}") for n, c in leaves.items()], *[c.alias(f"_in{n}") for n, c in amounts.items()])
    none, own = F.lit(None).cast(rows.schema["_row"].dataType), _block(t)
    kinds = {n: rows.schema[f"_in{n}"].dataType for n in amounts} | dict.fromkeys(leaves, "long")
    # windows are a block long at most, so whatever is left when a block ends leaves in the next one
    left = {n: _block(F.col(f"_out{n}")) > own for n in leaves}
    left |= dict.fromkeys(amounts, left.get("_n7"))

    def event(block: Column, at: Column, row: Column, value: Callable[[str], Column]) -> Column:
        return F.struct(block.alias("_b"), at.cast("long").alias("_at"), row.alias("_row"), *[value(n).cast(kinds[n]).alias(n) for n in names])

    one = lambda n: F.lit(1) if n in leaves else F.col(f"_in{n}")
    events = [event(own, t, F.col("_row"), one), F.when(reduce(Column.__or__, [left[n] for n in leaves]), event(own + 1, (own + 1) * BLOCK - 1, none, lambda n: F.when(left[n], one(n)).otherwise(0)))]
    for m in leaves:
        over, gone = F.col(f"_out{m}"), {m} | (set(amounts) if m == "_n7" else set())
        events.append(event(_block(over), over, none, lambda n, gone=gone: -one(n) if n in gone else F.lit(0)))
    every = rows.select("sender_account", F.explode(F.array_compact(F.array(*events))).alias("e")).select("sender_account", "e.*")
    earlier = Window.partitionBy("sender_account", "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    summed = every.select("_row", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names])
    return summed.where("_row IS NOT NULL").select("_row.*", *names)


#: Payments of a sender up to which windows run over the sender's rows as they are: a row costs at most so many steps then.
FEW = 128


def _recent(tx: DataFrame, leaves: tuple[str, ...], amounts: dict[str, Column]) -> DataFrame:
    """tx with is_new_receiver, a column for each of `leaves` and each of `amounts`, as _in_pairs and _history give them.

    Senders of at most FEW payments, mostly all of them, take one shuffle by sender and no further row. The others' payments
    are cut into weeks, where a row costs the same in any frame.
    """
    same = lambda a, b: a["sender_account"].eqNullSafe(b["_sender"])
    busy = tx.groupBy(F.col("sender_account").alias("_sender")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select("_sender")
    if busy.isEmpty():
        return _of_few(tx, leaves, amounts)
    many = _history(_in_pairs(tx.join(busy, same(tx, busy), "left_semi")), _leaves(*leaves), amounts).drop("_next")
    return _of_few(tx.join(busy, same(tx, busy), "left_anti"), leaves, amounts).unionByName(many)


def _of_few(tx: DataFrame, leaves: tuple[str, ...], amounts: dict[str, Column]) -> DataFrame:
    timed = tx.withColumn("_t", micros()).withColumns({f"_in{n}": c for n, c in amounts.items()})
    dated = F.col("_t").isNotNull()
    over = lambda length: Window.partitionBy("sender_account").orderBy("_t").rangeBetween(-length, -1)
    sums = {n: F.count(F.lit(1)).over(over(length)) for n, length in (("_n1", HOUR), ("_n24", DAY), ("_n7", WEEK)) if n in leaves}
    if "_d7" in leaves:
        sums["_d7"] = F.size(F.collect_set(F.struct("receiver_account")).over(over(WEEK))).cast("long")
    sums |= {n: F.coalesce(F.sum(f"_in{n}").over(over(WEEK)), F.lit(0)) for n in amounts}
    first = F.row_number().over(Window.partitionBy("sender_account", "receiver_account", dated).orderBy("_t", "id")) == 1
    found = timed.withColumns({n: F.when(dated, c).otherwise(F.lit(0)) for n, c in sums.items()}).withColumn("is_new_receiver", first)
    return found.select(*tx.columns, "is_new_receiver", *sums)


def _leaves(*which: str) -> dict[str, Column]:
    t = F.col("_t")  # as _history names it
    whole = {"_n1": t + HOUR, "_n24": t + DAY, "_n7": t + WEEK, "_d7": F.least(t + WEEK, F.col("_next"))}
    return {n: whole[n] for n in which}


def _cents() -> dict[str, Column]:
    cents = (F.col("amount") * 100).cast("long")
    return {"_s": cents, "_q": (cents.cast("decimal(38,0)") * cents).cast("decimal(38,0)")}


def _velocities(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tx_velocity_1h", F.col("_n1").cast("int")).withColumn("tx_velocity_24h", F.col("_n24").cast("int")).drop("_n1", "_n24")


def _statistics(rows: DataFrame) -> DataFrame:
    mean = F.when(F.col("_n7") > 0, F.expr("(2 * _s + _n7) div (2 * _n7)")).otherwise(F.lit(0))
    spread = F.expr("sqrt(CAST(_n7 * CAST(_q AS DECIMAL(38,0)) - CAST(_s AS DECIMAL(38,0)) * _s AS DOUBLE)) / _n7 / 100")
    rows = rows.withColumn("avg_amount_7d", (mean / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)"))
    return rows.withColumn("stddev_7d", F.when(F.col("_n7") > 0, spread).otherwise(F.lit(0.0))).drop("_n7", "_s", "_q")


def velocity(tx: DataFrame) -> DataFrame:
    """Earlier payments of the sender in the last hour and day."""
    return _velocities(_history(tx, _leaves("_n1", "_n24"), {}))


def amount_stats_7d(tx: DataFrame) -> DataFrame:
    """Mean (2 decimals) and population deviation of the sender's last seven days; 0 without history."""
    return _statistics(_history(tx, _leaves("_n7"), _cents()))


def _ratio(part: str, whole: str) -> Column:
    a, b = F.col(part).cast("double"), F.col(whole).cast("double")
    return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))


def zscore_and_ratio(stats: DataFrame) -> DataFrame:
    difference = F.col("amount").cast("double") - F.col("avg_amount_7d").cast("double")
    z = F.when(F.col("stddev_7d") > 0, F.round(difference / F.col("stddev_7d"), 6)).otherwise(F.lit(0.0))
    return stats.withColumn("amount_zscore", z).withColumn("amount_ratio_to_avg", _ratio("amount", "avg_amount_7d"))


def balance_ratio(tx: DataFrame) -> DataFrame:
    return tx.withColumn("balance_change_ratio", _ratio("amount", "sender_balance_before"))


def new_receiver(tx: DataFrame, ties_are_new: bool = False) -> DataFrame:
    """Whether this is the first payment of the pair; among equal times the lowest id, or all of them."""
    return _in_pairs(tx, ties_are_new).drop("_next")


def receiver_diversity(tx: DataFrame) -> DataFrame:
    """Distinct receivers of the sender's last seven days: a payment counts until the pair's next one, or for a week."""
    paired = _in_pairs(tx).drop("is_new_receiver")
    return _history(paired, _leaves("_d7"), {}).withColumn("receiver_diversity_7d", F.col("_d7").cast("int")).drop("_d7", "_next")


def calendar_flags(tx: DataFrame) -> DataFrame:
    return (
        tx.withColumn("hour_of_day", F.hour("timestamp").cast("short"))
        .withColumn("day_of_week", (F.weekday("timestamp") + 1).cast("short"))
        .withColumn("is_round_amount", (F.col("amount") > 0) & (F.col("amount") % 1000 == 0))
        .withColumn("is_high_risk_type", F.col("transaction_type").isin(*HIGH_RISK))
    )


def with_features(tx: DataFrame) -> DataFrame:
    """tx and all features. Payments by sender are counted first, then shuffled once; those of busy senders four times: rows, and each week's first
    payment, by sender, receiver and week; those first payments by pair; rows by sender and week."""
    own = _recent(tx, ("_n1", "_n24", "_n7", "_d7"), _cents())
    own = own.withColumn("receiver_diversity_7d", F.col("_d7").cast("int")).drop("_d7")
    return calendar_flags(balance_ratio(zscore_and_ratio(_statistics(_velocities(own))))).drop("stddev_7d")


def scoring(tx: DataFrame) -> DataFrame:
    """tx with is_new_receiver and tx_velocity_24h only."""
    return _recent(tx, ("_n24",), {}).withColumn("tx_velocity_24h", F.col("_n24").cast("int")).drop("_n24")


def signals(tx: DataFrame) -> DataFrame:
    """tx with the features that rules look at: is_new_receiver, velocities and calendar flags."""
    return calendar_flags(_velocities(_recent(tx, ("_n1", "_n24"), {})))


def features_full(tx: DataFrame) -> DataFrame:
    """All features by transaction_id."""
    return with_features(tx).select(F.col("id").alias("transaction_id"), *[n for n in FEATURE_NAMES if n != "amount"])


def features_incremental(tx: DataFrame, existing: DataFrame) -> DataFrame:
    """Features of rows that have none yet, over the whole history of their senders only."""
    pending = tx.join(existing.select(F.col("transaction_id").alias("id")), "id", "left_anti")
    history = tx.join(pending.select("sender_account").distinct(), "sender_account", "left_semi")
    return features_full(history).join(pending.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")


def features_subset(tx: DataFrame, existing: DataFrame, n: int) -> DataFrame:
    """Features of the first n pending rows by id."""
    pending = tx.join(existing.select(F.col("transaction_id").alias("id")), "id", "left_anti").orderBy("id").limit(n)
    history = tx.join(pending.select("sender_account").distinct(), "sender_account", "left_semi")
    return features_full(history).join(pending.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")


def feature_vector(tx: DataFrame, feats: DataFrame) -> DataFrame:
    """transaction_id and the features as JSON."""
    row = tx.select(F.col("id").alias("transaction_id"), "amount").join(feats, "transaction_id")
    return row.select("transaction_id", F.to_json(F.struct(*FEATURE_NAMES)).alias("feature_vector"))


def assemble(tx: DataFrame, feats: DataFrame, include_high_risk: bool = True) -> DataFrame:
    """id, label and the numeric features; null, NaN and infinite count as 0."""
    row = tx.select("id", "amount", "is_fraud").join(feats.withColumnRenamed("transaction_id", "id"), "id", "left")
    return numbers(row, include_high_risk)


def numbers(rows: DataFrame, include_high_risk: bool = True) -> DataFrame:
    """As assemble, of payments that have their features beside them."""
    names = [n for n in FEATURE_NAMES if include_high_risk or n != "is_high_risk_type"]

    def number(name: str) -> Column:
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).alias(f"f_{name}")

    return rows.select("id", F.col("is_fraud").cast("int").alias("label"), *map(number, names))
