"""Rules: a registry of name, condition and reason; thresholds as columns joined from a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default, lowest and highest usual threshold of each rule.
DEFAULTS = {"LARGE_TRANSACTION": 1_000_000, "NEW_RECEIVER_HIGH_VALUE": 500_000, "RAPID_VELOCITY": 3, "STRUCTURING": 10_000}
INDUSTRY = {"LARGE_TRANSACTION": (10_000, 10_000_000), "NEW_RECEIVER_HIGH_VALUE": (1_000, 100_000), "RAPID_VELOCITY": (2, 20), "STRUCTURING": (5_000, 10_000)}
STRUCTURING_VELOCITY = 3

#: The rules' names and the reasons that they give.
#: Rule name: when it fires and what it says, {t} being its threshold. In alphabetical order, the order of results.
RULES: dict[str, tuple[str, str]] = {
    "LARGE_TRANSACTION": ("amount >= {t}", "concat('Transaction amount ', CAST(amount AS STRING), ' exceeds threshold ', {s})"),
    "NEW_RECEIVER_HIGH_VALUE": (
        "coalesce(is_new_receiver, false) AND amount >= {t}",
        "concat('High-value transfer of ', CAST(amount AS STRING), ' to new receiver ', receiver_account, ' (threshold: ', {s}, ')')",
    ),
    "RAPID_VELOCITY": (
        "coalesce(tx_velocity_1h >= {t}, false)",
        "concat('Sender ', sender_account, ' has ', CAST(tx_velocity_1h AS STRING), ' transactions in the last hour (threshold: ', {s}, ')')",
    ),
    "STRUCTURING": (
        f"coalesce(is_round_amount AND amount > 0 AND amount <= {{t}} AND tx_velocity_24h >= {STRUCTURING_VELOCITY}, false)",
        "concat('Potential structuring: round amount ', CAST(amount AS STRING), ' at/below ', {s}, ' with ', CAST(tx_velocity_24h AS STRING), ' transactions in 24h')",
    ),
}


def threshold_table(spark, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "rule_name string, v string").select("rule_name", F.col("v").cast("decimal(19,4)").alias("current_value"))


def with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows with a column t_<rule> of each rule; a rule without a row has its default. The table is one row per rule."""
    one = thresholds.agg(*[F.coalesce(F.max(F.when(F.col("rule_name") == r, F.col("current_value"))), F.lit(d).cast("decimal(19,4)")).alias(f"t_{r}") for r, d in DEFAULTS.items()])
    return rows.crossJoin(F.broadcast(one))


def _parts(rule: str) -> tuple[Column, Column]:
    fires, says = RULES[rule]
    value = f"t_{rule}" if rule != "RAPID_VELOCITY" else f"CAST(t_{rule} AS INT)"
    shown = f"regexp_replace(CAST(t_{rule} AS STRING), '[.]?0+$', '')" if rule != "RAPID_VELOCITY" else f"CAST({value} AS STRING)"
    return F.expr(fires.format(t=value)), F.expr(says.format(s=shown.replace("'[.]?0+$'", "'[.]0+$'")))


def rule(rows: DataFrame, thresholds: DataFrame, name: str) -> DataFrame:
    fires, says = _parts(name)
    return with_thresholds(rows, thresholds).select("id", fires.alias("triggered"), F.when(fires, says).alias("reason"))


def evaluate(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows with results (array of name, triggered, reason) and rule_triggered (the fired rules and reasons, or null)."""
    results = F.array(*[F.struct(F.lit(r).alias("name"), fires.alias("triggered"), F.when(fires, says).alias("reason")) for r in RULES for fires, says in [_parts(r)]])
    fired = F.filter("results", lambda x: x["triggered"])
    text = F.array_join(F.transform(fired, lambda x: F.concat(x["name"], F.lit(": "), x["reason"])), "; ")
    done = with_thresholds(rows, thresholds).withColumn("results", results).drop(*[f"t_{r}" for r in DEFAULTS])
    return done.withColumn("rule_triggered", F.when(F.size(fired) > 0, text))


def threshold_view(thresholds: DataFrame) -> DataFrame:
    """Every rule with its value, default, whether it is at the default and outside the usual range."""
    spark = thresholds.sparkSession
    meta = spark.createDataFrame([(r, DEFAULTS[r], *INDUSTRY[r]) for r in DEFAULTS], "rule_name string, default_value long, low long, high long")
    value = F.coalesce(F.col("current_value"), F.col("default_value").cast("decimal(19,4)"))
    return F.broadcast(meta).join(thresholds, "rule_name", "left").select(
        "rule_name", value.cast("double").alias("current_value"), "default_value", (value == F.col("default_value")).alias("at_default"), ((value < F.col("low")) | (value > F.col("high"))).alias("outside_range")
    )


def update_threshold(thresholds: DataFrame, name: str, value: float) -> DataFrame:
    if value <= 0 or name not in DEFAULTS:
        raise ValueError("a known rule and a positive value are needed")
    new = threshold_table(thresholds.sparkSession, {name: value})
    return thresholds.where(F.col("rule_name") != name).unionByName(new)


def reset_thresholds(thresholds: DataFrame, name: str | None = None) -> DataFrame:
    return thresholds.where(F.col("rule_name") != name) if name else thresholds.limit(0)
