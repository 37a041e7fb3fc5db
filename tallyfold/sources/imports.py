"""Reading raw payment files: typing, validation, report and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.session import written

#: The columns of a raw payment file and the allowed types.
COLUMNS = ("step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud")
TYPES = ("TRANSFER", "PAYMENT", "CASH_OUT", "CASH_IN", "DEBIT")
LAST_STEP, BASE_DATE = 744, "2025-01-01 00:00:00"
#: Splits of files up to which their counts are broadcast.
MOST_BROADCAST = 100_000
NUMBERS = ("amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with file and row_num: the row's number in its file, from 1, the header not counted.

    A file's partitions are numbered by where they begin, and the rows within them in order; the rows of earlier partitions of
    the file, one count for each partition, are added. So any split of a large file gives the same numbers. The files are parsed once
    and written, so that the counts are those of the same splits.
    """
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    rows = spark.read.csv(path, schema=schema, header=True)
    at = written(rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id")), "raw-rows")
    block = Window.partitionBy("file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("file", "_from").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    starts = written(sizes.select("file", "_from", "_first", F.coalesce(F.sum("_n").over(block), F.lit(0)).alias("_before")), "splits")  # a row for each split of a file
    joined = at.join(F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts, ["file", "_from"])
    return joined.select(*COLUMNS, "file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("row_num"))


def _reason() -> Column:
    whole, number = lambda c: F.trim(c).try_cast("int"), lambda c: F.trim(c).try_cast("decimal(18,2)")
    unparsed = whole(F.col("step")).isNull() | whole(F.col("isFraud")).isNull() | whole(F.col("isFlaggedFraud")).isNull()
    for c in NUMBERS:
        unparsed = unparsed | number(F.col(c)).isNull()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(unparsed, "unparsable")
        .when(~whole(F.col("step")).between(0, LAST_STEP), "step out of range")
        .when(number(F.col("amount")) < 0, "negative amount")
        .when(~F.coalesce(F.upper(F.trim("type")).isin(*TYPES), F.lit(False)), "unknown type")
        .when(blank(F.col("nameOrig")) | blank(F.col("nameDest")), "blank account")
    )


def validate(raw: DataFrame) -> DataFrame:
    """raw with reason: the first rule that a row fails, or null."""
    return raw.withColumn("reason", _reason())


def typed(valid: DataFrame) -> DataFrame:
    """Valid rows as transactions."""
    money = lambda c: F.trim(c).cast("decimal(18,2)")
    step = F.trim("step").cast("int")
    return valid.where("reason IS NULL").select(
        "row_num",
        F.concat_ws("-", F.lit("PAYSIM"), step.cast("string"), F.trim("nameOrig"), F.trim("nameDest"), money(F.col("amount")).cast("string")).alias("external_id"),
        (F.lit(BASE_DATE).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), step)).alias("timestamp"),
        F.trim("nameOrig").alias("sender_account"),
        F.trim("nameDest").alias("receiver_account"),
        F.upper(F.trim("type")).alias("transaction_type"),
        money(F.col("amount")).alias("amount"),
        money(F.col("oldbalanceOrg")).alias("sender_balance_before"),
        (F.trim("isFraud").cast("int") == 1).alias("is_fraud"),
    )


def import_report(validated: DataFrame) -> DataFrame:
    return validated.groupBy(F.coalesce("reason", F.lit("imported")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def import_errors(validated: DataFrame, most: int = 100) -> DataFrame:
    """The first rejected rows and why."""
    return validated.where("reason IS NOT NULL").orderBy("row_num").limit(most).select("row_num", "reason")


def dedup_new(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """The first row of each external_id that is not stored yet."""
    new = rows.join(existing.select("external_id"), "external_id", "left_anti")
    first = Window.partitionBy("external_id").orderBy("row_num")
    return new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
