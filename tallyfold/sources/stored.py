"""Changing stored, partitioned tables: only touched partitions are replaced, and a run that fails changes nothing.

A change is computed into a staging table first. It is then written over the touched partitions with dynamic partition overwrite,
and folders of partitions that have no row left are removed. Changes are functions of a partition's rows, so a run that was cut
off can simply be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import lookups
from tallyfold.session import made, removed, written

#: Partitions that one change may touch; their values reach the driver.
MOST_PARTITIONS = 100_000
#: What goes with each kind of rows, itself last: explanations hang on alerts, alerts and features on transactions.
CASCADE = {
    "explanations": ("explanations", "snapshots"),
    "alerts": ("explanations", "alerts", "snapshots"),
    "transactions": ("explanations", "alerts", "features", "transactions", "snapshots"),
}


def partition_folder(path: str, by: str, value) -> str:
    """The folder of a partition, with the characters that Spark escapes in folder names escaped."""
    if value is None:
        return f"{path}/{by}=__HIVE_DEFAULT_PARTITION__"
    odd = set('"#%\'*/:=?\\\x7f{[]^') | {chr(c) for c in range(1, 32)}
    return f"{path}/{by}=" + "".join(f"%{ord(c):02X}" if c in odd else c for c in str(value))


def change(spark: SparkSession, path: str, by: str, touched: DataFrame, how: Callable[[DataFrame], DataFrame]) -> list:
    """Replace the partitions of the table at path, partitioned by the column `by`, whose values are in touched (by), by what `how`
    makes of their rows. The values of the replaced partitions are returned."""
    stored = spark.read.parquet(path)
    values = [r[0] for r in touched.select(by).distinct().limit(MOST_PARTITIONS + 1).collect()]
    if len(values) > MOST_PARTITIONS:
        raise ValueError(f"more than {MOST_PARTITIONS} partitions are touched")
    if not values:
        return []
    named = [v for v in values if v is not None]
    mine = F.col(by).isin(named) | (F.col(by).isNull() if None in values else F.lit(False))
    staged = written(how(stored.where(mine)).select(*stored.columns), "staged")
    left = {r[0] for r in staged.select(by).distinct().collect()}
    if left - set(values):
        raise ValueError("a change must keep rows in their partitions")
    if left:
        staged.repartition(by, F.pmod(F.xxhash64(*stored.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for value in set(values) - left:
        removed(spark, partition_folder(path, by, value))
    return values


def update_status(spark: SparkSession, path: str, updates: DataFrame, by: str = "detection_config") -> list:
    """Set the statuses of updates (id, status, at) in the stored alerts; the latest of several holds."""
    touched = spark.read.parquet(path).select("id", by).join(updates.select("id"), "id", "left_semi")
    return change(spark, path, by, touched, lambda rows: lookups.update_status(rows, updates))


def delete_rows(spark: SparkSession, path: str, by: str, gone: DataFrame, key: str) -> list:
    """Delete the rows whose key is in gone (key)."""
    ids = gone.select(key)
    touched = spark.read.parquet(path).select(key, by).join(ids, key, "left_semi")
    return change(spark, path, by, touched, lambda rows: rows.join(ids, key, "left_anti"))


def delete_transactions(spark: SparkSession, folder: str, gone: DataFrame, by: dict[str, str]) -> dict[str, list]:
    """Delete transactions (gone: id) and what hangs on them from the tables under a folder: explanations, alerts, features,
    transactions, in this order, so that a run cut off leaves no row without its parent's; and clear the snapshots, whose counts are
    no longer true. by: the partition column of each table. The replaced partitions of each table are returned."""
    gone = written(gone.select("id").distinct(), "gone")
    by_tx = gone.withColumnRenamed("id", "transaction_id")
    alerts = spark.read.parquet(f"{folder}/alerts").join(by_tx, "transaction_id", "left_semi").select(F.col("id").alias("alert_id"))
    alerts = written(alerts, "gone-alerts")
    done = {
        "explanations": delete_rows(spark, f"{folder}/explanations", by["explanations"], alerts, "alert_id"),
        "alerts": delete_rows(spark, f"{folder}/alerts", by["alerts"], by_tx, "transaction_id"),
        "features": delete_rows(spark, f"{folder}/features", by["features"], by_tx, "transaction_id"),
        "transactions": delete_rows(spark, f"{folder}/transactions", by["transactions"], gone, "id"),
    }
    _emptied(spark, f"{folder}/snapshots")
    return done


def _emptied(spark: SparkSession, path: str) -> None:
    """Remove a table's rows; the folder stays, so that it reads as an empty table with a given schema."""
    removed(spark, path)
    made(spark, path)


def clear(spark: SparkSession, folder: str, what: str) -> tuple[str, ...]:
    """Clear all explanations, alerts or transactions under a folder with all that hangs on them, and the snapshots."""
    for table in CASCADE[what]:
        _emptied(spark, f"{folder}/{table}")
    return CASCADE[what]
