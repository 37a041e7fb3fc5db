"""Tables stored in buckets of a key: new rows are matched against them without moving what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import written
from tallyfold.sources.imports import dedup_new

#: Buckets of a new table; as many tasks match new rows.
BUCKETS = 64


def store(rows: DataFrame, name: str, path: str, keys: tuple[str, ...], buckets: int = BUCKETS, mode: str = "append") -> DataFrame:
    """Write rows into the table `name` at a path, a file for each bucket of the hash of its keys, sorted by them. Appending adds a file to
    each bucket. The table is returned."""
    dealt = rows.repartition(buckets, *keys)
    dealt.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def attach(spark: SparkSession, name: str, path: str, schema: str, keys: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """A table that an earlier application stored, under a name of this one's catalog."""
    names = ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def add_transactions(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Append the first row of each external_id that the table doesn't have; the appended rows. Only new rows are shuffled."""
    spark = rows.sparkSession
    known = spark.table(name) if spark.catalog.tableExists(name) else rows.limit(0)
    new = written(dedup_new(rows, known), "new-transactions")
    store(new, name, path, ("external_id",), buckets)
    return new


def add_alerts(alerts: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Append alerts whose payment and configuration the table doesn't have, of equal ones the smallest id; the appended rows."""
    spark, keys = alerts.sparkSession, ["transaction_id", "detection_config"]
    new = alerts.join(spark.table(name).select(*keys), keys, "left_anti") if spark.catalog.tableExists(name) else alerts
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*alerts.columns), "id").alias("row")).select("row.*")
    one = written(one, "new-alerts")
    store(one, name, path, tuple(keys), buckets)
    return one
