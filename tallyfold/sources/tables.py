"""Tables that are appended to, exported and purged; the pattern library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_alerts(alerts: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Append alerts whose payment and configuration are not in existing; of equal keys among them the smallest id is kept."""
    keys = ["transaction_id", "detection_config"]
    new = alerts if existing is None else alerts.join(existing.select(*keys).distinct(), keys, "left_anti")
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*alerts.columns), "id").alias("row")).select("row.*")
    one.write.mode("append").partitionBy("detection_config").parquet(path)


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder with a header for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_patterns(spark, path: str) -> DataFrame:
    """The pattern library: a JSON array of objects."""
    fields = "patternType string, title string, description string, indicators array<string>, regulatoryReference string, exampleScenario string, source string"
    return spark.read.schema(fields).json(path, multiLine=True)


def seed_patterns(library: DataFrame, existing: DataFrame) -> DataFrame:
    """Library rows whose (patternType, title) is not in existing, with doc_id (from the title) and the text to be embedded."""
    keys = ["patternType", "title"]
    new = library.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c))
    listed = F.when(F.size("indicators") > 0, F.concat(F.lit("Key Indicators:\n"), F.array_join(F.transform("indicators", lambda i: F.concat(F.lit("- "), i)), "\n")))
    text = F.concat_ws("\n\n", part("Fraud Pattern", "title"), part("Type", "patternType"), part("Description", "description"), listed, part("Regulatory References", "regulatoryReference"), part("Example Scenario", "exampleScenario"))
    return new.select(F.md5(F.concat(F.lit("fraud-pattern:"), F.col("title")).cast("binary")).alias("doc_id"), *keys, text.alias("text"))


def purge(tx: DataFrame, feats: DataFrame, alerts: DataFrame, expl: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """features, alerts and explanations without those whose payment, or alert, is gone."""
    left = alerts.join(tx.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
    return feats.join(tx.select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi"), left, expl.join(left.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
