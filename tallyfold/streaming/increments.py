"""Arriving payments, batch by batch: features of new rows and the alerts they raise (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyfold.operators import detect
from tallyfold.operators.state import FeatureState
from tallyfold.session import made


def run(arriving: DataFrame, history: str, alerts: str, thresholds: DataFrame, checkpoint: str):
    """Start a query over a streaming DataFrame of transactions. Each batch's rows that are not stored yet get their features from
    the state at `history` (see FeatureState), of which only recent weeks of their senders are read; the rules' alerts go to the
    table at `alerts`, partitioned by batch and configuration. A batch that is run again after a failure overwrites its own part of both."""
    for folder in (history, alerts):
        made(arriving.sparkSession, folder)

    def batch(rows: DataFrame, number: int) -> None:
        state = FeatureState(rows.sparkSession, history)
        found = detect.detect_rules(state.advance(rows, number), thresholds)
        found.write.mode("overwrite").partitionBy("detection_config").parquet(f"{alerts}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
