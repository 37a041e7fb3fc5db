"""Cutting a table into blocks of neighbouring doc_ids, whatever the ids look like."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many blocks, and so many block bounds on the driver.
MOST_BLOCKS = 16_384


def id_blocks(docs: DataFrame, rows_per_block: int) -> Column:
    """An int column over doc_id: blocks of about rows_per_block neighbouring ids, rising with the id; null ids: -1."""
    n = min(MOST_BLOCKS, max(1, round(docs.count() / rows_per_block)))
    marks = docs.select("doc_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.unique(np.array(marks, float))

    @F.pandas_udf(T.IntegerType())
    def block(doc_id: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, doc_id.to_numpy(dtype=float, na_value=np.nan), side="right")
        return pd.Series(np.where(doc_id.isna(), -1, at)).astype("int32")

    return block("doc_id")
