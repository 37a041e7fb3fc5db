"""Bringing the members of each block together in cells of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import written

#: Members of one block that share a cell; larger blocks are cut into pairs of chunks.
CELL = 512
KEYS = ["block", "key", "i", "j"]


def dealt_cells(blocks: DataFrame, cell: int = CELL, heavy: int | None = None, folder: str | None = None) -> DataFrame:
    """Rows (block, key, i, j, side, node, other columns of blocks) of all blocks (block int, key long, node long) that have
    two members or more.

    A block of over `cell` nodes is dealt into chunks by node, and every two chunks meet in a cell of their own, so
    no task ever holds more than two chunks of one block. side tells the chunk within the cell. With `heavy`, column
    weight counts too: blocks of more than that in sum are dealt as well. The blocks' sizes are written into the folder.
    """
    most = [] if heavy is None else [F.sum("weight").alias("heft")]
    sizes = written(blocks.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"), *most).where("n > 1"), "blocks", folder)
    chunks = F.ceil(F.col("n") / cell) if heavy is None else F.greatest(F.ceil(F.col("n") / cell), F.least(F.col("n"), F.ceil(F.col("heft") / heavy)))
    met = blocks.join(sizes, ["block", "key"]).withColumn("m", chunks.cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    more = [c for c in blocks.columns if c not in ("block", "key", "node", "weight")]
    dealt = met.select("block", "key", "node", *more, mine.alias("c"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    side = (F.col("c") > F.col("o")).cast("int").alias("side")
    return dealt.select("block", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), side, "node", *more)


def filled_cells(dealt: DataFrame, payload: DataFrame) -> DataFrame:
    """dealt with payload's columns joined by node, each cell's rows together and in order."""
    full = dealt.join(payload, "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "side", "node")
    return full.select(*dealt.columns, *[c for c in payload.columns if c != "node"])


def met_cells(blocks: DataFrame, payload: DataFrame, cell: int = CELL, folder: str | None = None) -> DataFrame:
    """The cells of all blocks (block int, key long, node long), with payload's columns: see dealt_cells and filled_cells."""
    return filled_cells(dealt_cells(blocks, cell, folder=folder), payload)


def by_cell(handle: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]):
    """For mapInPandas over met_cells: handle gets the rows of whole cells, and where each cell starts and ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _whole_cells(batches):
            yield handle(*cells)

    return run


def by_cell_of_words(handle: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], column: str):
    """by_cell for mapInArrow: the binary column comes as arrays of 64-bit words that are views of the Arrow batch, not copies.
    Only an unfinished cell's words are copied, so that one batch is held at a time."""

    def viewed(batch: pa.RecordBatch) -> pd.DataFrame:
        rows = batch.drop_columns([column]).to_pandas()
        rows[column] = pd.Series([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(column)], dtype=object)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(map(viewed, batches), column):
            out = handle(*cells)
            cells = None
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def _whole_cells(batches: Iterator[pd.DataFrame], copied: str | None = None) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        k = rows[KEYS].to_numpy()
        edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        last = int(edge[-1]) if len(edge) else 0
        held = rows.iloc[last:].reset_index(drop=True)
        if copied:
            held[copied] = pd.Series([v.copy() for v in held[copied]], dtype=object)
        if last:
            done, rows, batch = rows.iloc[:last], None, None
            yield done, np.concatenate([[0], edge[:-1]]), edge
        done = rows = batch = None  # nothing of this batch is kept while the next one is read
    if held is not None and len(held):
        yield held, np.array([0]), np.array([len(held)])
