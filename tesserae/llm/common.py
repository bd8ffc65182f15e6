"""Shared helpers of the operators here."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.staging import clear_staged, stage, stage_path, stage_result, staged_for

__all__ = ["IdFilter", "ascii_lower", "clear_staged", "columns_of", "release_memory", "shuffle_partitions", "small_batches", "stage", "stage_path", "stage_result", "staged_for", "text_or_empty"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes, so that very long texts don't add up in a worker. Tighter bounds that are set stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdigit() and 0 < int(now) < most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def release_memory() -> None:
    """Give back what this worker has freed, Arrow's pool included; workers live on, and stages with other needs share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is the fast path where every character is a single byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def columns_of(batch: pd.DataFrame, names: list[str] | tuple[str, ...], rows=slice(None)) -> dict[str, object]:
    """Columns of some rows of a batch as plain arrays; strings as objects, which go back to Arrow in one piece."""
    return {c: batch[c].to_numpy(object if batch[c].dtype.kind in "OSU" else None)[rows] for c in names}


FILTER_BITS = 1 << 22


class IdFilter:
    """Which cells of a table of fixed size some ids fall into, broadcast to the tasks.

    What it turns away is none of the ids; what it lets through has to be joined with them.
    With very many ids it lets everything through, which costs time and changes nothing.
    """

    def __init__(self, ids: DataFrame, cell: Column):
        """``cell`` maps each row to a whole number from 0 to below ``FILTER_BITS``."""
        words = ids.select(cell.cast("int").alias("cell")).groupBy(F.shiftright("cell", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cell & 63)")).alias("w"))
        found = np.zeros(FILTER_BITS // 64, np.int64)
        for r in words.collect():  # at most FILTER_BITS / 64 rows
            found[r["k"]] = r["w"]
        self.cells = ids.sparkSession.sparkContext.broadcast(found)

    @staticmethod
    def cell(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")

    def lets(self, cells: np.ndarray) -> np.ndarray:
        return (self.cells.value[cells >> 6] >> (cells & 63) & 1).astype(bool)
