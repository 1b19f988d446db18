"""Sums over all rows of vectors of a fixed size, for models that are trained by passes over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(batch) over all batches: one vector a task, added up by place, so `size` numbers reach the driver.

    It depends on the partitions by no more than the rounding of sums; an empty table gives zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += of(b)
        yield pa.RecordBatch.from_pydict({"i": np.arange(size, dtype=np.int32), "v": total})

    out = np.zeros(size)
    for i, v in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def whole(column: str, width: int) -> Column:
    """True for arrays of so many finite numbers, false for all others and for null."""
    a = F.col(column).cast("array<double>")
    return F.coalesce((F.size(a) == width) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
