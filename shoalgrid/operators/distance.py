"""Exact Euclidean distances from every cell of a raster to the nearest marked one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators.grid import Shape


def least_squares_away(rows: np.ndarray, at: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Least ``(row - at) ** 2 + gaps ** 2`` for each of the sorted ``rows`` over the sorted ``at``, in whole numbers.

    These are parabolas of one width, any two of which cross once, so the best one moves down as the row
    does: the middle row's choice bounds those above and below it. Rows are settled in halving strides, each
    stride in one sweep over the candidates, so the cost is candidates times the logarithm of the rows.
    """
    n, m = len(rows), len(at)
    choice, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stride = 1 << max(0, n.bit_length() - 1)
    while stride:
        idx = np.arange(stride - 1, n, 2 * stride)
        if len(idx):
            lo = np.where(idx >= stride, choice[np.maximum(idx - stride, 0)], 0)
            hi = np.where(idx + stride < n, choice[np.minimum(idx + stride, n - 1)], m - 1)
            many = hi - lo + 1
            begins = np.cumsum(many) - many
            tried = np.arange(many.sum()) - np.repeat(begins - lo, many)
            cost = (np.repeat(rows[idx], many) - at[tried]) ** 2 + gaps[tried] ** 2
            least = np.minimum.reduceat(cost, begins)
            hits = np.flatnonzero(cost == np.repeat(least, many))
            choice[idx], best[idx] = tried[hits[np.searchsorted(hits, begins)]], least
        stride //= 2
    return best


def _column(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("r")
    found = part["gap"].notna().to_numpy()
    rows = part["r"].to_numpy(np.int64)
    if not found.any():
        return part.assign(squared=pd.array([None] * len(part), "Int64"))[["r", "c", "squared"]]
    return part.assign(squared=least_squares_away(rows, rows[found], part["gap"].to_numpy(float)[found].astype(np.int64)))[["r", "c", "squared"]]


def distance_transform(cells: DataFrame, shape: Shape, marked: Column, out: str = "distance") -> DataFrame:
    """``(r, c, out)``: distance of each cell's centre to that of the nearest cell where ``marked`` holds, in map units.

    0 on marked cells; NULL everywhere if there are none; a NULL condition marks nothing. The raster must be dense. Squared
    distances are whole numbers, so the result is exact. Two passes, one shuffle each: along a row, the nearest marked
    cell on either side, by running windows; down a column, the best of what the rows offer. A task
    holds a line of the raster, never a neighbourhood, however far the nearest marked cell is.
    """
    at = F.when(marked, F.col("c"))
    both = [F.last(at, ignorenulls=True).over(Window.partitionBy("r").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.asc("c"), F.desc("c"))]
    rows = cells.select("r", "c", both[0].alias("_l"), both[1].alias("_r"))
    gaps = rows.select(F.col("r").cast("long").alias("r"), "c", F.least(F.col("c") - F.col("_l"), F.col("_r") - F.col("c")).cast("long").alias("gap"))
    done = gaps.groupBy("c").applyInPandas(_column, f"r long, c {dict(cells.dtypes)['c']}, squared long")
    return done.select(F.col("r").cast(dict(cells.dtypes)["r"]).alias("r"), "c", (F.sqrt(F.col("squared").cast("double")) * shape.cell).alias(out))
