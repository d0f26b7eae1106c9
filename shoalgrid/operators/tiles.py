"""Block processing: NumPy functions over tiles that carry a halo of their neighbours' cells; superpixels.

Tiles are for what SQL cannot say well (Gaussian smoothing, user functions). Every cell is
sent to the tiles whose halo holds it, in one shuffle; a task holds one tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.functions.staging import cut
from shoalgrid.operators.grid import Shape, _ghosts


def process(cells: DataFrame, shape: Shape, func: Callable[[np.ndarray], np.ndarray | dict[str, np.ndarray]], value: str = "z", block: int = 256, halo: int = 0, mode: str = "symmetric", outputs: tuple[str, ...] = ("out",)) -> DataFrame:
    """``(r, c, outputs...)`` of ``func`` applied to each tile with its halo; missing cells are NaN inside, NULL outside.

    Beyond the raster the halo follows the edge rule; with ``none`` it is missing there. ``func``
    returns an array as large as its input, or one for each name of ``outputs``.
    """
    wide = cells.select("r", "c", F.col(value).alias("v"))
    wide = _ghosts(_ghosts(wide, "c", shape.cols, halo, halo, mode), "r", shape.rows, halo, halo, mode)

    def owners(x: str, n: int) -> Column:
        lo, hi = F.floor((F.col(x) - halo) / block), F.floor((F.col(x) + halo) / block)
        return F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit((n - 1) // block)))

    sent = wide.withColumn("tr", F.explode(owners("r", shape.rows))).withColumn("tc", F.explode(owners("c", shape.cols)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tr"].iloc[0]) * block, int(pdf["tc"].iloc[0]) * block
        rows, cols = min(block, shape.rows - r0), min(block, shape.cols - c0)
        a = np.full((rows + 2 * halo, cols + 2 * halo), np.nan)
        y, x = pdf["r"].to_numpy() - r0 + halo, pdf["c"].to_numpy() - c0 + halo
        ok = (y >= 0) & (y < a.shape[0]) & (x >= 0) & (x < a.shape[1])
        a[y[ok], x[ok]] = pdf["v"].to_numpy(float)[ok]
        got = func(a)
        got = got if isinstance(got, dict) else {outputs[0]: got}
        yy, xx = np.mgrid[0:rows, 0:cols]
        cut = lambda b: b[halo : halo + rows, halo : halo + cols].ravel()
        return pd.DataFrame({"r": (yy + r0).ravel().astype("int32"), "c": (xx + c0).ravel().astype("int32"), **{k: cut(np.asarray(got[k], float)) for k in outputs}})

    out = sent.groupBy("tr", "tc").applyInPandas(run, "r int, c int, " + ", ".join(f"`{k}` double" for k in outputs))
    return out.select("r", "c", *[F.nanvl(k, F.lit(None)).alias(k) for k in outputs])


def _weights(sigma: float) -> np.ndarray:
    k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    w = np.exp(-(k**2) / (2 * sigma * sigma))
    return w / w.sum()


def _blur(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Separable convolution; the halo of the result is not valid."""
    for axis in (0, 1):
        a = np.apply_along_axis(np.convolve, axis, a, w, mode="same")
    return a


def gaussian(cells: DataFrame, shape: Shape, sigma: float, value: str = "z", out: str = "smooth", block: int = 256) -> DataFrame:
    """Gaussian smoothing, cut off at four deviations, symmetric at the edges; missing cells spread."""
    w = _weights(sigma)
    return process(cells, shape, lambda a: {out: _blur(a, w)}, value, block, len(w) // 2, outputs=(out,))


def smoothed_curvature(cells: DataFrame, shape: Shape, sigma: float, value: str = "z", block: int = 256) -> DataFrame:
    """``mean_curvature``, ``gaussian_curvature`` and ``gradient`` of the smoothed surface."""
    w, s = _weights(sigma), shape.cell

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        g = _blur(a, w)
        dy, dx = np.gradient(g, s)
        dyy, dyx = np.gradient(dy, s)
        _, dxx = np.gradient(dx, s)
        return {"mean_curvature": (dxx + dyy) / 2, "gaussian_curvature": dxx * dyy - dyx**2, "gradient": np.hypot(dx, dy)}

    return process(cells, shape, run, value, block, len(w) // 2 + 3, outputs=("mean_curvature", "gaussian_curvature", "gradient"))


def superpixels(cells: DataFrame, shape: Shape, values: list[str], step: int = 16, compactness: float = 0.1, rounds: int = 5) -> DataFrame:
    """``(r, c, segment)``: local k-means in value and position, from seeds on a square grid of ``step`` cells.

    Values are scaled to 0..1 over the raster. A cell goes to the nearest of the centres at most ``step``
    away in row and column, ties to the smaller number; one that has none, as centres move, keeps its
    segment. Centres lie in buckets of ``step`` cells and reach the cells of the nine buckets around them
    as one list for each bucket, so segments know no tiles and no seams. Cells with a missing value belong to no segment.
    """
    m = F.broadcast(cells.agg(*[f(v).alias(f"_{k}{v}") for v in values for k, f in (("lo", F.min), ("hi", F.max))]))  # one row
    scale = [F.when(F.col(f"_hi{v}") == F.col(f"_lo{v}"), 0.0).otherwise((F.col(v) - F.col(f"_lo{v}")) / (F.col(f"_hi{v}") - F.col(f"_lo{v}"))) for v in values]
    at = [(F.col(x) / step).alias(f"_y{k}") for k, x in enumerate("rc")]
    across = -(-shape.cols // step)
    rows = cells.crossJoin(m).select("r", "c", *at, *[(x / compactness).alias(f"_x{k}") for k, x in enumerate(scale)]).dropna()
    place = ["_y0", "_y1", *[f"_x{k}" for k in range(len(values))]]
    rows = rows.withColumn("br", F.floor("_y0")).withColumn("bc", F.floor("_y1"))
    now = cut(rows.withColumn("segment", F.col("br") * across + F.col("bc")))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(rounds):
        centres = now.groupBy("segment").agg(*[F.avg(p).alias(p) for p in place])
        near = centres.withColumn("_o", around).withColumn("br", F.floor("_y0") + F.col("_o.i")).withColumn("bc", F.floor("_y1") + F.col("_o.j"))
        lists = near.groupBy("br", "bc").agg(F.collect_list(F.struct("segment", *place)).alias("_near"))  # of nine buckets of step by step cells
        met = now.join(lists, ["br", "bc"], "left")
        close = F.filter("_near", lambda k: (F.abs(k["_y0"] - F.col("_y0")) <= 1) & (F.abs(k["_y1"] - F.col("_y1")) <= 1))
        far = F.transform(close, lambda k: F.struct(sum(((k[p] - F.col(p)) ** 2 for p in place[1:]), (k[place[0]] - F.col(place[0])) ** 2).alias("d"), k["segment"].alias("s")))
        now = cut(met.withColumn("segment", F.coalesce(F.array_min(far)["s"], "segment")).drop("_near"))
    return now.select("r", "c", "segment")
