"""Texture around points: grey-level co-occurrence and order statistics of patches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.grid import Shape

DIRECTIONS = {0: (0, 1), 45: (-1, 1), 90: (1, 0), 135: (1, 1)}


def patches(points: DataFrame, cells: DataFrame, shape: Shape, half: int, value: str = "z", id_: str = "id") -> DataFrame:
    """``(id, r, c, v)``: the cells of each point's square, cut off at the raster's edge. Points carry ``r`` and ``c``.

    Each point is sent to its cells by an equi-join; the raster is not.
    """
    here = points.select(F.col(id_).alias("id"), F.col("r").alias("_r"), F.col("c").alias("_c")).where(F.col("_r").between(0, shape.rows - 1) & F.col("_c").between(0, shape.cols - 1))
    span = F.sequence(F.lit(-half), F.lit(half))
    sent = here.withColumn("_y", F.explode(span)).withColumn("_x", F.explode(span)).select("id", (F.col("_r") + F.col("_y")).alias("r"), (F.col("_c") + F.col("_x")).alias("c"))
    sent = sent.where(F.col("r").between(0, shape.rows - 1) & F.col("c").between(0, shape.cols - 1))
    return sent.join(cells.select("r", "c", F.col(value).alias("v")), ["r", "c"], "left")


def glcm(points: DataFrame, cells: DataFrame, shape: Shape, half: int, levels: int = 32, value: str = "z", id_: str = "id", least: int = 1) -> DataFrame:
    """``(id, contrast, dissimilarity, homogeneity, energy, correlation)`` of each point's patch.

    Grey levels spread over the patch's own range; missing cells take its median; pairs at
    distance one count both ways; properties are averaged over four directions. A patch of one
    value has contrast 0, homogeneity, energy and correlation 1; one with fewer than ``least`` values is left out.
    A point's patch is one row, and patches of one size are worked on together, in arrays.
    """
    rows = patches(points, cells, shape, half, value, id_)
    patch = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "c", "v"))).alias("p"), F.countDistinct("r").alias("tall"), F.count("v").alias("seen")).where(F.col("seen") >= least)
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            size = pdf["v"].map(len)
            for _, same in pdf.groupby([pdf["tall"], size]):
                v = np.array([np.asarray(x, float) for x in same["v"]]).reshape(len(same), int(same["tall"].iloc[0]), -1)
                yield pd.DataFrame({"id": same["id"].to_numpy(), **dict(zip(names, texture_of(v, levels)))})

    kind = dict(rows.dtypes)["id"]
    return patch.select("id", "tall", F.col("p.v").alias("v")).mapInPandas(run, f"id {kind}, " + ", ".join(f"{k} double" for k in names))


def texture_of(v: np.ndarray, levels: int) -> list[np.ndarray]:
    """The five properties of each of several patches of one size; missing cells are NaN."""
    n = len(v)
    flat = v.reshape(n, -1)
    lo, hi, mid = np.nanmin(flat, axis=1), np.nanmax(flat, axis=1), np.nanmedian(flat, axis=1)
    span = (hi - lo)[:, None, None]
    filled = np.where(np.isnan(v), mid[:, None, None], v)
    with np.errstate(divide="ignore", invalid="ignore"):
        grey = np.where(span == 0, 0, np.floor((filled - lo[:, None, None]) / span * (levels - 1))).astype(np.int64)
    found = []
    for y, x in DIRECTIONS.values():
        one = grey[:, max(0, -y) : grey.shape[1] - max(0, y), max(0, -x) : grey.shape[2] - max(0, x)].reshape(n, -1)
        two = grey[:, max(0, y) : grey.shape[1] + min(0, y), max(0, x) : grey.shape[2] + min(0, x)].reshape(n, -1)
        if not one.shape[1]:
            continue
        i, j = np.hstack([one, two]), np.hstack([two, one])
        d = (i - j).astype(float)
        code = np.sort(i * levels + j, axis=1)
        at = np.broadcast_to(np.arange(code.shape[1]), code.shape)
        new = np.hstack([np.ones((n, 1), bool), code[:, 1:] != code[:, :-1]])
        start = np.maximum.accumulate(np.where(new, at, 0), axis=1)
        seen = (at - start + 1).astype(float)  # the k-th of its kind: sums of 2 k - 1 are squares of the kinds' numbers
        mean = i.mean(axis=1)
        var = (i * i).mean(axis=1) - mean**2
        with np.errstate(divide="ignore", invalid="ignore"):
            cor = np.where(var < 1e-15, 1.0, ((i * j).mean(axis=1) - mean**2) / var)
        found.append([(d * d).mean(axis=1), np.abs(d).mean(axis=1), (1 / (1 + d * d)).mean(axis=1), np.sqrt((2 * seen - 1).sum(axis=1)) / code.shape[1], cor])
    return [np.mean([f[k] for f in found], axis=0) if found else np.full(n, np.nan) for k in range(5)]


def patch_stats(points: DataFrame, cells: DataFrame, shape: Shape, half: int, value: str = "z", id_: str = "id") -> DataFrame:
    """``(id, n, range, iqr, skew_proxy)``: extent, quartile distance, and (mean - median) over the deviation."""
    v = F.col("v")
    g = patches(points, cells, shape, half, value, id_).groupBy("id").agg(
        F.count(v).alias("n"), (F.max(v) - F.min(v)).alias("range"), (F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))).alias("iqr"),
        ((F.avg(v) - F.percentile(v, F.lit(0.5))) / (F.stddev_pop(v) + 1e-8)).alias("skew_proxy"),
    )
    return g
