"""Kriging: ordinary and indicator kriging of point values, by block and by zone, in NumPy per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import cut
from shoalgrid.operators.frames import in_band
from shoalgrid.operators.selection import exact_quantiles
from shoalgrid.operators.zonal import nearest

MODELS = {
    "exponential": lambda h, s, r, n: n + s * (1 - np.exp(-3 * h / r)),
    "spherical": lambda h, s, r, n: n + s * np.where(h < r, 1.5 * h / r - 0.5 * (h / r) ** 3, 1.0),
}


def variogram(x: np.ndarray, y: np.ndarray, v: np.ndarray, model: str, lags: int = 20) -> tuple[float, float, float]:
    """Sill, range and nugget that fit the binned semivariances best, over a grid of ranges."""
    i, j = np.triu_indices(len(v), 1)
    h, g = np.hypot(x[i] - x[j], y[i] - y[j]), (v[i] - v[j]) ** 2 / 2
    far = h.max() if len(h) else 1.0
    at = np.minimum((h / (far + 1e-12) * lags).astype(int), lags - 1)
    n = np.bincount(at, minlength=lags)
    ok = n > 0
    hm, gm, w = np.bincount(at, h, lags)[ok] / n[ok], np.bincount(at, g, lags)[ok] / n[ok], np.sqrt(n[ok])
    best = (np.inf, float(v.var()) or 1.0, far or 1.0, 0.0)
    for r in np.linspace(0.05, 1.0, 20) * (far or 1.0):
        base = np.column_stack([MODELS[model](hm, 1.0, r, 0.0), np.ones(len(hm))])
        c = np.clip(np.linalg.lstsq(base * w[:, None], gm * w, rcond=None)[0], 0, None)
        e = float(((base @ c - gm) ** 2 * w).sum())
        if e < best[0]:
            best = (e, float(c[0]), float(r), float(c[1]))
    return best[1:]


def solve(x: np.ndarray, y: np.ndarray, v: np.ndarray, tx: np.ndarray, ty: np.ndarray, model: str = "exponential", lags: int = 20) -> np.ndarray:
    """Ordinary kriging of ``v`` at targets; a constant field gives its value, a singular system the mean."""
    if not len(v):
        return np.full(len(tx), np.nan)
    if len(v) < 3 or np.ptp(v) < 1e-12:
        return np.full(len(tx), v.mean())
    s, r, n = variogram(x, y, v, model, lags)
    f = lambda h: np.where(h == 0, 0.0, MODELS[model](h, s, r, n))
    m = np.ones((len(v) + 1, len(v) + 1))
    m[:-1, :-1] = f(np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :]))
    m[-1, -1] = 0
    b = np.ones((len(v) + 1, len(tx)))
    b[:-1] = f(np.hypot(x[:, None] - tx[None, :], y[:, None] - ty[None, :]))
    try:
        w = np.linalg.solve(m + np.diag([1e-10] * len(v) + [0.0]), b)
    except np.linalg.LinAlgError:
        return np.full(len(tx), v.mean())
    return w[:-1].T @ v


def ordinary(points: DataFrame, targets: DataFrame, value: str, zone: str | None = None, model: str = "exponential", lags: int = 20, most: int = 3000, batch: int = 4096, id_: str = "id") -> DataFrame:
    """``(id, estimate)``: ordinary kriging at the targets, within zones if one is named.

    A zone's system holds at most ``most`` points (those with the smallest hashes: the size of a
    dense solve, a parameter of the method); targets are dealt in batches, each with its zone's points.
    """
    z = F.col(zone) if zone else F.lit(0)
    known = points.where(F.col(value).isNotNull()).select(z.alias("_z"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("v"), F.xxhash64("x", "y", F.lit(42)).alias("_h"))
    # the points with the smallest hashes, cut in blocks of a zone before they meet
    salted = known.withColumn("_s", F.pmod("_h", F.lit(64)))
    slim = salted.withColumn("_k", F.row_number().over(Window.partitionBy("_z", "_s").orderBy("_h", "x", "y", "v"))).where(F.col("_k") <= most)
    kept = slim.withColumn("_k", F.row_number().over(Window.partitionBy("_z").orderBy("_h", "x", "y", "v"))).where(F.col("_k") <= most)
    by = kept.groupBy("_z").agg(F.collect_list(F.struct("x", "y", "v")).alias("p"))
    sought = targets.select(z.alias("_z"), F.col(id_).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n = sought.groupBy("_z").agg(F.ceil(F.count("*") / batch).cast("int").alias("_n"))
    dealt = sought.join(n, "_z").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    lists = dealt.groupBy("_z", "_b").agg(F.collect_list(F.struct("id", "x", "y")).alias("t")).join(by, "_z", "left")

    def run(pdfs):
        for pdf in pdfs:
            for t, p in zip(pdf["t"], pdf["p"]):
                tx, ty = np.array([a["x"] for a in t]), np.array([a["y"] for a in t])
                q = [] if p is None else list(p)
                got = solve(*(np.array([a[k] for a in q]) for k in "xyv"), tx, ty, model, lags)
                yield pd.DataFrame({"id": [a["id"] for a in t], "estimate": got})

    kind = dict(targets.dtypes)[id_]
    return lists.mapInPandas(run, f"id {kind}, estimate double").withColumn("estimate", F.nanvl("estimate", F.lit(None)))


def indicator(points: DataFrame, targets: DataFrame, label: str, classes: list[str], zone: str | None = None, fewest: int = 5, id_: str = "id", **how) -> DataFrame:
    """``(id, prob_{class})``: kriged indicators of each class, clipped to 0..1 and scaled to sum to one.

    Where fewer than ``fewest`` of a zone's points are of a class, or fewer are not, its share of all the zone's points takes the estimate's place.
    """
    z = F.col(zone) if zone else F.lit(0)
    own = [(F.col(label) == c).cast("double") for c in classes]
    few = points.groupBy(z.alias("_z")).agg(*[F.when(F.least(F.sum(i), F.sum(1 - i)) < fewest, F.avg(i)).alias(f"_few{k}") for k, i in enumerate(own)])
    out = targets.select(F.col(id_).alias("id"), z.alias("_z")).join(few, "_z", "left")
    for k, c in enumerate(classes):
        e = ordinary(points.withColumn("_i", own[k]), targets, "_i", zone, id_=id_, **how)
        out = out.join(e.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "estimate")).alias("_e")), "id", "left").withColumn(f"prob_{c}", F.coalesce(f"_few{k}", "_e")).drop("_e")
    total = sum((F.coalesce(f"prob_{c}", F.lit(0.0)) for c in classes), F.lit(0.0))
    even = F.lit(1.0 / len(classes))
    return out.withColumn("_t", total).select("id", *[F.when(F.col("_t") > 0, F.coalesce(f"prob_{c}", F.lit(0.0)) / F.col("_t")).otherwise(even).alias(f"prob_{c}") for c in classes])


def stratified_indicator(points: DataFrame, targets: DataFrame, label: str, classes: list[str], zone: str, width: int = 1, least: int = 20, most: int = 1500, id_: str = "id", **how) -> DataFrame:
    """``(id, prob_{class})``: indicator kriging of each zone's targets from the points within ``width`` zones, or from all if they are fewer than ``least``.

    Zones are whole numbers; a target without one gets even probabilities.
    """
    served = in_band(points, targets, zone, width, least).drop(zone).withColumnRenamed("for_zone", zone)
    return indicator(served, targets, label, classes, zone, id_=id_, most=most, **how)


def surface(points: DataFrame, targets: DataFrame, value: str, zone: str, bucket: float, model: str = "spherical", lags: int = 6, least: int = 10, k: int = 5, id_: str = "id") -> DataFrame:
    """``(id, estimate)``: a value kriged within zones; the mean of the ``k`` nearest points where a zone has fewer than ``least``, or none is named.

    Targets without coordinates get the median of all points; null only if no point has a value.
    """
    known = points.where(F.col(value).isNotNull())
    rich = known.groupBy(zone).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(zone)
    kriged = ordinary(known.join(rich, zone, "left_semi"), targets.join(rich, zone, "left_semi"), value, zone, model, lags, id_=id_)
    numbered = known.select(F.monotonically_increasing_id().alias("_k"), "x", "y", F.col(value).cast("double").alias("_v"))
    others = cut(numbered)  # numbers must not change between the search and the join
    near = nearest(targets.join(rich, zone, "left_anti"), others.withColumnRenamed("_k", id_), k, bucket, id_)
    means = near.join(others.select(F.col("_k").alias("other"), "_v"), "other").groupBy("id").agg(F.avg("_v").alias("_near"))
    middle = exact_quantiles(known, {value: [0.5]})[value][0]
    out = targets.select(F.col(id_).alias("id")).join(kriged, "id", "left").join(means, "id", "left")
    return out.select("id", F.coalesce(F.col("estimate"), F.col("_near"), F.lit(middle).cast("double")).alias("estimate"))
