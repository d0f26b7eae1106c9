"""Zones, neighbours and distances between points and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators import neighbours
from shoalgrid.operators import polygons as pg
from shoalgrid.operators.grid import Shape


def zonal_stats(cells: DataFrame, zone: str, values: list[str]) -> DataFrame:
    """Count, and mean, deviation and skew (population) of each value, by zone.

    Zones of fewer than three cells take the whole raster's skew.
    """
    whole = F.broadcast(cells.agg(*[F.skewness(v).alias(f"_w_{v}") for v in values]))  # one row
    per = cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(
        F.count("*").alias("n_cells"),
        *[a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.skewness(v).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}"))],
    )
    skew = [F.when(F.col(f"_n_{v}") < 3, F.col(f"_w_{v}")).otherwise(F.nanvl(f"_s_{v}", F.lit(0.0))).alias(f"{v}_skew") for v in values]
    return per.crossJoin(whole).select(zone, "n_cells", *[x for v in values for x in (f"{v}_mean", f"{v}_std")], *skew)


def dominant_class(rows: DataFrame, zone: str, label: str) -> DataFrame:
    """The most frequent label of each zone (ties: the smallest), its share and the number of rows."""
    counts = rows.where(F.col(zone).isNotNull() & F.col(label).isNotNull()).groupBy(zone, label).agg(F.count("*").alias("n"))
    return counts.groupBy(zone).agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("dominant"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n_rows"),
    )


def relabel_by_mean(cells: DataFrame, zone: str, value: str, out: str = "rank", order: list[str] | None = None) -> DataFrame:
    """Zones numbered from 0 by ascending mean of ``value``; one row per zone is ranked.

    With ``order``, columns that tell all cells apart, a zone's cells are added one by one in that order: sums of partial sums differ in
    their last bit, which parts equal means and so changes their ranks.
    """
    known = cells.where(F.col(zone).isNotNull())
    if order:
        along = Window.partitionBy(zone).orderBy(*order)
        so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = known.withColumns({"zone_mean": F.sum(value).over(so_far) / F.count(value).over(so_far), "_after": F.lead(F.lit(1)).over(along)})
        means = run.where("_after IS NULL").select(zone, "zone_mean")
    else:
        means = known.groupBy(zone).agg(F.avg(value).alias("zone_mean"))
    return means.withColumn(out, (F.row_number().over(Window.orderBy("zone_mean", zone)) - 1).cast("int"))


def depth_zone(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value: bins closed on the left, clipped to the first and last."""
    n = sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(value.isNotNull(), n)


def purity(rows: DataFrame, zone: str, label: str) -> DataFrame:
    """Share of each label in each zone."""
    n = rows.groupBy(zone, label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(zone)))


def large_zones(cells: DataFrame, zone: str, cell: float, area: float) -> DataFrame:
    return cells.groupBy(zone).agg(F.count("*").alias("n")).where(F.col("n") * cell * cell > area)


def nearest(points: DataFrame, others: DataFrame, k: int, bucket: float, id_: str = "id", x: str = "x", y: str = "y", with_self: bool = True) -> DataFrame:
    """``(id, other, d, rank)``: the k nearest of ``others`` for each point, ties to the smaller id (``neighbours.nearest``).

    ``bucket``, once the side of the squares that were searched, must be positive and has no other effect: cells follow the data.
    """
    if not bucket > 0:
        raise ValueError("bucket must be positive")
    return neighbours.nearest(points, others, k, id_, x, y, with_self)


def smooth_probabilities(rows: DataFrame, columns: list[str], k: int, bucket: float, blend: float = 0.2, id_: str = "id") -> DataFrame:
    """Each row's probabilities blended with the mean of its k nearest (itself included), clipped and scaled to sum to one."""
    near = nearest(rows, rows, k, bucket, id_)
    means = near.join(rows.select(F.col(id_).alias("other"), *columns), "other").groupBy(F.col("id").alias(id_)).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    mixed = [F.greatest((1 - blend) * F.col(c) + blend * F.col(f"_m_{c}"), F.lit(1e-9)) for c in columns]
    total = sum(mixed[1:], mixed[0])
    keep = [c for c in rows.columns if c not in columns]
    return rows.join(means, id_).select(*keep, *[(m / total).alias(c) for m, c in zip(mixed, columns)])


def vote_nearest(points: DataFrame, labelled: DataFrame, label: str, k: int, bucket: float, id_: str = "id") -> DataFrame:
    """``(id, predicted)``: votes of the k nearest weighted by 1 / distance; exact matches outweigh all others; ties to the smaller label."""
    near = nearest(points, labelled, k, bucket, id_).join(labelled.select(F.col(id_).alias("other"), F.col(label).alias("_l")), "other")
    exact = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("id"))
    weight = F.when(exact == 1, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    votes = near.withColumn("_w", weight).groupBy("id", "_l").agg(F.sum("_w").alias("w"))
    return votes.groupBy("id").agg(F.min_by("_l", F.struct(-F.round("w", 9), F.col("_l"))).alias("predicted"))


def morans_i(rows: DataFrame, value: str, k: int, bucket: float, id_: str = "id") -> DataFrame:
    """Moran's I with row-normalised weights of the k nearest others."""
    mean = rows.agg(F.avg(value).alias("m")).first()["m"]
    z = rows.select(F.col(id_).alias("id"), (F.col(value) - F.lit(mean)).alias("z"))
    near = nearest(rows, rows, k, bucket, id_, with_self=False)
    lag = near.join(z.select(F.col("id").alias("other"), F.col("z").alias("oz")), "other").groupBy("id").agg(F.avg("oz").alias("lag"))
    return z.join(lag, "id").agg((F.sum(F.col("z") * F.col("lag")) / F.sum(F.col("z") ** 2)).alias("morans_i"))


def isobath_cells(cells: DataFrame, depth: float, value: str = "z", width: float = 0.5) -> DataFrame:
    """Cells within ``width`` of a depth; within twice that if there are none."""
    near = cells.where(F.abs(F.col(value) - depth) < width)
    return near if near.limit(1).count() else cells.where(F.abs(F.col(value) - depth) < 2 * width)


def isobath_distance(points: DataFrame, cells: DataFrame, shape: Shape, depth: float, bucket: float, value: str = "z", id_: str = "id", row: str = "r", col: str = "c") -> DataFrame:
    """Distance of each point's cell to the nearest cell on an isobath, in map units."""
    line = isobath_cells(cells, depth, value).select((F.col("r").cast("long") * shape.cols + F.col("c")).alias(id_), F.col("c").alias("x"), F.col("r").alias("y"))
    here = points.select(id_, F.col(col).alias("x"), F.col(row).alias("y"))
    return nearest(here, line, 1, bucket, id_).select(F.col("id").alias(id_), (F.col("d") * shape.cell).alias("distance"))


def within(points: DataFrame, polygons: DataFrame, bucket: float, id_: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """``(id, fid)``: every polygon ``(fid, rings)`` that holds a point, by the even-odd rule; ``fid`` is null for a point in none.

    Rings are arrays of ``(x, y)``, outer ones and holes alike; of the points on an edge, those on a lower or left one are
    inside. Points meet the squares of about ``bucket`` that a polygon covers by an equi-join, each with only the sides that
    reach it (``polygons.cover``). Points whose coordinates are missing or not finite are in no polygon. Ids of points are unique, as are ``fid``.
    """
    side = pg.square(bucket)
    at = points.select(F.col(id_).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    known = at.where(pg.finite(F.col("px")) & pg.finite(F.col("py")))
    placed = known.withColumn("bx", F.floor(F.col("px") / side)).withColumn("by", F.floor(F.col("py") / side))
    found = placed.join(pg.cover(polygons, side), ["bx", "by"]).where(pg.held(F.col("px"), F.col("py"), side)).select("id", "fid")
    return at.select("id").join(found, "id", "left")
