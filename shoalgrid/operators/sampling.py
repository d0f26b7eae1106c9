"""Points on rasters: affine keys, value and flag look-ups, interactions of sampled columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.operators.grid import Shape
from shoalgrid.operators.selection import exact_quantiles


@dataclass(frozen=True)
class Affine:
    """``x = a * col + c`` and ``y = e * row + f`` of a cell's corner."""

    a: float = 1.0
    c: float = 0.0
    e: float = -1.0
    f: float = 0.0


def pixel(x: Column, y: Column, t: Affine, shape: Shape, rule: str = "floor") -> tuple[Column, Column]:
    """Row and column of a point: by ``floor``, by ``round`` (half to even) of the inverse map, or by either clipped to the raster."""
    col, row = (x - t.c) / t.a, (y - t.f) / t.e
    if rule not in ("floor", "round", "floor_clip", "round_clip"):
        raise ValueError(f"rule {rule!r}")
    r, c = (F.floor(row), F.floor(col)) if rule.startswith("floor") else (F.rint(row), F.rint(col))
    if rule.endswith("clip"):
        r, c = F.greatest(F.lit(0), F.least(F.lit(shape.rows - 1), r)), F.greatest(F.lit(0), F.least(F.lit(shape.cols - 1), c))
    return r.cast("int"), c.cast("int")


def sample(points: DataFrame, cells: DataFrame, shape: Shape, t: Affine, values: list[str], rule: str = "floor", flag: str | None = None, prefix: str = "", x: str = "x", y: str = "y") -> DataFrame:
    """Every point with the values of its cell, for all layers in one join.

    Points outside, and missing cells, get NULL. ``flag`` names a column that says why:
    ``out_of_bounds``, ``nodata`` (of the first value) or an empty string. Which side is
    broadcast, if any, is left to the optimiser, which knows their sizes.
    """
    r, c = pixel(F.col(x), F.col(y), t, shape, rule)
    keyed = points.withColumn("_r", r).withColumn("_c", c)
    layer = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), *[F.col(v).alias(f"_v_{v}") for v in values])
    got = keyed.join(layer, ["_r", "_c"], "left")
    inside = F.coalesce(F.col("_r").between(0, shape.rows - 1) & F.col("_c").between(0, shape.cols - 1), F.lit(False))
    out = got.select(*points.columns, *[F.col(f"_v_{v}").alias(f"{prefix}{v}") for v in values], inside.alias("_in"), F.col(f"_v_{values[0]}").alias("_first"))
    if flag:
        out = out.withColumn(flag, F.when(~F.col("_in"), "out_of_bounds").when(F.col("_first").isNull(), "nodata").otherwise(""))
    return out.drop("_in", "_first")


def lookup_with_median(points: DataFrame, stats: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on ``key``; what has no match gets the column's median over the matched points."""
    got = points.join(stats.select(key, *columns), key, "left")
    medians = {c: m[0] for c, m in exact_quantiles(got, {c: [0.5] for c in columns}).items()}
    return got.select(*points.columns, *[F.coalesce(F.col(c), F.lit(medians[c])).alias(c) for c in columns])


def habitat_interactions(df: DataFrame, prefix: str = "terrain_") -> DataFrame:
    """Position magnitude, product of the standardised positions, and total roughness, of columns with this prefix."""
    broad, fine, vrm, ratio = (F.col(prefix + k) for k in ("broad_std", "fine_std", "vrm", "surface_ratio"))
    return df.withColumns({
        f"{prefix}bpi_magnitude": F.sqrt(broad * broad + fine * fine),
        f"{prefix}broad_x_fine_std": broad * fine,
        f"{prefix}rough_total": vrm + (ratio - 1),
    })


def acoustic_interactions(df: DataFrame, depth: str, back: str, slope: str, vrm: str) -> DataFrame:
    d, k, s, v = F.col(depth), F.col(back), F.col(slope), F.col(vrm)
    return df.withColumns({"depth_x_back": F.abs(d) * k, "slope_x_back": s * k, "acoustic_hard": k / (F.abs(d) + 1), "vrm_x_back": v * k, "slope_x_vrm": s * v})
