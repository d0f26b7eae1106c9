"""Polygons cut up by a grid of squares: which squares lie inside, and which sides reach the others."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def square(bucket: float) -> float:
    """The power of two at or above ``bucket``, so that dividing by it is exact."""
    if not (bucket > 0 and math.isfinite(bucket)):
        raise ValueError(f"bucket {bucket!r} must be above 0")
    return 2.0 ** math.ceil(math.log2(bucket))


def finite(x: Column) -> Column:
    """False for missing values, NaN and both infinities."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def sides(polygons: DataFrame) -> DataFrame:
    """``(fid, lx, ly, ux, uy)``: the sides of ``polygons(fid, rings)`` from their lower to their upper end.

    Rings that are not closed are closed; rings with a coordinate that is missing or not finite are left out.
    """
    ring = F.col("ring")
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    closed = F.when((first["x"] != last["x"]) | (first["y"] != last["y"]), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    each = polygons.select("fid", F.explode("rings").alias("ring"))
    each = each.where(F.forall("ring", lambda p: finite(p["x"]) & finite(p["y"])) & (F.size("ring") > 0)).select("fid", closed.alias("ring"))
    pairs = F.zip_with(ring, F.slice(ring, 2, F.size(ring)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = each.select("fid", F.explode(F.filter(pairs, lambda p: p["b"].isNotNull())).alias("e")).select("fid", "e.*")
    rises = F.col("a.y") <= F.col("b.y")
    ends = [F.when(rises, F.col(p)).otherwise(F.col(q)).cast("double").alias(n) for p, q, n in (("a.x", "b.x", "lx"), ("a.y", "b.y", "ly"), ("b.x", "a.x", "ux"), ("b.y", "a.y", "uy"))]
    return each.select("fid", *ends).where("lx != ux or ly != uy")


def meets(e: Column | None, y: Column) -> Column:
    """Where a side is at height ``y``, never beyond its ends."""
    lx, ly, ux, uy = (F.col(n) if e is None else e[n] for n in ("lx", "ly", "ux", "uy"))
    at = lx + (ux - lx) * (y - ly) / F.when(uy > ly, uy - ly)
    return F.least(F.greatest(at, F.least(lx, ux)), F.greatest(lx, ux))


def cover(polygons: DataFrame, side: float) -> DataFrame:
    """``(fid, bx, by, inside, sides)``: the squares that a polygon's sides reach, each with those sides, and those wholly inside it.

    ``inside`` is whether the square's upper right corner is inside by the even-odd rule; ``side`` is a power of two. A side
    goes to the squares that it runs through (and, where it lies on their border, to the neighbour), row by row; corners are
    told by where sides cross the rows' upper lines, in pairs. So no row holds more than the sides of one square, however
    many a polygon has; the rows are as many as sides run through squares, and squares lie inside.
    """
    line = (F.col("by") + 1) * side
    rows = sides(polygons).withColumn("by", F.explode(F.sequence(F.ceil(F.col("ly") / side) - 1, F.floor(F.col("uy") / side))))
    start = F.when(F.col("ly") >= F.col("by") * side, F.col("lx")).otherwise(meets(None, F.col("by") * side))
    end = F.when(F.col("uy") <= line, F.col("ux")).otherwise(meets(None, line))
    spread = F.sequence(F.ceil(F.least(start, end) / side) - 1, F.floor(F.greatest(start, end) / side))
    reached = rows.select("fid", F.explode(spread).alias("bx"), "by", F.struct("lx", "ly", "ux", "uy").alias("e"), F.lit(False).alias("inside"))
    crossing = rows.where((F.col("ly") <= line) & (line < F.col("uy"))).select("fid", "by", F.ceil(meets(None, line) / side).alias("_m"))
    along = Window.partitionBy("fid", "by").orderBy("_m")
    spans = crossing.select("fid", "by", "_m", F.lead("_m").over(along).alias("_n"), F.row_number().over(along).alias("_k")).where("_k % 2 = 1 and _n > _m")
    corners = spans.select("fid", F.explode(F.sequence(F.col("_m") - 1, F.col("_n") - 2)).alias("bx"), "by", F.lit(None).cast(reached.schema["e"].dataType).alias("e"), F.lit(True).alias("inside"))
    return reached.unionByName(corners).groupBy("fid", "bx", "by").agg(F.max("inside").alias("inside"), F.collect_list("e").alias("sides"))


def held(px: Column, py: Column, side: float) -> Column:
    """Whether a row of ``cover`` whose square holds the point says that the polygon does.

    From the point to the square's right border, then up to its corner: each side that is crossed on the way changes
    what the corner says. Both crossings are told by the same ``meets``, so they agree to the last bit.
    """
    right, top = (F.col("bx") + 1) * side, (F.col("by") + 1) * side

    def above(e: Column, y: Column) -> Column:
        """Whether a side crosses the right border above ``y``, if it crosses that line."""
        return F.when(e["uy"] <= y, False).when(e["ly"] > y, True).otherwise((right < meets(e, y)) != (e["ux"] > right))

    def changes(e: Column) -> Column:
        spans = (e["ly"] <= py) & (py < e["uy"])
        across = F.when(spans, (px < meets(e, py)) != (right < meets(e, py))).otherwise(False)
        up = F.when((e["lx"] > right) != (e["ux"] > right), above(e, py) != above(e, top)).otherwise(False)
        return across != up

    return F.col("inside") != (F.size(F.filter("sides", changes)) % 2 == 1)
