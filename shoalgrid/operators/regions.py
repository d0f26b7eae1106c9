"""Regions of a raster: connected cells of equal value, their boundaries, and rugosity over fitted planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import cut, unwritten, written
from shoalgrid.operators import grid as g
from shoalgrid.operators import terrain as t
from shoalgrid.operators.grid import Shape


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``: the smallest node that links lead to, for each node of a link to another.

    Large-star and small-star rounds: their number grows with the logarithm of the nodes, whatever
    the shape. Minima are combined before they are shuffled, so a hub's links are in no single task.
    """
    now, seen = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        was, seen = seen, tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if was == seen:
            break  # a round has changed nothing: stars around their smallest nodes
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        unwritten(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected(cells: DataFrame, shape: Shape, value: str, out: str = "region") -> DataFrame:
    """Number of each cell's region: the smallest cell number among four-connected cells of its value.

    Cells of a row that hang together are one run, named by its first cell; runs of equal value that touch
    across rows are linked, and only these links go through rounds. However a region winds, it is found
    whole. Missing values belong to no region. The raster must be dense.
    """
    v = F.col(value)
    row, column = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    begins = F.col("r").cast("long") * shape.cols + F.col("c")
    known = cells.withColumn("_at", F.when(~v.eqNullSafe(F.lag(v).over(row)) | F.lag("c").over(row).isNull(), begins))
    known = cut(known.withColumn("_at", F.when(v.isNotNull(), F.last("_at", ignorenulls=True).over(row))))
    above = known.select("_at", F.when(v == F.lag(v).over(column), F.lag("_at").over(column)).alias("_up"))
    found = components(above.where("_up is not null").select(F.col("_at").alias("a"), F.col("_up").alias("b")))
    named = known.join(found.withColumnRenamed("node", "_at"), "_at", "left").withColumn(out, F.coalesce("component", "_at"))
    return named.select(*[c for c in cells.columns if c != out], out)


def borders(cells: DataFrame, region: str) -> DataFrame:
    """``(u, v, n)``: neighbouring regions, ``u < v``, and how many cell edges they share."""
    here = F.col(region)
    pairs = [cells.select(here.alias("a"), F.lead(region).over(Window.partitionBy(x).orderBy(y)).alias("b")) for x, y in ("rc", "cr")]
    return pairs[0].unionByName(pairs[1]).where("a != b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"))


def merged(cells: DataFrame, shape: Shape, zone: str, least: int, out: str = "region") -> DataFrame:
    """Connected regions of equal ``zone``, those of fewer than ``least`` cells taken up by a neighbour; named by their smallest cell number.

    In each round every small region joins the neighbour with which it shares the longest border, ties to the smaller
    number, and what joins hangs together; so the small ones are at least halved, and the rounds grow with their
    logarithm. Rounds see one row a region and one a border, never the cells again. A small region whose neighbours
    are all missing cells stays. Missing values belong to no region. The raster must be dense.
    """
    named = written(connected(cells, shape, zone, "_region"))
    size = written(named.where("_region is not null").groupBy(F.col("_region").alias("region")).agg(F.count("*").alias("n")))
    edge, name = written(borders(named, "_region")), written(size.select(F.col("region").alias("_region"), "region"))
    while True:
        both = edge.select(F.col("u").alias("a"), F.col("v").alias("b"), "n").unionByName(edge.select(F.col("v").alias("a"), F.col("u").alias("b"), "n"))
        small = size.where(F.col("n") < least).select(F.col("region").alias("a"))
        choice = written(both.join(small, "a").groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("b")))
        if choice.isEmpty():
            break
        joined = written(components(choice))
        to = lambda df, c: df.join(joined.select(F.col("node").alias(c), F.col("component").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: E731,B023
        ends = to(to(edge, "u"), "v").where("u != v")
        after = (
            written(to(size, "region").groupBy("region").agg(F.sum("n").alias("n"))),
            written(ends.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("n").alias("n"))),
            written(to(name, "region")),
        )
        for was in (size, edge, name, choice, joined):
            unwritten(was)
        size, edge, name = after
    for was in (size, edge, choice):
        unwritten(was)
    told = named.join(name.withColumnRenamed("region", "_name"), "_region", "left")
    return told.withColumn(out, F.col("_name")).select(*[c for c in cells.columns if c != out], out)


def boundary(cells: DataFrame, zone: str, out: str = "on_edge") -> DataFrame:
    """True for cells beside another zone, a missing one or the raster's end."""
    ring = g.ring(cells, zone, "none")
    inside = F.lit(True)
    for k in "bdfh":
        inside = inside & F.coalesce(F.col(f"_{k}") == F.col(zone), F.lit(False))
    return ring.withColumn(out, F.when(F.col(zone).isNotNull(), ~inside)).select(*cells.columns, out)


def plane(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Slopes in x and y of the least-squares plane, as aggregates; NULL where points lie on a line."""
    xx, yy, xy, xz, yz = F.covar_pop(x, x), F.covar_pop(y, y), F.covar_pop(x, y), F.covar_pop(x, z), F.covar_pop(y, z)
    det = xx * yy - xy * xy
    ok = F.when(F.abs(det) > 1e-9, det)
    return (xz * yy - yz * xy) / ok, (yz * xx - xz * xy) / ok


def plane_rugosity(cells: DataFrame, shape: Shape, zone: str, value: str = "z") -> DataFrame:
    """``(zone, n_cells, rugosity, plane_slope, plane_aspect)``: surface area over the area of the plane through the boundary.

    The plane is fitted to the zone's boundary cells; slope in degrees, aspect clockwise from north (NULL if level).
    """
    work = boundary(t.surface_ratio(cells, shape, value, area="_area"), zone).where(F.col(zone).isNotNull())
    edge = F.col("on_edge") & F.col(value).isNotNull()
    at = lambda c, sign: F.when(edge, sign * F.col(c) * shape.cell)
    a, b = plane(at("c", 1.0), at("r", -1.0), F.when(edge, F.col(value)))
    per = work.groupBy(zone).agg(F.count("*").alias("n_cells"), F.sum("_area").alias("_s"), F.count("_area").alias("_k"), a.alias("_a"), b.alias("_b"))
    steep = F.sqrt(F.col("_a") ** 2 + F.col("_b") ** 2)
    aspect = F.degrees(F.atan2(-F.col("_a"), -F.col("_b")))
    return per.select(
        zone, "n_cells", (F.col("_s") / (F.col("_k") * shape.cell**2 * F.sqrt(1 + steep**2))).alias("rugosity"), F.degrees(F.atan(steep)).alias("plane_slope"),
        F.when(steep > 0, F.when(aspect < 0, aspect + 360).otherwise(aspect)).alias("plane_aspect"),
    )
