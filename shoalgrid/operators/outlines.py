"""Outlines of the regions of a raster: directed cell edges, joined into rings by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import unwritten, written
from shoalgrid.operators import grid as g
from shoalgrid.operators.grid import Shape
from shoalgrid.operators.regions import connected

#: Walking round a cell with it on the right: letters of the cells outside, ahead, ahead and outside, behind, behind and outside,
#: the step to the cell ahead and outside, and where the edge starts and ends, as (column, row).
SIDES = [
    ("b", "f", "c", "d", "a", (-1, 1), (0, 0), (1, 0)),
    ("f", "h", "i", "b", "c", (1, 1), (1, 0), (1, 1)),
    ("h", "d", "g", "f", "i", (1, -1), (1, 1), (0, 1)),
    ("d", "b", "a", "h", "g", (-1, -1), (0, 1), (0, 0)),
]


def segments(cells: DataFrame, shape: Shape, zone: str) -> DataFrame:
    """``(id, next, zone, x0, y0, x1, y1)``: straight pieces of the zones' borders, each with the piece that follows it.

    The zone lies to the right of its pieces. Where two cells of a zone touch at a corner only, each
    keeps its own border, as four-connected regions do. Corners are counted in columns and rows. Missing
    cells and the raster's end are outside. The raster must be dense.

    Which edges begin and end a piece, and which piece follows, is told by the eight neighbours alone; the two ends of a
    piece then meet in one window along their line, over border edges only.
    """
    around = g.ring(cells, zone, "none").where(F.col(zone).isNotNull())
    same = lambda k: F.coalesce(F.col("_" + k) == F.col(zone), F.lit(False))
    number = lambda r, c, k: (r.cast("long") * shape.cols + c) * 4 + k
    r, c = F.col("r"), F.col("c")
    edges = []
    for k, (out, ahead, far, behind, back, step, start, end) in enumerate(SIDES):
        follows = F.when(same(ahead), number(r + step[0], c + step[1], (k + 3) % 4)).otherwise(number(r, c, (k + 1) % 4))
        edges.append(F.when(~same(out), F.struct(
            F.lit(k).alias("k"), (r if k % 2 == 0 else c).alias("line"), [c, r, -c, -r][k].alias("at"),
            (~(same(behind) & ~same(back))).alias("begins"), (~(same(ahead) & ~same(far))).alias("ends"),
            number(r, c, k).alias("id"), follows.alias("next"), (c + start[0]).alias("x0"), (r + start[1]).alias("y0"), (c + end[0]).alias("x1"), (r + end[1]).alias("y1"),
        )))
    each = around.select(F.col(zone).alias("zone"), F.explode(F.filter(F.array(*edges), lambda e: e.isNotNull())).alias("e")).select("zone", "e.*").where("begins or ends")
    onward = Window.partitionBy("k", "line").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("ends"), F.struct("next", "x1", "y1")), ignorenulls=True).over(onward)
    return each.withColumn("_e", last).where("begins").select("id", "_e.next", "zone", "x0", "y0", "_e.x1", "_e.y1")


def ring_order(pieces: DataFrame) -> DataFrame:
    """Add to ``pieces(id, next)``, which form rings, ``ring`` (the smallest id on the ring) and ``place`` (0 at that piece, onwards).

    Pointer jumping: each round a piece learns what its far pointer has seen and takes over that one's pointer, so a
    ring of n pieces takes about log2(n) rounds, twice: once for the smallest id, once for the places after
    the ring is opened there. Every piece is pointed to by one other, so no key is hot.
    """
    now = written(pieces.select("id", "next", F.col("id").alias("low")))
    while True:
        far = now.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("low").alias("_l"))
        after = written(now.join(far, "next").select("id", F.col("_n").alias("next"), F.least("low", "_l").alias("low"), (F.col("_l") < F.col("low")).alias("moved")))
        unwritten(now)
        now = after
        if not now.agg(F.max("moved")).first()[0]:
            break  # over twice the reach nothing smaller is seen from anywhere on the ring
    named = written(pieces.join(now.select("id", F.col("low").alias("ring")), "id"))
    unwritten(now)
    ends = F.col("next") == F.col("ring")
    now = written(named.select("id", F.when(~ends, F.col("next")).alias("next"), F.when(ends, 0).otherwise(1).cast("long").alias("left")))
    while now.where("next is not null").limit(1).count():
        far = now.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("left").alias("_l"))
        going = now.where("next is not null").join(far, "next").select("id", F.col("_n").alias("next"), (F.col("left") + F.col("_l")).alias("left"))
        after = written(going.unionByName(now.where("next is null")))  # those that have arrived share no key
        unwritten(now)
        now = after
    length = named.groupBy("ring").agg(F.count("*").alias("_size"))
    return named.join(now.select("id", "left"), "id").join(length, "ring").withColumn("place", F.col("_size") - 1 - F.col("left")).drop("left", "_size")


def rings(cells: DataFrame, shape: Shape, zone: str) -> DataFrame:
    """``(region, ring, n_vertices, length, area, vertices)``: the closed outlines of each four-connected region of a zone.

    ``area`` is positive for the outer ring, negative for a hole; length and area are in map units; ``vertices``
    are the corners in order, the first one repeated at the end, x to the right and y upwards from the raster's upper left corner.
    Rings come with the region they bound, so a hole needs no search for its region. Missing values belong to none.
    """
    parts = connected(cells.select("r", "c", zone), shape, zone, "_region")
    told = ring_order(written(segments(parts, shape, "_region")))
    cross = F.col("x0") * F.col("y1").cast("double") - F.col("x1") * F.col("y0").cast("double")
    at = F.struct("place", (F.col("x0") * shape.cell).alias("x"), (-F.col("y0") * shape.cell).alias("y"))
    per = told.groupBy(F.col("zone").alias("region"), "ring").agg(
        F.count("*").alias("n_vertices"), (F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))) * shape.cell).alias("length"),
        (F.sum(cross) / 2 * shape.cell**2).alias("area"), F.sort_array(F.collect_list(at)).alias("_v"),
    )
    closed = F.transform(F.concat("_v", F.slice("_v", 1, 1)), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return per.withColumn("vertices", closed).drop("_v")


def outlines(cells: DataFrame, shape: Shape, zone: str) -> DataFrame:
    """``(fid, area, n_rings, n_vertices, length, rings)``: a polygon for each region, its outer ring first; ``fid`` is the region."""
    order = F.struct((F.col("area") < 0).alias("hole"), "ring", "vertices")
    per = rings(cells, shape, zone).groupBy(F.col("region").alias("fid")).agg(
        F.sum("area").alias("area"), F.count("*").alias("n_rings"), F.sum("n_vertices").alias("n_vertices"), F.sum("length").alias("length"), F.sort_array(F.collect_list(order)).alias("_r"),
    )
    return per.withColumn("rings", F.transform("_r", lambda x: x["vertices"])).drop("_r")
