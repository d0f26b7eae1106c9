"""Nearest neighbours in the plane by a quadtree whose cells follow the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import unwritten, written

#: A cell is cut into 4 x 4 while it holds more rows than this, and at most so often: 52 bits an axis, as many as a double has.
#: So many levels are counted at once; rows in cells that are small by then go no deeper.
LEAF, DEPTH, STEP = 64, 26, 6


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def tree(others: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """``(parent, cell, level, n, leaf, x0, x1, y0, y1)`` of the non-empty cells, and ``others(other, ox, oy)`` with their leaf ``cell``.

    Counts and boxes of several levels come from one grouping, combined on the map side, so a dense place
    is a partial sum of each task. Boxes are those of the rows within, not of the squares.
    """
    spans = others.agg(*[f(c).alias(f"{n}_{c}") for c in ("ox", "oy") for n, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
    wide = max((spans["hi_ox"] or 0.0) - (spans["lo_ox"] or 0.0), (spans["hi_oy"] or 0.0) - (spans["lo_oy"] or 0.0)) or 1.0
    parts = 1 << (2 * DEPTH)

    def steps(c: str) -> Column:
        at = F.floor((F.col(c) - F.lit(spans[f"lo_{c}"] or 0.0)) / F.lit(wide) * parts).cast("long")
        return F.least(at, F.lit(parts - 1))

    path = F.concat(*[F.conv((F.shiftright(F.col("_x"), 2 * k).bitwiseAND(3) * 4 + F.shiftright(F.col("_y"), 2 * k).bitwiseAND(3)).cast("string"), 10, 16) for k in reversed(range(DEPTH))])
    filed = written(others.withColumns({"_x": steps("ox"), "_y": steps("oy")}).withColumn("path", path).drop("_x", "_y"))
    spot = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    large = (F.col("n") > leaf) & (F.length("cell") < DEPTH) & ~spot
    cells = deep = None
    for begin in range(0, DEPTH + 1, STEP):
        active = filed
        if begin:
            heavy = deep.where(large & (F.length("cell") == begin - 1)).select("cell")
            if not heavy.limit(1).count():
                break
            active = filed.withColumn("cell", F.substring("path", 1, begin - 1)).join(heavy, "cell", "left_semi")
        levels = F.sequence(F.lit(begin), F.lit(min(begin + STEP - 1, DEPTH)))
        each = active.select("ox", "oy", F.explode(F.transform(levels, lambda k: F.substring("path", F.lit(1), k))).alias("cell"))
        deep = written(each.groupBy("cell").agg(F.count("*").alias("n"), F.min("ox").alias("x0"), F.max("ox").alias("x1"), F.min("oy").alias("y0"), F.max("oy").alias("y1")))
        cells = deep if cells is None else cells.unionByName(deep)
    level = F.length("cell")
    inner = cells.where(large).select(F.col("cell").alias("parent"))
    root = cells.where(level == 0).withColumn("parent", F.lit(None).cast("string"))
    below = cells.where(level > 0).withColumn("parent", F.substring("cell", F.lit(1), level - 1)).join(inner, "parent")
    nodes = written(root.unionByName(below).withColumn("level", level).withColumn("leaf", (F.col("n") <= leaf) | (level == DEPTH) | spot))
    ends = nodes.where("leaf").select("cell", "level")
    depths = [r["level"] for r in ends.select("level").distinct().collect()]  # at most DEPTH + 1
    held = None
    for k in depths:
        part = filed.withColumn("cell", F.substring("path", F.lit(1), F.lit(k))).join(ends.where(F.col("level") == k).select("cell"), "cell", "left_semi").select("cell", "other", "ox", "oy")
        held = part if held is None else held.unionByName(part)
    unwritten(cells)
    return nodes, held if held is not None else filed.select(F.col("path").alias("cell"), "other", "ox", "oy")


def nearest(points: DataFrame, others: DataFrame, k: int, id_: str = "id", x: str = "x", y: str = "y", with_self: bool = True, leaf: int = LEAF) -> DataFrame:
    """``(id, other, d, rank)``: the k nearest of ``others`` for each point, ties to the smaller id; all if there are fewer.

    Rows whose coordinates are null, NaN or infinite take no part on either side. Without ``with_self`` a
    point's own id is no neighbour. Ids tell the rows of a table apart.

    A quadtree of ``others`` is walked level by level for all points at once: of the cells a point has
    reached, those nearer than the distance within which k rows are certain stay, and are replaced by their
    parts; leaves left at the end are joined with their rows. A cell is cut until it holds at most ``leaf`` rows, so a point meets
    few rows in a dense place, and a far one meets the near side of the others only. Equal places are one leaf, of which the
    k smallest ids can matter. Rounds grow with the depth, DEPTH at most; boxes are the rows' own, so no rounding loses a neighbour.
    """
    if k < 1 or leaf < 1:
        raise ValueError("k and leaf must be positive")
    need = k if with_self else k + 1
    left = points.where(finite(x) & finite(y)).select(F.col(id_).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    right = others.where(finite(x) & finite(y)).select(F.col(id_).alias("other"), F.col(x).cast("double").alias("ox"), F.col(y).cast("double").alias("oy"))
    same_place = Window.partitionBy("ox", "oy").orderBy("other")
    right = right.withColumn("_k", F.row_number().over(same_place)).where(F.col("_k") <= need).drop("_k")  # cut down on the map side first
    nodes, rows = tree(right, leaf)
    gap = lambda a, b, at: F.greatest(a - at, at - b, F.lit(0.0))
    far = lambda a, b, at: F.greatest(F.abs(at - a), F.abs(at - b))
    lo = gap(F.col("x0"), F.col("x1"), F.col("x")) ** 2 + gap(F.col("y0"), F.col("y1"), F.col("y")) ** 2
    hi = far(F.col("x0"), F.col("x1"), F.col("x")) ** 2 + far(F.col("y0"), F.col("y1"), F.col("y")) ** 2
    columns = ["id", "x", "y", "cell", "leaf", "n", "lo", "hi"]
    own = Window.partitionBy("id")
    sure = F.sum("n").over(own.orderBy("hi", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def pruned(front: DataFrame) -> DataFrame:
        bound = F.min(F.when(F.col("_sure") >= need, F.col("hi"))).over(own)
        return front.withColumn("_sure", sure).withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("lo") <= F.col("_bound"))).select(*columns)

    roots = nodes.where("parent is null").collect()  # one row, or none
    if not roots:
        return left.select("id", F.lit(None).cast(dict(right.dtypes)["other"]).alias("other"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("rank")).limit(0)
    top = roots[0]
    front = left.select("id", "x", "y", F.lit(top["cell"]).alias("cell"), F.lit(top["leaf"]).alias("leaf"), F.lit(top["n"]).alias("n"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    deepest = nodes.agg(F.max("level")).first()[0]
    for level in range(1, deepest + 1):
        parts = nodes.where(F.col("level") == level).select("parent", F.col("cell").alias("_cell"), F.col("leaf").alias("_leaf"), F.col("n").alias("_n"), "x0", "x1", "y0", "y1")
        open_ = front.where(~F.col("leaf")).select("id", "x", "y", F.col("cell").alias("parent")).join(parts, "parent")
        opened = open_.select("id", "x", "y", F.col("_cell").alias("cell"), F.col("_leaf").alias("leaf"), F.col("_n").alias("n"), lo.alias("lo"), hi.alias("hi"))
        after = written(pruned(opened.unionByName(front.where("leaf").select(*columns))))
        if level > 1:
            unwritten(front)
        front = after
    pairs = front.select("id", "x", "y", "cell").join(rows, "cell").withColumn("d", F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2))
    if not with_self:
        pairs = pairs.where("id != other")
    ranked = pairs.withColumn("rank", F.row_number().over(own.orderBy("d", "other"))).where(F.col("rank") <= k)
    return ranked.select("id", "other", "d", "rank")
