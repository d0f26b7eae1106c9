"""Rasters as rows ``(r, c, value...)`` and the ways to look at a cell's neighbourhood.

Missing cells are NULL, never NaN. Four primitives cover every stencil:

* ``ring``      the 3x3 letters a..i, from two lag/lead windows;
* ``box``       sums over an n x n square, separably: two windows, whatever the size;
* ``stencils``  sums over annuli or discs, as horizontal runs, and the letters beside them: two windows for all;
* ``scatter``   any footprint and any aggregate: each cell is sent to the cells that see it.

Windows are partitioned by row or by column, so no task holds more than a line of the raster.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.edges import check_mode, source_of


@dataclass(frozen=True)
class Shape:
    """Rows, columns and cell size of a raster."""

    rows: int
    cols: int
    cell: float = 1.0


def shape_of(cells: DataFrame, cell: float = 1.0) -> Shape:
    """Measured by one aggregate; an empty raster has no rows."""
    m = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return Shape(0 if m["r"] is None else m["r"] + 1, 0 if m["c"] is None else m["c"] + 1, cell)


def from_nodata(value: Column, nodata: float | None) -> Column:
    """NULL for the sentinel and for NaN."""
    v = F.when(~F.isnan(value), value)
    return v if nodata is None else F.nullif(v, F.lit(nodata))


def dense(cells: DataFrame, shape: Shape) -> DataFrame:
    """Every cell of the raster, absent ones with NULL values."""
    spark = cells.sparkSession
    every = spark.range(shape.rows * shape.cols).select((F.col("id") / shape.cols).cast("int").alias("r"), (F.col("id") % shape.cols).cast("int").alias("c"))
    return every.join(cells, ["r", "c"], "left")


def _ghosts(cells: DataFrame, axis: str, n: int, low: int, high: int, mode: str) -> DataFrame:
    """Copies of cells for the indices ``-low..-1`` and ``n..n+high-1`` of one axis, beside the cells.

    Each cell is sent to the places it stands for, so what comes before is planned and worked out once.
    """
    if mode == "none" or not (low or high) or not n:
        return cells
    places: dict[int, list[int]] = {}
    for at in (*range(-low, 0), *range(n, n + high)):
        places.setdefault(source_of(at, n, mode), []).append(at)
    known = cells.sparkSession.createDataFrame(sorted(places.items()), "_from int, _at array<int>")  # no more rows than the window is wide
    met = cells.join(F.broadcast(known), cells[axis] == known["_from"], "left")
    sent = F.explode(F.concat(F.array(F.col(axis)), F.coalesce("_at", F.array().cast("array<int>"))))
    return met.withColumn(axis, sent).select(*cells.columns)


def ring(cells: DataFrame, value: str, mode: str) -> DataFrame:
    """Add ``_a _b _c / _d _e _f / _g _h _i`` around each cell of a dense raster (``_e`` is the cell itself).

    ``clamp`` and ``symmetric`` repeat the edge cell, ``reflect`` takes the one opposite.
    """
    check_mode(mode)
    along, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")

    def beside(x: Column, w, step: int) -> Column:
        there, back = (F.lag(x, 1).over(w), F.lead(x, 1).over(w)) if step < 0 else (F.lead(x, 1).over(w), F.lag(x, 1).over(w))
        first = (F.row_number().over(w) == 1) if step < 0 else F.lead(F.lit(1)).over(w).isNull()
        edge = F.lit(None) if mode == "none" else back if mode == "reflect" else x
        if mode == "reflect":
            edge = F.when((F.lag(F.lit(1)).over(w).isNull()) & (F.lead(F.lit(1)).over(w).isNull()), x).otherwise(back)
        return F.when(first, edge).otherwise(there)

    v = F.col(value)
    line = cells.withColumn("_line", F.struct(beside(v, along, -1).alias("l"), v.alias("m"), beside(v, along, 1).alias("r")))
    three = line.withColumns({"_up": beside(F.col("_line"), down, -1), "_down": beside(F.col("_line"), down, 1)})
    names = dict(zip(["_" + k for k in "abcdefghi"], [f"{s}.{k}" for s in ("_up", "_line", "_down") for k in "lmr"]))
    return three.select(*cells.columns, *[F.col(x).alias(k) for k, x in names.items()])


def frame(n: int) -> tuple[int, int]:
    """First and last offset of a window of ``n`` cells; an even one reaches further back."""
    return -(n // 2), n - 1 - n // 2


def box(cells: DataFrame, shape: Shape, n: int, sums: dict[str, Column], mode: str = "symmetric") -> DataFrame:
    """Add, for each name, the sum of its expression over the n x n square around each cell.

    A NULL expression counts as nothing; sums over nothing are NULL. The raster must be dense.
    Wide squares are differences of running sums, so the cost doesn't grow with ``n``.
    """
    first, last = frame(n)
    work = cells.select(*cells.columns, *[x.alias(f"_s_{k}") for k, x in sums.items()])
    for axis, other, size in (("c", "r", shape.cols), ("r", "c", shape.rows)):
        wide = _ghosts(work, axis, size, -first, last, mode)
        order = Window.partitionBy(other).orderBy(axis)
        if n <= 64:
            wide = wide.withColumns({f"_s_{k}": F.sum(f"_s_{k}").over(order.rowsBetween(first, last)) for k in sums})
        else:
            for k in sums:
                s = F.col(f"_s_{k}")
                run, seen = F.sum(F.coalesce(s, F.lit(0))).over(order), F.count(s).over(order)
                wide = wide.withColumn("_run", F.struct(run.alias("t"), seen.alias("n")))
                at = lambda f, k_: F.coalesce(F.col(f), F.lit(0))  # noqa: E731, ARG005
                wide = wide.withColumn("_hi", F.last("_run").over(order.rowsBetween(0, last))).withColumn("_lo", F.lag("_run", -first + 1).over(order))
                wide = wide.withColumn(f"_s_{k}", F.when(at("_hi.n", k) > at("_lo.n", k), at("_hi.t", k) - at("_lo.t", k))).drop("_run", "_hi", "_lo")
        work = wide.where(F.col(axis).between(0, size - 1))
    return work.select(*cells.columns, *[F.col(f"_s_{k}").alias(k) for k in sums])


def annulus(inner: int, outer: int) -> list[tuple[int, int]]:
    """Offsets whose distance lies in ``inner..outer``, both ends included; ``inner`` 0 includes the cell itself."""
    return [(y, x) for y in range(-outer, outer + 1) for x in range(-outer, outer + 1) if inner * inner <= x * x + y * y <= outer * outer]


def square(n: int) -> list[tuple[int, int]]:
    first, last = frame(n)
    return [(y, x) for y in range(first, last + 1) for x in range(first, last + 1)]


def disc(radius: int) -> list[tuple[int, int]]:
    return annulus(0, radius)


def runs(cells: DataFrame, shape: Shape, inner: int, outer: int, value: str, mode: str = "symmetric") -> DataFrame:
    """Add ``total`` and ``n`` of the values in the annulus, from sums over horizontal runs."""
    done = stencils(cells, shape, value, {"_only": (inner, outer)}, mode)
    return done.withColumnsRenamed({"total_only": "total", "n_only": "n"})


#: Runs up to so many cells wide are frames of a window; wider ones are differences of running sums.
WIDE_RUN = 33


def stencils(cells: DataFrame, shape: Shape, value: str, annuli: dict[str, tuple[int, int]], mode: str = "symmetric", letters: str | None = None) -> DataFrame:
    """Add ``total{name}`` and ``n{name}`` for each annulus, and the 3 x 3 letters by the edge rule ``letters``, all in one pass.

    A row at distance ``y`` contributes the cells up to ``w(y)`` on either side, less those up to
    the inner circle's. The distinct widths of all annuli are columns of one window along rows, and rows are
    then added up by one window along columns, so however many stencils there are, the raster is shuffled twice.
    Letters are as ``ring`` gives them, for the rules ``reflect`` and ``clamp``.
    """
    if letters not in (None, "reflect", "clamp"):
        raise ValueError(f"letters by {letters!r}")
    far = max(outer for _, outer in annuli.values())
    width = {k: {y: isqrt(outer * outer - y * y) for y in range(outer + 1)} for k, (_, outer) in annuli.items()}
    hole = {k: {y: isqrt(inner * inner - 1 - y * y) for y in range(outer + 1) if inner * inner - 1 - y * y >= 0} for k, (inner, outer) in annuli.items()}
    widths = sorted({w for d in (*width.values(), *hole.values()) for w in d.values()})
    wide = _ghosts(_ghosts(cells, "c", shape.cols, far, far, mode), "r", shape.rows, far, far, mode)
    along, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    sums: dict[str, Column] = {}
    if any(2 * w + 1 > WIDE_RUN for w in widths):
        wide = wide.withColumns({"_run_t": F.sum(F.coalesce(value, F.lit(0.0))).over(along), "_run_n": F.count(value).over(along)})
    for w in widths:
        if 2 * w + 1 <= WIDE_RUN:
            span = along.rowsBetween(-w, w)
            sums |= {f"_t{w}": F.coalesce(F.sum(value).over(span), F.lit(0.0)), f"_n{w}": F.count(value).over(span)}
        else:
            sums |= {f"_{k}{w}": F.last(f"_run_{k}").over(along.rowsBetween(0, w)) - F.coalesce(F.lag(f"_run_{k}", w + 1).over(along), F.lit(0)) for k in "tn"}

    def beside(x: Column, axis: str, size: int, w, step: int) -> Column:
        edge = x if letters == "clamp" or size == 1 else F.lag(x, step).over(w)
        return F.when(F.col(axis) == (0 if step < 0 else size - 1), edge).otherwise(F.lag(x, -step).over(w))

    if letters:
        v = F.col(value)
        sums["_line"] = F.struct(beside(v, "c", shape.cols, along, -1).alias("l"), v.alias("m"), beside(v, "c", shape.cols, along, 1).alias("r"))
    wide = wide.withColumns(sums)  # one projection: each is analysed as a whole
    wide = wide.where(F.col("c").between(0, shape.cols - 1))

    def added(name: str, kind: str) -> Column:
        out = None
        outer = annuli[name][1]
        for y in range(-outer, outer + 1):
            s = F.col(f"_{kind}{width[name][abs(y)]}")
            s = s - F.col(f"_{kind}{hole[name][abs(y)]}") if abs(y) in hole[name] else s
            s = F.coalesce(s if y == 0 else F.lag(s, -y).over(down), F.lit(0))
            out = s if out is None else out + s
        return out

    found = {f"{kind}{k}": added(k, kind[0]) for k in annuli for kind in ("total", "n")}
    if letters:
        line = F.col("_line")
        found |= {"_up": beside(line, "r", shape.rows, down, -1), "_down": beside(line, "r", shape.rows, down, 1)}
    done = wide.withColumns(found).where(F.col("r").between(0, shape.rows - 1))
    names = {"_" + k: x for k, x in zip("abcdefghi", [f"{s}.{k}" for s in ("_up", "_line", "_down") for k in "lmr"])} if letters else {}
    return done.select(
        *cells.columns, *[x for k in annuli for x in (F.when(F.col(f"n{k}") > 0, F.col(f"total{k}")).alias(f"total{k}"), F.col(f"n{k}").cast("long").alias(f"n{k}"))],
        *[F.col(x).alias(k) for k, x in names.items()],
    )


def ordered(cells: DataFrame, shape: Shape, offsets: Iterable[tuple[int, int]], value: str, mode: str = "symmetric") -> DataFrame:
    """Add ``total`` and ``n`` of the values at the offsets ``(row, column)``, added one by one in their order.

    Doubles added in another order differ in their last bits, which parts a sum from a border that it lies on. For small
    footprints: each offset is a term. The raster must be dense; it is shuffled twice.
    """
    offsets = list(offsets)
    far = max(max(abs(y), abs(x)) for y, x in offsets)
    wide = _ghosts(_ghosts(cells, "c", shape.cols, far, far, mode), "r", shape.rows, far, far, mode)
    along, down = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    columns = F.array(*[F.lag(value, -y).over(down) for y in range(-far, far + 1)])
    wide = wide.withColumn("_0", columns).where(F.col("r").between(0, shape.rows - 1))
    beside = {x: f"_{x + far + 1}" for x in sorted({x for _, x in offsets})}
    wide = wide.withColumns({k: F.lag("_0", -x).over(along) for x, k in beside.items()}).where(F.col("c").between(0, shape.cols - 1))
    seen = [F.col(beside[x])[y + far] for y, x in offsets]
    total, n = F.lit(0.0), F.lit(0)
    for v in seen:
        total, n = total + F.coalesce(v, F.lit(0.0)), n + F.when(v.isNull(), 0).otherwise(1)
    return wide.select(*cells.columns, total.alias("total"), n.cast("long").alias("n")).withColumn("total", F.when(F.col("n") > 0, F.col("total")))


def scatter(cells: DataFrame, shape: Shape, offsets: Iterable[tuple[int, int]], value: str, aggs: dict[str, Column], mode: str = "symmetric") -> DataFrame:
    """``(r, c, e, aggs...)``: aggregates over the footprint, with the footprint's values as column ``v``.

    Every cell, and every copy of it beyond an edge, is sent to the cells whose footprint holds it;
    aggregates are combined before the one shuffle. ``e`` is the cell's own value.
    """
    offsets = list(offsets)
    ys, xs = [y for y, _ in offsets], [x for _, x in offsets]
    slim = cells.select("r", "c", F.col(value).alias("v"))
    wide = _ghosts(slim, "c", shape.cols, max(0, -min(xs)), max(0, max(xs)), mode)
    wide = _ghosts(wide, "r", shape.rows, max(0, -min(ys)), max(0, max(ys)), mode)
    foot = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(True).alias("seen")) for y, x in offsets])
    if (0, 0) not in offsets:
        foot = F.concat(foot, F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(False).alias("seen"))))
    sent = wide.withColumn("_o", F.explode(foot)).select((F.col("r") - F.col("_o.y")).alias("r"), (F.col("c") - F.col("_o.x")).alias("c"), F.when(F.col("_o.seen"), F.col("v")).alias("v"), F.when((F.col("_o.y") == 0) & (F.col("_o.x") == 0), F.col("v")).alias("e"))
    sent = sent.where(F.col("r").between(0, shape.rows - 1) & F.col("c").between(0, shape.cols - 1))
    return sent.groupBy("r", "c").agg(F.max("e").alias("e"), *[a.alias(k) for k, a in aggs.items()])
