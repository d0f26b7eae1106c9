"""Terrain derivatives of a dense raster ``(r, c, z)``; every operator adds its columns to the cells.

Rounding is half to even. Missing input gives missing output, and what a stencil cannot see it
does not count, unless ``zero_fill`` says that missing cells weigh as zeros.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import cut
from shoalgrid.operators import grid as g
from shoalgrid.operators import tiles
from shoalgrid.operators.grid import Shape

def position_index(cells: DataFrame, shape: Shape, inner: int, outer: int, value: str = "z", out: str = "bpi", legacy_round: bool = False, in_order: bool = False) -> DataFrame:
    """Cell minus the mean of its annulus, as an integer; NULL where either is missing.

    With ``in_order``, for small annuli, the annulus is added cell by cell, column after column, so that a difference on
    the border between two integers falls as it does where cells are added in that order.
    """
    if in_order:
        if inner < 0 or outer <= inner:
            raise ValueError(f"radii {inner}, {outer}: the outer must exceed the inner")
        seen = g.ordered(cells, shape, sorted(g.annulus(inner, outer), key=lambda o: (o[1], o[0])), value)
        return seen.select(*cells.columns, _rounded(F.col(value), F.col("total"), F.col("n"), legacy_round).alias(out))
    return position_indices(cells, shape, {out: (inner, outer)}, value, legacy_round)


def position_indices(cells: DataFrame, shape: Shape, annuli: dict[str, tuple[int, int]], value: str = "z", legacy_round: bool = False, slope: str | None = None) -> DataFrame:
    """The same for several annuli (by the name of their column), and the slope if a column is named, in one pass over the raster."""
    for inner, outer in annuli.values():
        if inner < 0 or outer <= inner:
            raise ValueError(f"radii {inner}, {outer}: the outer must exceed the inner")
    seen = g.stencils(cells, shape, value, {f"_{k}": a for k, a in annuli.items()}, letters="reflect" if slope else None)
    out = {}
    for k in annuli:
        out[k] = _rounded(F.col(value), F.col(f"total_{k}"), F.col(f"n_{k}"), legacy_round)
    if slope:
        out[slope] = _slope_of(shape)
    return seen.select(*cells.columns, *[x.alias(k) for k, x in out.items()])


def _rounded(value: Column, total: Column, n: Column, legacy_round: bool) -> Column:
    d = value - total / n
    return F.when(n > 0, (d + 0.5).cast("int") if legacy_round else F.rint(d).cast("int"))


def habitat_layers(cells: DataFrame, shape: Shape, broad: tuple[int, int] = (1, 5), fine: tuple[int, int] = (1, 3), value: str = "z") -> DataFrame:
    """``broad_bpi, fine_bpi, slope`` and the standardised ``broad, fine``: what the class dictionaries judge.

    The first three are one pass, written once, as both their statistics and the result are read from it.
    """
    layers = cut(position_indices(cells, shape, {"broad_bpi": broad, "fine_bpi": fine}, value, slope="slope"))
    return standardise_all(layers, {"broad_bpi": "broad", "fine_bpi": "fine"})


def _horn(cell: float) -> tuple[Column, Column]:
    a, b, c, d, f, gg, h, i = (F.col("_" + k) for k in "abcdfghi")
    return ((c + 2 * f + i) - (a + 2 * d + gg)) / (8 * cell), ((a + 2 * b + c) - (gg + 2 * h + i)) / (8 * cell)


def slope(cells: DataFrame, shape: Shape, value: str = "z", out: str = "slope", mode: str = "reflect") -> DataFrame:
    """Slope in degrees from the eight neighbours; a cell next to a missing one is missing."""
    return g.ring(cells, value, mode).withColumn(out, _slope_of(shape)).select(*cells.columns, out)


def _slope_of(shape: Shape) -> Column:
    dx, dy = _horn(shape.cell)
    return F.when(F.col("_e").isNotNull(), F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def ruggedness(cells: DataFrame, shape: Shape, n: int = 3, value: str = "z", out: str = "vrm") -> DataFrame:
    """Vector ruggedness in 0..1: one minus the length of the mean unit normal over n x n.

    Missing cells weigh as zeros, also in the gradients beside them, and come out missing.
    """
    if n < 3:
        raise ValueError("the window must have at least 3 cells")
    filled = cells.withColumn("_z", F.coalesce(value, F.lit(0.0)))
    dx, dy = _horn(shape.cell)
    r = g.ring(filled, "_z", "reflect").select(*filled.columns, dx.alias("_dx"), dy.alias("_dy"))
    tilt = F.atan(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2))
    compass = 90 - F.degrees(F.atan2(-F.col("_dy"), F.col("_dx")))
    aspect = F.radians(F.when(compass < 0, compass + 360).otherwise(compass))
    flat, there = (F.col("_dx") == 0) & (F.col("_dy") == 0), F.col(value).isNotNull()
    part = lambda x: F.when(there, x).otherwise(0.0)
    sums = {
        "_x": part(F.when(flat, 0.0).otherwise(F.sin(aspect) * F.sin(tilt))),
        "_y": part(F.when(flat, 0.0).otherwise(F.cos(aspect) * F.sin(tilt))),
        "_zz": part(F.cos(tilt)),
    }
    b = g.box(r, shape, n, sums)
    v = 1 - F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_zz") ** 2) / (n * n)
    return b.withColumn(out, F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))).select(*cells.columns, out)


def surface_ratio(cells: DataFrame, shape: Shape, value: str = "z", out: str = "surface_ratio", corrected: bool = False, area: str | None = None, also_corrected: str | None = None) -> DataFrame:
    """Area of the eight triangles around a cell's centre over the planar cell.

    ``corrected`` divides by the cell projected along its slope; ``area`` names a further column
    for the surface area itself, ``also_corrected`` one for the corrected ratio beside the plain one.
    Each edge is shared by two triangles and worked out once.
    """
    s, centre = shape.cell, F.col("_e")
    corners, sides = "acgi", "bdfh"
    near = {frozenset(p): p for p in ("ab", "cb", "cf", "if", "ih", "gh", "gd", "ad")}
    half = lambda p, q, d: F.sqrt((p - q) * (p - q) + d * d) / 2
    edges = {f"_e{k}": half(centre, F.col("_" + k), sqrt(2) * s if k in corners else s) for k in corners + sides}
    edges |= {f"_e{p}": half(F.col("_" + p[0]), F.col("_" + p[1]), s) for p in near.values()}
    halves = {f"_h{p}": (F.col(f"_e{p[0]}") + F.col(f"_e{p[1]}") + F.col(f"_e{p}")) / 2 for p in near.values()}

    def triangle(p: str) -> Column:
        h = F.col(f"_h{p}")
        return F.sqrt(F.greatest(h * (h - F.col(f"_e{p[0]}")) * (h - F.col(f"_e{p[1]}")) * (h - F.col(f"_e{p}")), F.lit(0.0)))

    there = F.lit(True)
    for k in "abcdefghi":
        there = there & F.col("_" + k).isNotNull()
    first, *rest = map(triangle, near.values())
    work = g.ring(cells, value, "clamp").withColumns(edges).withColumns(halves).withColumn("_area", F.when(there, sum(rest, first)))
    dx, dy = _horn(s)
    flat, tilted = F.lit(s * s), F.lit(s * s) / F.cos(F.atan(F.sqrt(dx * dx + dy * dy)))
    found = {out: F.col("_area") / (tilted if corrected else flat)} | ({also_corrected: F.col("_area") / tilted} if also_corrected else {}) | ({area: F.col("_area")} if area else {})
    return work.select(*cells.columns, *[x.alias(k) for k, x in found.items()])


def statistical_aspect(cells: DataFrame, shape: Shape, value: str = "z", mode: str = "reflect") -> DataFrame:
    """``aspect_sin`` and ``aspect_cos`` of the compass direction of the steepest descent; flat cells are missing."""
    dx, dy = _horn(shape.cell)
    n = F.sqrt(dx * dx + dy * dy)
    r = g.ring(cells, value, mode)
    return r.withColumn("aspect_sin", F.when(n > 0, -dx / n)).withColumn("aspect_cos", F.when(n > 0, -dy / n)).select(*cells.columns, "aspect_sin", "aspect_cos")


def northness_eastness(cells: DataFrame, shape: Shape, value: str = "z") -> DataFrame:
    """Cosine and sine of the aspect from gradients signed downslope; flat cells are missing."""
    dx, dy = _horn(shape.cell)
    gx, gy = -dx, -dy
    n = F.sqrt(gx * gx + gy * gy)
    r = g.ring(cells, value, "clamp")
    return r.withColumn("northness", F.when(n > 0, gy / n)).withColumn("eastness", F.when(n > 0, gx / n)).select(*cells.columns, "northness", "eastness")


def max_curvature(cells: DataFrame, shape: Shape, value: str = "z", out: str = "max_curvature") -> DataFrame:
    """The larger magnitude of the Hessian's two eigenvalues."""
    a, b, c, d, e, f, gg, h, i = (F.col("_" + k) for k in "abcdefghi")
    s2 = shape.cell**2
    rr, tt, ss = (d - 2 * e + f) / s2, (b - 2 * e + h) / s2, (i + a - c - gg) / (4 * s2)
    root = F.sqrt((rr - tt) ** 2 + 4 * ss * ss)
    value_ = F.greatest(F.abs((rr + tt + root) / 2), F.abs((rr + tt - root) / 2))
    return g.ring(cells, value, "clamp").withColumn(out, value_).select(*cells.columns, out)


def complexity(cells: DataFrame, shape: Shape, value: str = "z", out: str = "complexity") -> DataFrame:
    """Gradient magnitude of the slope surface (degrees)."""
    first = slope(cells, shape, value, "_slope", mode="clamp")
    dx, dy = _horn(shape.cell)
    return g.ring(first, "_slope", "clamp").withColumn(out, F.sqrt(dx * dx + dy * dy)).select(*cells.columns, out)


def laplacian_curvature(cells: DataFrame, shape: Shape, value: str = "z", out: str = "laplacian") -> DataFrame:
    """Magnitude of the five-point Laplacian over the cell's area."""
    b, d, e, f, h = (F.col("_" + k) for k in "bdefh")
    return g.ring(cells, value, "symmetric").withColumn(out, F.abs(b + d + f + h - 4 * e) / shape.cell**2).select(*cells.columns, out)


def gradient(cells: DataFrame, shape: Shape, value: str = "z") -> DataFrame:
    """``dy`` and ``dx`` by central differences, one-sided at the borders."""
    r = g.ring(cells, value, "clamp")
    step = lambda at, n: F.when((F.col(at) == 0) | (F.col(at) == n - 1), shape.cell).otherwise(2 * shape.cell)
    return r.withColumn("dy", (F.col("_h") - F.col("_b")) / step("r", shape.rows)).withColumn("dx", (F.col("_f") - F.col("_d")) / step("c", shape.cols)).select(*cells.columns, "dy", "dx")


def box_moments(cells: DataFrame, shape: Shape, n: int, value: str = "z", zero_fill: bool = False, mode: str = "symmetric") -> DataFrame:
    """Add ``mean`` and ``std`` (population) over n x n; missing cells are skipped, or weigh as zeros."""
    v = F.coalesce(value, F.lit(0.0)) if zero_fill else F.col(value)
    b = g.box(cells, shape, n, {"_s": v, "_q": v * v, "_k": F.when(v.isNotNull(), 1)}, mode)
    k = F.lit(float(n * n)) if zero_fill else F.col("_k")
    m = F.col("_s") / k
    return b.withColumn("mean", m).withColumn("std", F.sqrt(F.greatest(F.col("_q") / k - m * m, F.lit(0.0)))).select(*cells.columns, "mean", "std")


STATS = ("mean", "std", "variance", "mean_diff", "iqr", "kurtosis")


def focal_stats(cells: DataFrame, shape: Shape, n: int, stats: tuple[str, ...] = STATS, window: str = "rectangle", value: str = "z") -> DataFrame:
    """Add ``stat_{name}`` for each statistic of the window (``rectangle`` n x n, or ``circle`` of radius n // 2).

    ``mean_diff`` is the deviation from the mean over the window's mean of absolute deviations.
    ``iqr`` and ``kurtosis`` (excess, population) see windows of ``2 * (n // 2) + 1`` and are
    missing where the window leaves the raster or holds a missing cell.
    """
    if unknown := [s for s in stats if s not in STATS]:
        raise ValueError(f"Unknown stat {unknown}; known: {', '.join(STATS)}")
    if window not in ("rectangle", "circle"):
        raise ValueError(f"window {window!r}")
    there, work = F.col(value).isNotNull(), cells
    if window == "rectangle":
        work = box_moments(cells, shape, n, value)
    elif {"mean", "std", "variance", "mean_diff"} & set(stats):
        r = n // 2
        s = g.runs(cells.withColumn("_q", F.col(value) ** 2), shape, 0, r, value).withColumn("mean", F.col("total") / F.col("n")).drop("total", "n")
        s = g.runs(s, shape, 0, r, "_q").withColumn("std", F.sqrt(F.greatest(F.col("total") / F.col("n") - F.col("mean") ** 2, F.lit(0.0))))
        work = s.drop("total", "n", "_q")
    if "mean_diff" in stats:
        work = work.withColumn("_d", F.abs(F.col(value) - F.col("mean")))
        if window == "rectangle":
            work = g.box(work, shape, n, {"_t": F.col("_d"), "_k": F.when(F.col("_d").isNotNull(), 1)}).withColumn("_m", F.col("_t") / F.col("_k")).drop("_t", "_k")
        else:
            work = g.runs(work, shape, 0, n // 2, "_d").withColumn("_m", F.col("total") / F.col("n")).drop("total", "n")
        work = work.withColumn("stat_mean_diff", F.when(F.col("_m") == 0, 0.0).otherwise((F.col(value) - F.col("mean")) / F.col("_m")))
    exact = {}
    if "iqr" in stats:
        exact["stat_iqr"] = F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))
    if "kurtosis" in stats:
        exact["stat_kurtosis"] = F.kurtosis("v")
    if exact:
        h = n // 2
        foot = g.square(2 * h + 1) if window == "rectangle" else g.disc(h)
        got = g.scatter(cells, shape, foot, value, exact | {"_n": F.count("v")}, mode="none").where(F.col("_n") == len(foot)).drop("e", "_n")
        work = work.join(got, ["r", "c"], "left")
    plain = {"mean": F.col("mean"), "std": F.col("std"), "variance": F.col("std") ** 2} if "mean" in work.columns else {}
    return work.select(*cells.columns, *[F.when(there, plain[s] if s in plain else F.col(f"stat_{s}")).alias(f"stat_{s}") for s in stats])


def range_deviation(cells: DataFrame, shape: Shape, n: int, value: str = "z", out: str = "mean_diff_range") -> DataFrame:
    """Deviation from the n x n mean in units of the window's range; 0 where it has none."""
    got = g.scatter(cells, shape, g.square(n), value, {"_m": F.avg("v"), "_lo": F.min("v"), "_hi": F.max("v")})
    span = F.col("_hi") - F.col("_lo")
    found = got.select("r", "c", F.when(span == 0, 0.0).otherwise((F.col("e") - F.col("_m")) / span).alias(out))
    return cells.join(found, ["r", "c"], "left")


def multiple_scales(cells: DataFrame, shape: Shape, sizes: list[int], metrics: list[str], value: str = "z") -> DataFrame:
    """Add ``{metric}_{size}`` for each metric (``vrm`` or a statistic of ``focal_stats``) and window size."""
    out = cells
    for n in sizes:
        stats = tuple(m for m in metrics if m != "vrm")
        if stats:
            out = focal_stats(out, shape, n, stats, value=value).withColumnsRenamed({f"stat_{m}": f"{m}_{n}" for m in stats})
        if "vrm" in metrics:
            out = ruggedness(out, shape, n, value, f"vrm_{n}")
        out = cut(out) if n != sizes[-1] else out  # else each size would plan all before it again
    return out


def raster_properties(cells: DataFrame, value: str = "z") -> DataFrame:
    """One row: cells, those with a value, their least, largest and mean value and deviation, and the share that is missing."""
    v = F.col(value)
    return cells.agg(
        F.count("*").alias("cells"), F.count(v).alias("filled"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        (1 - F.count(v) / F.count("*")).alias("missing"),
    )


def multiscale_columns(names: list[str], scales: list[int]) -> list[str]:
    return [f"terrain_{n}_{s}" for n in names for s in scales]


def multiscale_mean(cells: DataFrame, shape: Shape, scales: list[int], value: str = "z") -> DataFrame:
    """Add ``{value}_{scale}``: box means in which missing cells weigh as zeros, and come out missing."""
    out = cells
    for s in scales:
        b = g.box(out, shape, s, {"_s": F.coalesce(value, F.lit(0.0))})
        out = b.withColumn(f"{value}_{s}", F.when(F.col(value).isNotNull(), F.col("_s") / float(s * s))).drop("_s")
    return out


def relative_deviation(cells: DataFrame, shape: Shape, scale: int, value: str = "z", out: str = "rdmv") -> DataFrame:
    """Deviation from the box mean in units of the box's deviation; missing cells weigh as the raster's mean."""
    mean = F.broadcast(cells.agg(F.avg(value).alias("_all")))  # one row
    filled = cells.crossJoin(mean).withColumn("_v", F.coalesce(value, "_all"))
    b = box_moments(filled, shape, scale, "_v")
    d = F.when(F.col("std") == 0, 0.0).otherwise((F.col("_v") - F.col("mean")) / F.col("std"))
    return b.withColumn(out, F.when(F.col(value).isNotNull(), d)).select(*cells.columns, out)


def position_box(cells: DataFrame, shape: Shape, n: int, value: str = "z", out: str = "tpi") -> DataFrame:
    """Cell minus box mean, missing cells as zeros."""
    b = g.box(cells, shape, n, {"_s": F.coalesce(value, F.lit(0.0))})
    return b.withColumn(out, F.coalesce(value, F.lit(0.0)) - F.col("_s") / float(n * n)).select(*cells.columns, out)


def radius_cells(radius: float, cell: float) -> int:
    """Window size of a radius in map units."""
    return 2 * max(1, round(radius / cell)) + 1


def slope_cosine_complexity(cells: DataFrame, shape: Shape, value: str = "z", out: str = "secant") -> DataFrame:
    """One over the cosine of the slope averaged over 3 x 3."""
    s = slope(cells, shape, value, "_slope")
    b = g.box(s, shape, 3, {"_s": F.radians("_slope"), "_k": F.when(F.col("_slope").isNotNull(), 1)})
    return b.withColumn(out, 1 / F.cos(F.col("_s") / F.col("_k"))).select(*cells.columns, out)


FILTERS = ("median", "uniform", "gaussian", "minimum", "maximum", "percentile")


def scale_sizes(low: int, high: int, count: int) -> list[int]:
    """Whole window sizes evenly spread from ``low`` to ``high``."""
    return [int(low + (high - low) * k / (count - 1)) for k in range(count)] if count > 1 else [int(low)]


def extremes(cells: DataFrame, size: int, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Add, for each name, the ``minimum`` or ``maximum`` of a column over the size x size square around each cell.

    Cells beyond the raster's end mirror cells that the square holds already, so it is cut off there. Missing values
    count as nothing. The raster must be dense. Along rows, then down columns, the line is cut into
    blocks as long as the square; running extremes from either end of a block are combined for
    two cells of the line, so a cell costs the same at any size.
    """
    low, high = g.frame(size)
    for line, at in (("r", "c"), ("c", "r")):
        cells = cells.repartition(line).withColumn("_block", F.floor(F.col(at) / size))  # satisfies both windows below
        whole = Window.partitionBy(line).orderBy(at)
        ends = Window.partitionBy(line).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ahead, back = [Window.partitionBy(line, "_block").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(at), F.desc(at))]
        pick = {"minimum": (F.min, F.least), "maximum": (F.max, F.greatest)}
        for name, (kind, value) in wanted.items():
            run, best = pick[kind]
            source = F.col(value if line == "r" else name)
            cells = cells.withColumns({"_to": run(source).over(ahead), "_from": run(source).over(back)})
            begin = F.struct(F.col("_from").alias("v"), F.col("_block").alias("b"))
            left = F.lag(begin, -low).over(whole)
            right = F.coalesce(F.lead(F.struct(F.col("_to").alias("v"), F.col("_block").alias("b")), high).over(whole), F.last(F.struct(F.col("_to").alias("v"), F.col("_block").alias("b"))).over(ends))
            both = F.when(left["b"] == right["b"], left["v"]).otherwise(best(left["v"], right["v"]))
            cells = cells.withColumn(name, F.when(left.isNull(), right["v"]).otherwise(both)).drop("_to", "_from")
        cells = cells.drop("_block")
    return cells


def scale_filter(cells: DataFrame, shape: Shape, name: str, size: int, value: str = "z", q: float = 0.5) -> DataFrame:
    """Add ``filtered``: the median, mean, minimum, maximum or a percentile of the n x n square, or smoothing by a gaussian of deviation n."""
    if name not in FILTERS:
        raise ValueError(f"filter {name!r}; known: {', '.join(FILTERS)}")
    if size < 1:
        raise ValueError("the window must have at least one cell")
    if name == "uniform":
        return box_moments(cells, shape, size, value).withColumnRenamed("mean", "filtered").drop("std")
    if name == "gaussian":
        return cells.join(tiles.gaussian(cells, shape, float(size), value, "filtered").select("r", "c", "filtered"), ["r", "c"], "left")
    if name in ("minimum", "maximum"):
        return extremes(cells, size, {"filtered": (name, value)})
    agg = {"median": F.percentile("v", F.lit(0.5)), "percentile": F.percentile("v", F.lit(q))}[name]
    got = g.scatter(cells, shape, g.square(size), value, {"filtered": agg}).drop("e")
    return cells.join(got, ["r", "c"], "left")


def standardise(cells: DataFrame, value: str = "bpi", out: str = "std", legacy_zero_nodata: bool = False, legacy_round: bool = False) -> DataFrame:
    """Hundred times the z-score over all cells that are there, as an integer; a constant raster is an error.

    ``legacy_zero_nodata`` leaves out cells of value 0 from the statistics and from the result.
    """
    return standardise_all(cells, {value: out}, legacy_zero_nodata, legacy_round)


def standardise_all(cells: DataFrame, columns: dict[str, str], legacy_zero_nodata: bool = False, legacy_round: bool = False) -> DataFrame:
    """The same for several columns (input to output), whose statistics are one aggregate."""
    values = {c: F.nullif(F.col(c), F.lit(0)) if legacy_zero_nodata else F.col(c) for c in columns}
    m = cells.agg(*[a for c, v in values.items() for a in (F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"s_{c}"), F.count(v).alias(f"n_{c}"))]).first()
    out = {}
    for c, name in columns.items():
        if not m[f"n_{c}"]:
            out[name] = F.lit(0)
            continue
        if not m[f"s_{c}"]:
            raise ValueError(f"the values of {c} do not vary")
        x = (values[c] - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"]) * 100
        out[name] = (x + 0.5).cast("int") if legacy_round else F.rint(x).cast("int")
    return cells.withColumns(out)
