"""Queries over rasters, each beside SQL that says the same by joins on offsets.

The inventory ids in the comments are those of the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.functions.edges import sql_index
from shoalgrid.operators import classify as cl
from shoalgrid.operators import terrain as t
from shoalgrid.plans import views
from shoalgrid.plans.views import BOTH_SQL, DICTIONARY, GRID_SQL, SIZE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def around(span: str, mode: str, value: str = "z", grid: str = "g", name: str = "nb") -> str:
    """CTE of (r, c, dr, dc, v): what each cell sees at each offset of ``span``, a list of (dr, dc)."""
    r, c = sql_index("g.r + o.dr", "nr", mode), sql_index("g.c + o.dc", "nc", mode)
    return f"{name} AS (SELECT g.r, g.c, o.dr, o.dc, s.{value} AS v FROM {grid} g CROSS JOIN n CROSS JOIN ({span}) o LEFT JOIN {grid} s ON s.r = {r} AND s.c = {c})"


def offsets(lo: int, hi: int, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT y.v AS dr, x.v AS dc FROM (SELECT unnest(range({lo}, {hi + 1})) AS v) y, (SELECT unnest(range({lo}, {hi + 1})) AS v) x) WHERE {where}"


def ring_sql(mode: str, value: str = "z", grid: str = "g", name: str = "ring") -> str:
    letters = ", ".join(f"max(v) FILTER (dr = {y} AND dc = {x}) AS {k}" for k, (y, x) in zip("abcdefghi", [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
    return f"{around(offsets(-1, 1), mode, value, grid, name + '_nb')}, {name} AS (SELECT r, c, {letters} FROM {name}_nb GROUP BY r, c)"


BASE = f"WITH {GRID_SQL}, {SIZE_SQL}"
DX, DY = "((c_ + 2 * f + i) - (a + 2 * d + g)) / 8", "((a + 2 * b + c_) - (g + 2 * h + i)) / 8"


def horn(ring: str) -> str:
    """Select list source with the letters and both gradients; the letter c is called c_ beside the column."""
    return f"(SELECT *, {DX} AS dx, {DY} AS dy FROM {ring}) q"


def ring3(mode: str, value: str = "z", grid: str = "g", name: str = "ring") -> str:
    return ring_sql(mode, value, grid, name).replace(" AS c,", " AS c_,")


def annulus_sql(inner: int, outer: int) -> str:
    return offsets(-outer, outer, f"dr * dr + dc * dc BETWEEN {inner * inner} AND {outer * outer}")


def bpi_sql(inner: int, outer: int, name: str) -> str:
    return f"{around(annulus_sql(inner, outer), 'symmetric', name=name + '_nb')}, {name} AS (SELECT g.r, g.c, g.z, CAST(round_even(g.z - m, 0) AS INT) AS bpi FROM g JOIN (SELECT r, c, avg(v) AS m FROM {name}_nb GROUP BY r, c) USING (r, c))"


def std_sql(source: str, name: str) -> str:
    return f"{name} AS (SELECT r, c, CAST(round_even((bpi - m) / s * 100, 0) AS INT) AS std FROM {source}, (SELECT avg(bpi) AS m, stddev_pop(bpi) AS s FROM {source}))"


SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"


def cascade_sql(columns: dict[str, str], names: bool = False, legacy: bool = False) -> str:
    out = "CASE"
    for e in DICTIONARY:
        parts = []
        for k, x in columns.items():
            lo, hi = getattr(e, f"{k}_lower"), getattr(e, f"{k}_upper")
            both = legacy and lo is not None and hi is not None
            parts += [] if lo is None else [f"{x} {'>' if both else '>='} {lo}"]
            parts += [] if hi is None else [f"{x} {'<=' if legacy and not both else '<'} {hi}"]
        out += f" WHEN {' AND '.join(parts)} THEN " + (f"'{e.name}'" if names else str(e.code))
    return out + (" END" if names else " ELSE 0 END")


def habitat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, broad and fine standardised position and slope in one frame."""
    cells = views.depth_grid(spark, sf_dir)
    return t.habitat_layers(cells, views.shape(cells))


HABITAT_SQL = (
    f"{BASE}, {bpi_sql(1, 5, 'b5')}, {bpi_sql(1, 3, 'b3')}, {std_sql('b5', 's5')}, {std_sql('b3', 's3')}, {ring3('reflect')}, "
    f"hab AS (SELECT g.r, g.c, g.z, b5.bpi AS broad_bpi, b3.bpi AS fine_bpi, s5.std AS broad, s3.std AS fine, {SLOPE} AS slope FROM g "
    f"JOIN b5 USING (r, c) JOIN b3 USING (r, c) JOIN s5 USING (r, c) JOIN s3 USING (r, c) JOIN {horn('ring')} USING (r, c))"
)
INPUTS = {"broad": "broad", "fine": "fine", "slope": "slope", "depth": "z"}


@query(f"{HABITAT_SQL} SELECT {cascade_sql(INPUTS)} AS code, count(*) AS n FROM hab GROUP BY 1")
def habitat_histogram(spark, sf_dir):  # O-F1 O-F2 A1 O-F3 P3 P4 A4, the full model
    return cl.class_histogram(cl.classify(habitat(spark, sf_dir), DICTIONARY))


@query(f"{HABITAT_SQL} SELECT r, c, broad, fine, round(slope, 6) AS slope, {cascade_sql(INPUTS)} AS code, {cascade_sql(INPUTS, True)} AS zone FROM hab")
def habitat_zones(spark, sf_dir):  # L13 with zone names
    h = cl.classify(habitat(spark, sf_dir), DICTIONARY, zone="zone")
    return rounded(h.select("r", "c", "broad", "fine", "slope", "code", "zone"), "slope")


@query(f"{HABITAT_SQL} SELECT {cascade_sql(INPUTS, legacy=True)} AS code, count(*) AS n FROM hab GROUP BY 1")
def habitat_legacy_bounds(spark, sf_dir):  # T7 L12
    return cl.class_histogram(cl.classify(habitat(spark, sf_dir), DICTIONARY, legacy_bounds=True))


@query(f"{HABITAT_SQL} SELECT r, c, CASE WHEN broad_bpi >= sd THEN 1 WHEN broad_bpi <= -sd THEN 2 WHEN slope <= 40 THEN 3 ELSE 4 END AS zone FROM hab, (SELECT stddev_pop(broad_bpi) AS sd FROM hab)")
def zone_classes(spark, sf_dir):  # L15
    return cl.zone_class(habitat(spark, sf_dir), "broad_bpi", "slope", 1.0, 40.0).select("r", "c", "zone")


@query(f"""{HABITAT_SQL} SELECT r, c, CASE
  WHEN broad <= -100 AND fine <= -100 THEN 1 WHEN broad > -100 AND broad < 100 AND fine <= -100 AND slope <= 40 THEN 2
  WHEN broad > -100 AND broad < 100 AND fine <= -100 AND slope > 40 THEN 3 WHEN broad >= 100 AND fine <= -100 THEN 4
  WHEN broad <= -100 AND fine > -100 AND fine < 100 THEN 5 WHEN broad > -100 AND fine > -100 AND fine < 100 AND slope <= 40 AND z < -8 THEN 6
  WHEN broad > -100 AND fine > -100 AND fine < 100 AND slope <= 40 AND z >= -8 THEN 7 WHEN broad > -100 AND fine > -100 AND fine < 100 AND slope > 40 AND slope <= 60 THEN 8
  WHEN broad <= -100 AND fine >= 100 THEN 9 WHEN broad > -100 AND broad < 100 AND fine >= 100 AND slope <= 40 THEN 10
  WHEN broad > -100 AND broad < 100 AND fine >= 100 AND slope > 40 THEN 11 WHEN broad >= 100 AND fine >= 100 THEN 12
  WHEN broad > -100 AND fine > -100 AND fine < 100 AND slope > 60 THEN 13 END AS structure FROM hab""")
def structure_classes(spark, sf_dir):  # L16
    return cl.structure_class(habitat(spark, sf_dir), "broad", "fine", "slope", "z", gentle=40.0, steep=60.0, shelf=-8.0).select("r", "c", "structure")


@query(f"{BASE}, {bpi_sql(2, 9, 'b')} SELECT r, c, bpi FROM b")
def position_annulus(spark, sf_dir):  # O-F2
    cells = views.depth_grid(spark, sf_dir)
    return t.position_index(cells, views.shape(cells), 2, 9).select("r", "c", "bpi")


@query(f"WITH {BOTH_SQL}, {SIZE_SQL}, {around(annulus_sql(1, 3), 'symmetric', 'k')} SELECT g.r, g.c, CAST(trunc(g.k - m + 0.5) AS INT) AS bpi FROM g JOIN (SELECT r, c, avg(v) AS m FROM nb GROUP BY r, c) USING (r, c)")
def position_legacy(spark, sf_dir):  # L1 L17: other rounding, over a raster with gaps
    cells = views.both_grids(spark, sf_dir)
    return t.position_index(cells, views.shape(cells), 1, 3, "k", legacy_round=True, in_order=True).select("r", "c", "bpi")


@query(f"{BASE}, {ring3('reflect')} SELECT r, c, round({SLOPE}, 6) AS slope FROM {horn('ring')}")
def slope_degrees(spark, sf_dir):  # O-F3 O-F4
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.slope(cells, views.shape(cells)).select("r", "c", "slope"), "slope")


@query(f"WITH {BOTH_SQL}, {SIZE_SQL}, {ring3('reflect', 'k')} SELECT r, c, CASE WHEN e IS NOT NULL THEN round({SLOPE}, 6) END AS slope FROM {horn('ring')}")
def slope_with_gaps(spark, sf_dir):  # O-F3, missing cells spread to their neighbours
    cells = views.both_grids(spark, sf_dir)
    return rounded(t.slope(cells, views.shape(cells), "k").select("r", "c", "slope"), "slope")


def vrm_sql(n: int, ring: str) -> str:
    """Ruggedness over n x n of a raster without gaps, from a ring by reflection."""
    lo = -(n // 2)
    return f"""SELECT w.r, w.c, greatest(0, least(1, 1 - sqrt(sum(x.ux) ** 2 + sum(x.uy) ** 2 + sum(x.uz) ** 2) / {n * n})) AS vrm
FROM (SELECT q.r, q.c, o.dr, o.dc FROM {ring} q CROSS JOIN ({offsets(lo, lo + n - 1)}) o) w CROSS JOIN n JOIN (SELECT r, c, cos(s) AS uz,
  CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE sin(radians(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END)) * sin(s) END AS ux, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE cos(radians(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END)) * sin(s) END AS uy
  FROM (SELECT r, c, dx, dy, atan(sqrt(dx * dx + dy * dy)) AS s, 90 - degrees(atan2(-dy, dx)) AS deg FROM {horn(ring)})) x
ON x.r = {sql_index('w.r + w.dr', 'nr', 'symmetric')} AND x.c = {sql_index('w.c + w.dc', 'nc', 'symmetric')} GROUP BY w.r, w.c"""


VRM_SQL = f"""WITH {BOTH_SQL}, {SIZE_SQL}, f AS (SELECT r, c, coalesce(k, 0) AS z0, k FROM g), {ring3('reflect', 'z0', 'f')},
a AS (SELECT r, c, atan(sqrt(dx * dx + dy * dy)) AS s, dx, dy, 90 - degrees(atan2(-dy, dx)) AS deg FROM {horn('ring')}),
u AS (SELECT r, c, k, CASE WHEN k IS NULL OR (dx = 0 AND dy = 0) THEN 0 ELSE sin(radians(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END)) * sin(s) END AS ux,
  CASE WHEN k IS NULL OR (dx = 0 AND dy = 0) THEN 0 ELSE cos(radians(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END)) * sin(s) END AS uy,
  CASE WHEN k IS NULL THEN 0 ELSE cos(s) END AS uz FROM a JOIN f USING (r, c)),
w AS (SELECT u.r, u.c, u.k, o.dr, o.dc FROM u CROSS JOIN ({offsets(-2, 2)}) o),
m AS (SELECT w.r, w.c, max(w.k) AS k, sum(x.ux) AS sx, sum(x.uy) AS sy, sum(x.uz) AS sz FROM w CROSS JOIN n JOIN u x ON x.r = {sql_index('w.r + w.dr', 'nr', 'symmetric')} AND x.c = {sql_index('w.c + w.dc', 'nc', 'symmetric')} GROUP BY w.r, w.c)
SELECT r, c, CASE WHEN k IS NOT NULL THEN round(greatest(0, least(1, 1 - sqrt(sx * sx + sy * sy + sz * sz) / 25)), 6) END AS vrm FROM m"""


@query(VRM_SQL)
def vector_ruggedness(spark, sf_dir):  # O-F5 L5
    cells = views.both_grids(spark, sf_dir)
    return rounded(t.ruggedness(cells, views.shape(cells), 5, "k").select("r", "c", "vrm"), "vrm")


def _triangle(p: str, q: str) -> str:
    x, y, z = f"(sqrt((e - {p}) ** 2 + 2) / 2)", f"(sqrt((e - {q}) ** 2 + 1) / 2)", f"(sqrt(({p} - {q}) ** 2 + 1) / 2)"
    h = f"(({x} + {y} + {z}) / 2)"
    return f"sqrt(greatest({h} * ({h} - {x}) * ({h} - {y}) * ({h} - {z}), 0))"


AREA = " + ".join(_triangle(*p) for p in (("a", "b"), ("c_", "b"), ("c_", "f"), ("i", "f"), ("i", "h"), ("g", "h"), ("g", "d"), ("a", "d")))


@query(f"{BASE}, {ring3('clamp')} SELECT r, c, round({AREA}, 6) AS surface_ratio, round(({AREA}) * cos(atan(sqrt(dx * dx + dy * dy))), 6) AS corrected, round({AREA}, 6) AS area FROM {horn('ring')}")
def surface_planar_ratio(spark, sf_dir):  # O-F6 O-F7 L6
    cells = views.depth_grid(spark, sf_dir)
    s = views.shape(cells)
    out = t.surface_ratio(cells, s, area="area", also_corrected="corrected")
    return rounded(out.select("r", "c", "surface_ratio", "corrected", "area"), "surface_ratio", "corrected", "area")


@query(f"{BASE}, {ring3('reflect')} SELECT r, c, round(CASE WHEN dx <> 0 OR dy <> 0 THEN -dx / sqrt(dx * dx + dy * dy) END, 6) AS aspect_sin, round(CASE WHEN dx <> 0 OR dy <> 0 THEN -dy / sqrt(dx * dx + dy * dy) END, 6) AS aspect_cos FROM {horn('ring')}")
def aspect_sin_cos(spark, sf_dir):  # L4 O-F24
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.statistical_aspect(cells, views.shape(cells)).drop("z"), "aspect_sin", "aspect_cos")


@query(f"{BASE}, {ring3('clamp')} SELECT r, c, round(cos(atan2(-dx, -dy)), 6) AS northness, round(sin(atan2(-dx, -dy)), 6) AS eastness FROM {horn('ring')}")
def northness_eastness(spark, sf_dir):  # O-F11
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.northness_eastness(cells, views.shape(cells)).drop("z"), "northness", "eastness")


@query(f"""{BASE}, {ring3('clamp')}, h AS (SELECT r, c, d - 2 * e + f AS p, b - 2 * e + h AS q, (c_ + g - a - i) / 4 AS s FROM ring)
SELECT r, c, round(greatest(abs((p + q + sqrt((p - q) ** 2 + 4 * s * s)) / 2), abs((p + q - sqrt((p - q) ** 2 + 4 * s * s)) / 2)), 6) AS max_curvature FROM h""")
def curvature(spark, sf_dir):  # O-F12
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.max_curvature(cells, views.shape(cells)).drop("z"), "max_curvature")


@query(f"""{BASE}, {ring3('clamp')}, s1 AS (SELECT r, c, {SLOPE} AS s FROM {horn('ring')}), {ring3('clamp', 's', 's1', 'again')} SELECT r, c, round(sqrt(dx * dx + dy * dy), 6) AS complexity FROM {horn('again')}""")
def slope_complexity(spark, sf_dir):  # O-F13
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.complexity(cells, views.shape(cells)).drop("z"), "complexity")


@query(f"{BASE}, {ring3('symmetric')} SELECT r, c, round(abs(b + d + f + h - 4 * e), 6) AS laplacian FROM ring")
def laplacian(spark, sf_dir):  # O-F20
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.laplacian_curvature(cells, views.shape(cells)).drop("z"), "laplacian")


@query(f"{BASE}, {ring3('clamp')} SELECT r, c, round((h - b) / CASE WHEN r = 0 OR r = nr - 1 THEN 1 ELSE 2 END, 6) AS dy, round((f - d) / CASE WHEN c = 0 OR c = nc - 1 THEN 1 ELSE 2 END, 6) AS dx FROM ring, n")
def central_gradient(spark, sf_dir):  # O-F21 O-F26
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.gradient(cells, views.shape(cells)).drop("z"), "dy", "dx")


def _stats_sql(span: str) -> str:
    return f"""WITH {BOTH_SQL}, {SIZE_SQL}, {around(span, 'symmetric', 'k')},
m AS (SELECT r, c, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) ** 2, 0)) AS sd FROM nb GROUP BY r, c),
d AS (SELECT g.r, g.c, k, mean, sd, abs(k - mean) AS z FROM g JOIN m USING (r, c)),
{around(span, 'symmetric', 'z', 'd', 'nd')}, md AS (SELECT r, c, avg(v) AS mad FROM nd GROUP BY r, c)
SELECT r, c, CASE WHEN k IS NOT NULL THEN round(mean, 6) END AS stat_mean, CASE WHEN k IS NOT NULL THEN round(sd, 5) END AS stat_std, CASE WHEN k IS NOT NULL THEN round(sd * sd, 5) END AS stat_variance,
  CASE WHEN k IS NOT NULL THEN CASE WHEN mad = 0 THEN 0 ELSE round((k - mean) / mad, 6) END END AS stat_mean_diff FROM d JOIN md USING (r, c)"""


def _stats(spark, sf_dir, window):
    cells = views.both_grids(spark, sf_dir)
    out = t.focal_stats(cells, views.shape(cells), 5, ("mean", "std", "variance", "mean_diff"), window, "k").drop("z", "k")
    return rounded(rounded(out, "stat_mean", "stat_mean_diff"), "stat_std", "stat_variance", digits=5)


@query(_stats_sql(offsets(-2, 2)))
def focal_square(spark, sf_dir):  # O-F8 a-c
    return _stats(spark, sf_dir, "rectangle")


@query(_stats_sql(annulus_sql(0, 2)))
def focal_circle(spark, sf_dir):  # O-F8 a-c
    return _stats(spark, sf_dir, "circle")


@query(f"""WITH {BOTH_SQL}, {SIZE_SQL}, {around(offsets(-1, 1), 'none', 'k')},
m AS (SELECT r, c, count(v) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, kurtosis_pop(v) AS ku FROM nb GROUP BY r, c)
SELECT r, c, CASE WHEN n = 9 THEN round(iqr, 6) END AS stat_iqr, CASE WHEN n = 9 THEN round(ku, 5) END AS stat_kurtosis FROM m""")
def focal_order_stats(spark, sf_dir):  # O-F8 d e
    cells = views.both_grids(spark, sf_dir)
    out = t.focal_stats(cells, views.shape(cells), 3, ("iqr", "kurtosis"), value="k").drop("z", "k")
    return rounded(rounded(out, "stat_iqr"), "stat_kurtosis", digits=5)


@query(f"""WITH {BOTH_SQL}, {SIZE_SQL}, {around(offsets(-1, 1), 'symmetric', 'k', name='n3')}, {around(offsets(-4, 4), 'symmetric', 'k', name='n9')}
SELECT g.r, g.c, CASE WHEN k IS NOT NULL THEN round(a / 9, 6) END AS k_3, CASE WHEN k IS NOT NULL THEN round(b / 81, 6) END AS k_9
FROM g JOIN (SELECT r, c, sum(coalesce(v, 0)) AS a FROM n3 GROUP BY r, c) USING (r, c) JOIN (SELECT r, c, sum(coalesce(v, 0)) AS b FROM n9 GROUP BY r, c) USING (r, c)""")
def multiscale_means(spark, sf_dir):  # O-F9 O-F16
    cells = views.both_grids(spark, sf_dir)
    return rounded(t.multiscale_mean(cells, views.shape(cells), [3, 9], "k").drop("z", "k"), "k_3", "k_9")


@query(f"""WITH {BOTH_SQL}, {SIZE_SQL}, f AS (SELECT r, c, k, coalesce(k, (SELECT avg(k) FROM g)) AS z0 FROM g), {around(offsets(-2, 2), 'symmetric', 'z0', 'f')},
m AS (SELECT r, c, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) ** 2, 0)) AS sd FROM nb GROUP BY r, c)
SELECT r, c, CASE WHEN k IS NOT NULL THEN CASE WHEN sd = 0 THEN 0 ELSE round((z0 - mean) / sd, 5) END END AS rdmv FROM f JOIN m USING (r, c)""")
def relative_deviation(spark, sf_dir):  # O-F10
    cells = views.both_grids(spark, sf_dir)
    return rounded(t.relative_deviation(cells, views.shape(cells), 5, "k").drop("z", "k"), "rdmv", digits=5)


@query(f"{BASE}, {around(offsets(-5, 5), 'symmetric')} SELECT g.r, g.c, round(g.z - s / 121, 6) AS tpi FROM g JOIN (SELECT r, c, sum(v) AS s FROM nb GROUP BY r, c) USING (r, c)")
def position_box(spark, sf_dir):  # O-F17 O-F18 O-F22 O-F25
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.position_box(cells, views.shape(cells), t.radius_cells(5.0, 1.0)).drop("z"), "tpi")


@query(f"{BASE}, {around(offsets(-1, 1), 'symmetric')} SELECT r, c, round(median(v), 6) AS median, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum, round(quantile_cont(v, 0.9), 6) AS p90 FROM nb GROUP BY r, c")
def scale_filters(spark, sf_dir):  # O-F15 L10
    cells = views.depth_grid(spark, sf_dir)
    s = views.shape(cells)
    out = cells
    for k, (name, q) in {"median": ("median", 0.5), "minimum": ("minimum", 0.5), "maximum": ("maximum", 0.5), "p90": ("percentile", 0.9)}.items():
        out = out.join(t.scale_filter(cells, s, name, 3, q=q).select("r", "c", F.col("filtered").alias(k)), ["r", "c"])
    return rounded(out.select("r", "c", "median", "minimum", "maximum", "p90"), "median", "minimum", "maximum", "p90")


@query(f"{BASE} SELECT a.r, a.c, round(min(b.z), 6) AS lowest, round(max(b.z), 6) AS highest FROM g a JOIN g b ON b.r BETWEEN a.r - 15 AND a.r + 15 AND b.c BETWEEN a.c - 15 AND a.c + 15 GROUP BY a.r, a.c")
def wide_extremes(spark, sf_dir):  # O-F15 O-F8d
    out = t.extremes(views.depth_grid(spark, sf_dir), 31, {"lowest": ("minimum", "z"), "highest": ("maximum", "z")})
    return rounded(out.select("r", "c", "lowest", "highest"), "lowest", "highest")


@query(f"{BASE}, {ring3('reflect')}, s1 AS (SELECT r, c, radians({SLOPE}) AS s FROM {horn('ring')}), {around(offsets(-1, 1), 'symmetric', 's', 's1')} SELECT r, c, round(1 / cos(avg(v)), 6) AS secant FROM nb GROUP BY r, c")
def slope_secant(spark, sf_dir):  # O-F19
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.slope_cosine_complexity(cells, views.shape(cells)).drop("z"), "secant")


@query(f"{BASE}, {bpi_sql(1, 3, 'b')} SELECT r, c, CAST(round_even((bpi - m) / s * 100, 0) AS INT) AS std, CASE WHEN bpi <> 0 THEN CAST(round_even((bpi - m0) / s0 * 100, 0) AS INT) END AS std_legacy FROM b, (SELECT avg(bpi) AS m, stddev_pop(bpi) AS s, avg(nullif(bpi, 0)) AS m0, stddev_pop(nullif(bpi, 0)) AS s0 FROM b)")
def standardised(spark, sf_dir):  # A1 A2 L2
    cells = views.depth_grid(spark, sf_dir)
    b = t.position_index(cells, views.shape(cells), 1, 3)
    return t.standardise(t.standardise(b), out="std_legacy", legacy_zero_nodata=True).select("r", "c", "std", "std_legacy")


@query(f"WITH {BOTH_SQL} SELECT count(*) AS cells, count(k) AS filled, round(min(k), 6) AS lo, round(max(k), 6) AS hi, round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS std, round(1 - count(k) / count(*), 6) AS missing FROM g")
def raster_properties(spark, sf_dir):  # S18 A3 A25
    return rounded(t.raster_properties(views.both_grids(spark, sf_dir), "k"), "lo", "hi", "mean", "std", "missing")
