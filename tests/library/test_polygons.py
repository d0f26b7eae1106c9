"""Points in polygons cut up by squares, against every point and side; regions merged until none is small."""

import numpy as np
import pytest

from shoalgrid.operators import polygons, regions, zonal
from shoalgrid.operators.grid import Shape

RINGS = "fid long, rings array<array<struct<x:double,y:double>>>"


def brute(px, py, rings):
    """The even-odd rule along a ray to the right, a side's meeting place never beyond its ends."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            (lx, ly), (ux, uy) = ((ax, ay), (bx, by)) if ay <= by else ((bx, by), (ax, ay))
            if ly <= py < uy:
                n += px < min(max(lx + (ux - lx) * (py - ly) / (uy - ly), min(lx, ux)), max(lx, ux))
    return n % 2 == 1


def compare(spark, shapes, points, buckets):
    df = spark.createDataFrame(shapes, RINGS)
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    want = {(i, fid) for i, (px, py) in enumerate(points) for fid, rings in shapes if brute(px, py, rings)}
    for bucket in buckets:
        rows = [tuple(r) for r in zonal.within(at, df, bucket).collect()]
        assert len(rows) == len(set(rows)) and {r[0] for r in rows} == set(range(len(points)))
        assert {r for r in rows if r[1] is not None} == want
    return want


def test_points_in_crossing_rings(spark):
    g = np.random.default_rng(8)
    wild = [(k, [[tuple(map(float, p)) for p in g.uniform(-20, 20, (g.integers(3, 14), 2))] for _ in range(g.integers(1, 4))]) for k in range(8)]
    points = [tuple(map(float, p)) for p in g.uniform(-24, 24, (400, 2))]
    assert compare(spark, wild, points, [1.0, 6.0, 200.0])


def test_points_on_corners_and_borders_of_squares(spark):
    g = np.random.default_rng(9)
    whole = [(k, [[tuple(map(float, p)) for p in g.integers(-4, 5, (g.integers(3, 9), 2))] for _ in range(2)]) for k in range(12)]
    level = [(50, [[(-4.0, -2.0), (4.0, -2.0), (4.0, 2.0), (2.0, 2.0), (2.0, 0.0), (-2.0, 0.0), (-2.0, 2.0), (-4.0, 2.0)]]), (51, [[(1.0, 1.0)]]), (52, [[(0.0, 0.0), (2.0, 2.0)]])]
    points = [(x / 2, y / 2) for x in range(-10, 11) for y in range(-10, 11)]
    assert compare(spark, whole + level, points, [0.5, 1.0, 4.0])


def test_points_beside_thin_slanting_sides(spark):
    g = np.random.default_rng(10)
    thin = [(k, [[(0.1 * k, 0.3), (97.3 + k, 31.7 * k / 3), (97.3 + k, 31.7 * k / 3 + 1e-9), (0.1 * k, 0.3 + 1e-9)]]) for k in range(4)]
    points = []
    for _, ((a, b, *_),) in thin:
        for t in g.uniform(0, 1, 60).tolist():
            y = a[1] + t * (b[1] - a[1])
            points += [(a[0] + t * (b[0] - a[0]) + d, y) for d in (-1e-13, 0.0, 1e-13, 1e-9)]
    compare(spark, thin, points, [0.7, 8.0])


def test_polygons_without_places(spark):
    nan, inf = float("nan"), float("inf")
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes = [(1, [square]), (2, None), (3, []), (4, [[]]), (5, [[(0.0, 0.0), (nan, 1.0), (4.0, 4.0)], square]), (6, [[(0.0, 0.0), (inf, 1.0), (4.0, 4.0)]]), (7, [[(0.0, 0.0), (None, 1.0), (4.0, 4.0)]])]
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, nan, 1.0), (3, 1.0, inf), (4, None, 1.0), (5, -inf, -inf)], "id long, x double, y double")
    got = {tuple(r) for r in zonal.within(at, spark.createDataFrame(shapes, RINGS), 1.0).collect()}
    assert got == {(1, 1), (1, 5), (2, None), (3, None), (4, None), (5, None)}
    assert zonal.within(at.limit(0), spark.createDataFrame(shapes, RINGS), 1.0).count() == 0
    for bad in (0.0, -1.0, nan, inf):
        with pytest.raises(ValueError):
            zonal.within(at, spark.createDataFrame(shapes, RINGS), bad)


def test_a_square_holds_only_the_sides_that_reach_it(spark):
    n = 20_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = 500 + 20 * np.sin(40 * turn)
    ring = [(float(r * np.cos(a)), float(r * np.sin(a))) for r, a in zip(far, turn)]
    cover = polygons.cover(spark.createDataFrame([(1, [ring])], RINGS), 4.0).selectExpr("size(sides) as n", "inside").cache()
    most, total = cover.selectExpr("max(n)", "sum(n)").first()
    assert most < 200 and total < 5 * n and 45_000 < cover.count() < 56_000  # the area is 785,000, a square's 16
    points = [tuple(map(float, p)) for p in np.random.default_rng(3).uniform(-540, 540, (3_000, 2))]
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    got = {r["id"] for r in zonal.within(at, spark.createDataFrame([(1, [ring])], RINGS), 4.0).where("fid = 1").collect()}
    x, y = np.array(points).T
    gap = np.hypot(x, y) - (500 + 20 * np.sin(40 * np.arctan2(y, x)))
    sure = np.abs(gap) > 1  # a chord strays less than this from the curve
    assert {i for i in range(len(points)) if sure[i] and gap[i] < 0} == {i for i in got if sure[i]}


def flood(z):
    out, rows, cols = {}, len(z), len(z[0])
    for r in range(rows):
        for c in range(cols):
            todo = [(r, c)] if z[r][c] is not None and (r, c) not in out else []
            while todo:
                y, x = todo.pop()
                if (y, x) not in out:
                    out[y, x] = r * cols + c
                    todo += [(y + a, x + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + a < rows and 0 <= x + b < cols and z[y + a][x + b] == z[r][c]]
    return out


def merge_slowly(z, least):
    now = flood(z)
    while True:
        size, shared = {}, {}
        for at, k in now.items():
            size[k] = size.get(k, 0) + 1
            for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                o = now.get((at[0] + a, at[1] + b))
                if o is not None and o != k:
                    shared[k, o] = shared.get((k, o), 0) + 1
        picks = {k: min((-n, o) for (s, o), n in shared.items() if s == k)[1] for k in size if size[k] < least and any(s == k for s, _ in shared)}
        if not picks:
            return now
        name = {k: k for k in size}
        for _ in size:
            for a, b in picks.items():
                name[a] = name[b] = min(name[a], name[b])
        now = {at: name[k] for at, k in now.items()}


@pytest.mark.parametrize("least", [1, 4, 25])
def test_merged_regions_match_a_loop(spark, least):
    g = np.random.default_rng(4)
    z = [[None if g.random() < 0.15 else int(g.integers(0, 3)) for _ in range(14)] for _ in range(11)]
    cells = spark.createDataFrame([(r, c, z[r][c], -1) for r in range(11) for c in range(14)], "r int, c int, z int, region int")
    got = regions.merged(cells, Shape(11, 14, 1.0), "z", least)
    assert got.columns == ["r", "c", "z", "region"]
    assert {(r["r"], r["c"]): r["region"] for r in got.collect() if r["region"] is not None} == merge_slowly(z, least)


def test_nothing_to_merge(spark):
    empty = spark.createDataFrame([], "r int, c int, z int")
    assert regions.merged(empty, Shape(0, 0, 1.0), "z", 5).count() == 0
    none = spark.createDataFrame([(0, 0, None), (0, 1, None)], "r int, c int, z int")
    assert [r["region"] for r in regions.merged(none, Shape(1, 2, 1.0), "z", 5).collect()] == [None, None]
