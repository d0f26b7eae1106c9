"""Raster operators against NumPy loops and the properties they must have."""

import numpy as np
import pytest

from shoalgrid.operators import classify, grid, terrain
from shoalgrid.operators.grid import Shape


def cells(spark, z, nodata=None):
    rows = [(r, c, None if nodata is not None and z[r, c] == nodata else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, z double")


def back(df, column, shape):
    out = np.full(shape, np.nan)
    for x in df.select("r", "c", column).collect():
        if x[2] is not None:
            out[x[0], x[1]] = x[2]
    return out


@pytest.fixture(scope="module")
def rough():
    z = np.random.default_rng(4).normal(-20, 3, (13, 11))
    z[5, 5] = z[0, 3] = -9999
    return z


def shape(z, cell=1.0):
    return Shape(*z.shape, cell)


def nan(z):
    return np.where(z == -9999, np.nan, z)


def test_position_index_matches_numpy(spark, rough):
    df = cells(spark, rough, -9999)
    got = back(terrain.position_index(df, shape(rough), 1, 4), "bpi", rough.shape)
    wide = np.pad(nan(rough), 4, "symmetric")
    foot = grid.annulus(1, 4)
    want = np.array([[np.rint(nan(rough)[r, c] - np.nanmean([wide[r + 4 + y, c + 4 + x] for y, x in foot])) for c in range(11)] for r in range(13)])
    assert np.array_equal(got, want, equal_nan=True)


def test_position_index_properties(spark):
    flat = np.full((9, 9), -30.0)
    assert (back(terrain.position_index(cells(spark, flat), shape(flat), 1, 3), "bpi", flat.shape) == 0).all()
    bump = np.zeros((11, 11))
    bump[5, 5] = 100
    assert back(terrain.position_index(cells(spark, bump), shape(bump), 1, 3), "bpi", bump.shape)[5, 5] > 0
    with pytest.raises(ValueError):
        terrain.position_index(cells(spark, flat), shape(flat), 3, 3)


def test_scatter_runs_and_box_agree(spark, rough):
    from pyspark.sql import functions as F

    df, s = cells(spark, rough, -9999), shape(rough)
    one = back(grid.scatter(df, s, grid.disc(3), "z", {"m": F.avg("v")}), "m", rough.shape)
    two = grid.runs(df, s, 0, 3, "z")
    assert np.allclose(one, back(two.withColumn("m", F.col("total") / F.col("n")), "m", rough.shape))
    for n in (3, 4, 70):
        b = back(grid.box(df, s, n, {"t": F.col("z")}), "t", rough.shape)
        h = n // 2
        wide = np.pad(nan(rough), n, "symmetric")
        want = [[np.nansum(wide[r + n - h : r + n - h + n, c + n - h : c + n - h + n]) for c in range(11)] for r in range(13)]
        assert np.allclose(b, want)


@pytest.mark.parametrize("mode", ["symmetric", "reflect", "clamp"])
def test_ring_matches_padding(spark, mode):
    z = np.arange(20.0).reshape(4, 5)
    df = grid.ring(cells(spark, z), "z", mode)
    wide = np.pad(z, 1, {"clamp": "edge"}.get(mode, mode))
    for k, (y, x) in zip("abcdefghi", [(y, x) for y in range(3) for x in range(3)]):
        assert np.array_equal(back(df, f"_{k}", z.shape), wide[y : y + 4, x : x + 5])


def test_slope_values(spark):
    ramp = np.tile(np.arange(20.0), (20, 1))
    got = back(terrain.slope(cells(spark, ramp), shape(ramp)), "slope", ramp.shape)
    assert np.allclose(got[1:-1, 1:-1], 45)
    flat = np.full((6, 6), 3.0)
    assert (back(terrain.slope(cells(spark, flat), shape(flat)), "slope", flat.shape) == 0).all()
    hole = np.full((7, 7), -30.0)
    hole[3, 3] = -9999
    got = back(terrain.slope(cells(spark, hole, -9999), shape(hole)), "slope", hole.shape)
    assert np.isnan(got[2:5, 2:5]).all() and np.isnan(got).sum() == 9


def test_ruggedness_ratio_and_curvature(spark, rough):
    flat = np.full((8, 8), -5.0)
    df = cells(spark, flat)
    assert np.allclose(back(terrain.ruggedness(df, shape(flat)), "vrm", flat.shape), 0, atol=1e-9)
    assert np.allclose(back(terrain.surface_ratio(df, shape(flat)), "surface_ratio", flat.shape), 1)
    assert np.allclose(back(terrain.max_curvature(df, shape(flat)), "max_curvature", flat.shape), 0)
    got = back(terrain.ruggedness(cells(spark, rough, -9999), shape(rough)), "vrm", rough.shape)
    assert np.nanmin(got) >= 0 and np.nanmax(got) <= 1 and np.isnan(got).sum() == 2
    plane = np.add.outer(np.arange(8.0), 2 * np.arange(8.0))
    assert np.allclose(back(terrain.surface_ratio(cells(spark, plane), shape(plane)), "surface_ratio", plane.shape)[1:-1, 1:-1], np.sqrt(6))
    with pytest.raises(ValueError):
        terrain.ruggedness(df, shape(flat), 1)


def test_northness_of_ramps(spark):
    ramp = np.tile(np.arange(8.0)[:, None], (1, 8))  # higher to the south: faces north
    got = terrain.northness_eastness(cells(spark, ramp), shape(ramp))
    assert np.allclose(back(got, "northness", ramp.shape)[1:-1, 1:-1], 1)
    flat = np.zeros((5, 5))
    assert np.isnan(back(terrain.northness_eastness(cells(spark, flat), shape(flat)), "eastness", flat.shape)).all()


def test_focal_stats(spark, rough):
    df, s = cells(spark, rough, -9999), shape(rough)
    out = terrain.focal_stats(df, s, 3)
    m, sd, var = (back(out, f"stat_{k}", rough.shape) for k in ("mean", "std", "variance"))
    assert np.allclose(sd**2, var, equal_nan=True)
    wide = np.pad(nan(rough), 1, "symmetric")
    assert np.allclose(m, [[np.nanmean(wide[r : r + 3, c : c + 3]) if rough[r, c] != -9999 else np.nan for c in range(11)] for r in range(13)], equal_nan=True)
    iqr = back(out, "stat_iqr", rough.shape)
    assert np.isnan(iqr[0]).all() and np.isnan(iqr[4:7, 4:7]).all()
    q = np.percentile(rough[8:11, 4:7], [25, 75])
    assert iqr[9, 5] == pytest.approx(q[1] - q[0])
    with pytest.raises(ValueError, match="Unknown stat"):
        terrain.focal_stats(df, s, 3, ("nothing",))


def test_relative_deviation_and_filters(spark, rough):
    flat = np.full((6, 6), 2.0)
    assert (back(terrain.relative_deviation(cells(spark, flat), shape(flat), 3), "rdmv", flat.shape) == 0).all()
    got = back(terrain.scale_filter(cells(spark, rough), shape(rough), "median", 3), "filtered", rough.shape)
    wide = np.pad(rough, 1, "symmetric")
    assert np.allclose(got, [[np.median(wide[r : r + 3, c : c + 3]) for c in range(11)] for r in range(13)])
    assert terrain.scale_sizes(3, 11, 5) == [3, 5, 7, 9, 11]
    with pytest.raises(ValueError):
        terrain.scale_filter(cells(spark, rough), shape(rough), "sobel", 3)


def test_standardise(spark):
    z = np.array([[0.0, 100, 200, 300, 400]])
    got = back(terrain.standardise(cells(spark, z), "z"), "std", z.shape)
    assert got.tolist() == [[-141, -71, 0, 71, 141]]
    with pytest.raises(ValueError):
        terrain.standardise(cells(spark, np.ones((2, 2))), "z")
    z = np.array([[1.0, 2, 3, -9999]])
    assert np.isnan(back(terrain.standardise(cells(spark, z, -9999), "z"), "std", z.shape)[0, 3])


def test_cascade(spark):
    e = [classify.ClassEntry(1, "low", None, 0), classify.ClassEntry(2, "all"), classify.ClassEntry(3, "never")]
    df = spark.createDataFrame([(-1, 0, 0.0, -5.0), (0, 0, 0.0, -5.0), (5, 0, None, -5.0)], "broad int, fine int, slope double, z double")
    got = classify.classify(df, e, zone="zone").orderBy("broad").collect()
    assert [(r["code"], r["zone"]) for r in got] == [(1, "low"), (2, "all"), (0, None)]
    assert [r["code"] for r in classify.classify(df, e[:1], legacy_bounds=True).orderBy("broad").collect()] == [1, 1, 0]
    with pytest.raises(ValueError):
        classify.classify(df, [])


def test_gaussian_and_blocks(spark):
    from shoalgrid.operators import tiles

    z = np.random.default_rng(1).normal(size=(25, 18))
    got = tiles.gaussian(cells(spark, z), shape(z), 1.5, block=8)
    k = np.arange(-6, 7)
    w = np.exp(-(k**2) / (2 * 1.5**2))
    w /= w.sum()
    wide = np.pad(z, 6, "symmetric")
    want = np.array([[(wide[r : r + 13, c : c + 13] * np.outer(w, w)).sum() for c in range(18)] for r in range(25)])
    assert np.allclose(back(got, "smooth", z.shape), want)
    same = tiles.process(cells(spark, z), shape(z), lambda b: b, "z", 7, 2, mode="none")
    assert np.allclose(back(same, "out", z.shape), z)
    curv = tiles.smoothed_curvature(cells(spark, z), shape(z), 1.0)
    assert curv.count() == z.size


def test_regions_match_a_walk(spark):
    from shoalgrid.operators import regions

    rng = np.random.default_rng(9)
    z = rng.integers(0, 3, (12, 15))
    z[3, 4] = -9999
    df = cells(spark, z.astype(float), -9999)
    got = back(regions.connected(df, shape(z), "z"), "region", z.shape)
    want = np.full(z.shape, np.nan)
    for r in range(12):
        for c in range(15):
            if z[r, c] != -9999 and np.isnan(want[r, c]):
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 12 and 0 <= x < 15 and np.isnan(want[y, x]) and z[y, x] == z[r, c]:
                        want[y, x] = r * 15 + c
                        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    assert np.array_equal(got, want, equal_nan=True)


def test_winding_regions_are_whole(spark):
    from shoalgrid.operators import regions

    z = np.zeros((41, 41))  # a spiral of one cell's width, and what lies between its arms
    r, c, d, n = 0, -1, 0, 41
    steps = [n] + [k for k in range(n - 1, 0, -2) for _ in range(2)]
    for length in steps:
        for _ in range(length):
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
            z[r, c] = 1
        d = (d + 1) % 4
    got = back(regions.connected(cells(spark, z), shape(z), "z"), "region", z.shape)
    assert set(got[z == 1]) == {0.0} and len(set(got[z == 0])) == 1
    none = regions.connected(cells(spark, np.full((2, 3), -9999.0), -9999), Shape(2, 3, 1.0), "z")
    assert none.count() == 6 and none.where("region is not null").count() == 0
    assert regions.connected(cells(spark, np.empty((0, 0))), Shape(0, 0, 1.0), "z").count() == 0


def test_superpixels_match_a_loop(spark):
    from shoalgrid.operators import tiles

    z = np.random.default_rng(2).normal(0, 1, (19, 23))
    z[4, 4] = -9999
    step, compactness, rounds = 5, 0.5, 3
    got = back(tiles.superpixels(cells(spark, z, -9999), shape(z), ["z"], step, compactness, rounds), "segment", z.shape)
    at = [(r, c) for r in range(19) for c in range(23) if z[r, c] != -9999]
    lo, hi = min(z[a] for a in at), max(z[a] for a in at)
    x = np.array([(r / step, c / step, (z[r, c] - lo) / (hi - lo) / compactness) for r, c in at])
    label = np.array([r // step * 5 + c // step for r, c in at])
    for _ in range(rounds):
        ids = np.unique(label)
        mid = np.array([x[label == k].mean(axis=0) for k in ids])
        d = ((x[:, None] - mid[None]) ** 2).sum(axis=2)
        d[(np.abs(x[:, None, :2] - mid[None, :, :2]) > 1).any(axis=2)] = np.inf
        label = np.where(np.isfinite(d.min(axis=1)), ids[d.argmin(axis=1)], label)
    assert [got[a] for a in at] == label.tolist() and np.isnan(got[4, 4])
