"""Outlines of regions and distances over a whole raster, against flood fill and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import distance, outlines, zonal
from shoalgrid.operators.grid import Shape


def cells(spark, z):
    return spark.createDataFrame([(r, c, None if z[r][c] is None else int(z[r][c])) for r in range(len(z)) for c in range(len(z[0]))], "r int, c int, z int")


def flood(z):
    rows, cols, out = len(z), len(z[0]), {}
    for r in range(rows):
        for c in range(cols):
            if z[r][c] is None or (r, c) in out:
                continue
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if (y, x) not in out:
                    out[y, x] = r * cols + c
                    todo += [(y + a, x + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + a < rows and 0 <= x + b < cols and z[y + a][x + b] == z[r][c]]
    return out


def picture(text):
    return [[None if ch == "." else ord(ch) for ch in line] for line in text.split()]


PICTURES = [
    "A",
    "AA AA",
    "AAAAA ABBBA ABABA ABBBA AAAAA",  # an island in a hole
    "AB BA",  # corners touch
    "AAAA AB.A A.BA AAAA",  # a hole of two missing cells and two single regions that meet in one corner
    "AAAAAAA BBBBBBA AAAAABA ABBBABA ABAAABA ABBBBBA AAAAAAA",  # a spiral
    "....",
]


@pytest.mark.parametrize("text", PICTURES)
def test_outlines_hold_their_cells_and_no_others(spark, text):
    z = picture(text)
    shape, region = Shape(len(z), len(z[0]), 2.0), flood(z)
    found = outlines.outlines(cells(spark, z), shape, "z")
    got = {r["fid"]: r for r in found.collect()}
    assert set(got) == set(region.values())
    for fid, poly in got.items():
        own = [k for k, v in region.items() if v == fid]
        edges = sum((y + a, x + b) not in own for y, x in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert poly["area"] == 4 * len(own) and poly["length"] == 2 * edges and poly["n_rings"] == len(poly["rings"])
        for ring in poly["rings"]:
            assert ring[0] == ring[-1] and all((a["x"] == b["x"]) != (a["y"] == b["y"]) for a, b in zip(ring, ring[1:]))
            assert all((a["x"] == b["x"]) != (b["x"] == c["x"]) for a, b, c in zip(ring, ring[1:], ring[2:]))  # corners only
    if region:
        points = spark.createDataFrame([(int(r * len(z[0]) + c), 2 * c + 1.0, -2 * r - 1.0) for r in range(len(z)) for c in range(len(z[0]))], "id long, x double, y double")
        held = {r["id"]: r["fid"] for r in zonal.within(points, found.select("fid", "rings"), 3.0).collect()}
        assert held == {r * len(z[0]) + c: region.get((r, c)) for r in range(len(z)) for c in range(len(z[0]))}


def test_rings_of_a_random_raster(spark):
    z = np.random.default_rng(2).integers(0, 2, (17, 23)).tolist()
    region = flood(z)
    rings = outlines.rings(cells(spark, z), Shape(17, 23, 1.0), "z").collect()
    by = {}
    for r in rings:
        by.setdefault(r["region"], []).append(r)
        v = r["vertices"]
        shoelace = sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(v, v[1:])) / 2
        assert len(v) == r["n_vertices"] + 1 and -shoelace == r["area"]  # clockwise as y goes up: outer rings count negative there
    assert set(by) == set(region.values())
    for fid, own in by.items():
        assert sum(r["area"] > 0 for r in own) == 1 and sum(r["area"] for r in own) == sum(v == fid for v in region.values())


@pytest.mark.parametrize("share", [0.0, 0.004, 0.3, 1.0])
def test_distance_transform(spark, share):
    g = np.random.default_rng(5)
    marked = g.random((31, 19)) < share
    if share == 0.004:
        marked[30, 0] = True
    z = [[None if g.random() < 0.1 and not m else int(m) for m in row] for row in marked]
    got = {(r["r"], r["c"]): r["distance"] for r in distance.distance_transform(cells(spark, z), Shape(31, 19, 0.5), F.col("z") == 1).collect()}
    at = np.argwhere(marked)
    assert len(got) == 31 * 19
    for (r, c), d in got.items():
        assert d == (None if not len(at) else pytest.approx(0.5 * np.sqrt(((at - (r, c)) ** 2).sum(1).min()), abs=1e-12))


def test_best_rows_against_all_rows():
    g = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 777):
        rows = np.sort(g.choice(4 * n, n, replace=False))
        at = np.sort(g.choice(rows, max(1, n // 5), replace=False))
        gaps = g.integers(0, 60, len(at))
        assert (distance.least_squares_away(rows, at, gaps) == ((rows[:, None] - at) ** 2 + gaps**2).min(1)).all()
