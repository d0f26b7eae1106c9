"""As-of joins, and filters of any size, against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import asof, records, terrain, tiles
from shoalgrid.operators.grid import Shape


@pytest.mark.parametrize("by", [[], ["k"], ["k", "m"]])
@pytest.mark.parametrize("allow_equal", [False, True])
def test_asof_join(spark, by, allow_equal):
    rng = random.Random(4)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(i, key(), rng.randint(0, 1), rng.choice([None, *range(40)])) for i in range(120)]
    right = [(i, key(), rng.randint(0, 1), rng.choice([None, *range(0, 40, 3)])) for i in range(60)]
    schema = "id long, k string, m int, t int"
    got = asof.asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), by, "t", "id", "hit", allow_equal).select("id", F.col("hit.id").alias("h")).collect()
    at = [("k", "m").index(b) + 1 for b in by]
    want = {}
    for row in left:
        fit = [r for r in right if row[3] is not None and r[3] is not None and all(r[i] == row[i] for i in at) and (r[3] <= row[3] if allow_equal else r[3] < row[3])]
        want[row[0]] = max(fit, key=lambda r: (r[3], r[0]))[0] if fit else None
    assert {r["id"]: r["h"] for r in got} == want and len(got) == len(left)
    empty = spark.createDataFrame([], schema)
    assert asof.asof_join(empty, empty, by, "t", "id").count() == 0
    assert {r["earlier"] for r in asof.asof_join(spark.createDataFrame(left, schema), empty, by, "t", "id").collect()} == {None}


def test_earlier_baselines_of_one_key(spark):
    rows = [(i, f"r{i}", "c", "baseline" if i % 50 == 0 else "try", i / 1000) for i in range(1, 400)]
    runs = spark.createDataFrame(rows, "ord long, run_id string, config_ref string, run_type string, metric_weighted_f1 double")
    got = {r["ord"]: r["baseline_ord"] for r in records.earlier_baselines(runs, []).collect()}
    assert got == {i: (i // 50 * 50 or None) for i in range(1, 400) if i % 50}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 10, 25, 60])
def test_extremes(spark, size):
    g = np.random.default_rng(size)
    z = g.normal(0, 5, (21, 13)).round(2)
    z[g.random(z.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(21) for c in range(13)], "r int, c int, z double")
    got = {(x["r"], x["c"]): (x["lo"], x["hi"]) for x in terrain.extremes(df, size, {"lo": ("minimum", "z"), "hi": ("maximum", "z")}).collect()}
    a, b = -(size // 2), size - 1 - size // 2
    padded = np.pad(z, ((size, size), (size, size)), mode="symmetric")
    for (r, c), pair in got.items():
        w = padded[r + size + a : r + size + b + 1, c + size + a : c + size + b + 1]
        w = w[~np.isnan(w)]
        assert pair == ((w.min(), w.max()) if len(w) else (None, None))
    assert len(got) == z.size


def test_gaussian_among_the_named_filters(spark):
    z = np.random.default_rng(2).normal(0, 1, (9, 8))
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(9) for c in range(8)], "r int, c int, z double")
    shape = Shape(9, 8, 1.0)
    key = lambda d, k: {(x["r"], x["c"]): x[k] for x in d.collect()}
    assert key(terrain.scale_filter(df, shape, "gaussian", 2), "filtered") == key(tiles.gaussian(df, shape, 2.0), "smooth")
    with pytest.raises(ValueError):
        terrain.scale_filter(df, shape, "nothing", 3)
