"""Neighbours in dense and far places, ranks and quantiles over all tasks: against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import neighbours, selection, zonal


def brute(points, others, k, with_self=True):
    out = []
    for i, x, y in points:
        d = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in others if with_self or j != i)[:k]
        out += [(i, j, s, n + 1) for n, (s, j) in enumerate(d)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in rows], "id long, x double, y double")


@pytest.mark.parametrize(("k", "with_self", "leaf"), [(1, True, 64), (4, True, 3), (5, False, 8)])
def test_clusters_copies_and_outliers(spark, k, with_self, leaf):
    g = np.random.default_rng(7)
    xy = np.concatenate([g.normal(0, 1, (150, 2)), g.normal(50, 1e-7, (120, 2)), np.repeat([[3.0, 3.0]], 40, 0), [[1e9, -1e9], [-1e5, 4.0]], np.round(g.uniform(-5, 5, (90, 2)))])
    rows = [(i, *p) for i, p in enumerate(xy)]
    got = sorted(map(tuple, neighbours.nearest(frame(spark, rows), frame(spark, rows), k, with_self=with_self, leaf=leaf).collect()))
    assert got == brute(rows, rows, k, with_self)


def test_a_dense_place_forms_few_pairs(spark):
    g = np.random.default_rng(3)
    xy = np.concatenate([g.uniform(0, 1, (40_000, 2)), [[1e6, 1e6], [-4e8, 2.0], [0.5, 9e7]]])
    rows = [(i, *p) for i, p in enumerate(xy)]
    points = [rows[i] for i in (0, 17, 3999, 40_000, 40_001, 40_002)]
    found = neighbours.nearest(frame(spark, points), frame(spark, rows), 6)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    for i, x, y in points:
        d = np.sqrt((x - xy[:, 0]) ** 2 + (y - xy[:, 1]) ** 2)
        assert [j for _, j in sorted(got[i])] == list(np.lexsort((np.arange(len(d)), d))[:6])
    nodes, _ = neighbours.tree(frame(spark, rows).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), 64)
    assert nodes.where("leaf").agg(F.max("n")).first()[0] <= 64 and nodes.where("leaf").agg(F.sum("n")).first()[0] == len(rows)


def test_coordinates_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, nan, 0.0), (4, 0.0, inf), (5, -inf, nan)]
    df = frame(spark, rows).unionByName(spark.createDataFrame([(6, None, 1.0)], "id long, x double, y double"))
    got = sorted((r["id"], r["other"]) for r in zonal.nearest(df, df, 3, 1.0).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert zonal.nearest(df, df.limit(0), 3, 1.0).count() == 0 and zonal.nearest(df.limit(0), df, 3, 1.0).count() == 0
    assert neighbours.nearest(df, df.where("id > 2"), 1).count() == 0
    for k, bucket in ((0, 1.0), (1, 0.0), (1, -2.0), (1, nan)):
        with pytest.raises(ValueError):
            zonal.nearest(df, df, k, bucket)


COLUMNS = {
    "a": np.random.default_rng(1).lognormal(0, 6, 3000),
    "b": np.where(np.random.default_rng(2).random(3000) < 0.9, 5.0, np.random.default_rng(3).normal(5, 1e-6, 3000)),
    "c": np.random.default_rng(4).integers(0, 4, 3000).astype(float),
    "d": np.where(np.random.default_rng(5).random(3000) < 0.3, np.nan, np.random.default_rng(6).normal(0, 1, 3000)),
    "e": np.where(np.random.default_rng(5).random(3000) < 0.3, np.inf, -np.inf),
}


@pytest.mark.parametrize("wide", [10**6, 40])
def test_exact_quantiles(spark, wide):
    rows = [tuple(float(COLUMNS[c][i]) for c in COLUMNS) + (None if i % 3 else float(i), None) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*COLUMNS, "f", "g"])).repartition(7)
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = selection.exact_quantiles(df, {c: probs for c in df.columns}, wide)
    for c in df.columns:
        want = df.agg(F.percentile(c, F.array(*map(F.lit, probs)))).first()[0] or [None] * len(probs)
        for a, b in zip(got[c], want):
            assert a == b or (a is not None and math.isnan(a) and math.isnan(b)), (c, a, b)
    assert selection.exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}
    with pytest.raises(ValueError):
        selection.exact_quantiles(df, {"a": [1.5]})


def test_average_ranks(spark):
    g = np.random.default_rng(9)
    v = np.concatenate([g.normal(0, 1, 400).round(1), [7.0] * 300, [np.nan] * 3])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = {r["v"]: r["rank"] for r in selection.average_ranks(df, "v", "rank").collect()}
    order = np.where(np.isnan(v), np.inf, v)
    want = {float(x): (order < x).sum() + ((order == x).sum() + 1) / 2 for x in set(order)}
    assert {math.inf if math.isnan(x) else x: r for x, r in got.items()} == want
    assert selection.average_ranks(df.limit(0), "v", "rank").count() == 0


def test_running_counts_use_every_partition(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 5).alias("n"))
    got = [r["before"] for r in selection.running_counts(df, ["v"]).orderBy("v").collect()]
    assert got == [sum(i % 5 for i in range(v)) for v in range(1000)]
