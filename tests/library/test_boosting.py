"""Softmax boosting against a plain loop over all rows, in any partitioning; early stopping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import boosting, learning, metrics

GRAIN = 2.0**20


def table(spark, n=500, classes=3, seed=1, noise=0.0):
    g = np.random.default_rng(seed)
    x = g.normal(0, 1, (n, 3)).round(2)
    y = np.where(g.random(n) < noise, g.integers(0, classes, n), (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 0] > 0.5)) % classes
    w = 1 + (y == 0) * 0.5
    return x, y, w, spark.createDataFrame([(*map(float, a), int(b), float(c)) for a, b, c in zip(x, y, w)], "a double, b double, c double, y int, w double")


def best_split(x, g, h, cuts):
    """(gain, feature, bin) of the best of all splits of some rows, the first among equals."""
    found = (0.0, -1, 0)
    for f, own in enumerate(cuts):
        for k, c in enumerate(own):
            left = x[:, f] <= c
            a, b, p, q = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
            if min(b, q) >= 0.5:
                gain = a * a / (b + 1) + p * p / (q + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > found[0] + 1e-12:
                    found = (gain, f, k)
    return found


def grow(x, g, h, cuts, depth, add, rows):
    gain, f, k = best_split(x[rows], g[rows], h[rows], cuts) if depth else (0.0, -1, 0)
    if not gain:
        add[rows] = -0.3 * g[rows].sum() / (h[rows].sum() + 1)
        return
    left = x[rows, f] <= cuts[f][k]
    grow(x, g, h, cuts, depth - 1, add, rows[left])
    grow(x, g, h, cuts, depth - 1, add, rows[~left])


def test_trees_match_a_loop(spark):
    x, y, w, df = table(spark)
    model = boosting.fit(df.repartition(3), ["a", "b", "c"], "y", "w", 3, rounds=4, depth=3, rate=0.3, bins=16, held=0.0, keep=3)
    m = np.tile(model.start, (len(x), 1))
    assert model.start == pytest.approx([np.log(w[y == k].sum() / w.sum()) for k in range(3)])
    for _ in range(4):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        step = np.zeros_like(m)
        for k in range(3):
            grow(x, np.rint(GRAIN * w * (p[:, k] - (y == k))) / GRAIN, np.rint(GRAIN * w * p[:, k] * (1 - p[:, k])) / GRAIN, model.cuts, 3, step[:, k], np.arange(len(x)))
        m = m + step
    want = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
    by = {tuple(v): p for v, p in zip(x, want)}
    told = model.transform(df).collect()
    assert len(told) == 500 and all(r["probability"] == pytest.approx(by[r["a"], r["b"], r["c"]], abs=1e-9) for r in told)


def test_partitioning_and_a_written_model_change_nothing(spark, tmp_path):
    _, _, _, df = table(spark, 300)
    models = [boosting.fit(df.repartition(n, "a").cache(), ["a", "b", "c"], "y", "w", 3, rounds=3, depth=2, keep=k) for n, k in ((1, 1), (5, 8))]
    assert models[0].rounds == models[1].rounds and models[0].loss == pytest.approx(models[1].loss)
    models[0].save(str(tmp_path / "m"))
    assert boosting.SoftmaxTrees.load(spark, str(tmp_path / "m")) == models[0]


def test_training_stops_where_the_held_out_loss_is_least(spark):
    _, _, _, df = table(spark, 400, noise=0.6, seed=5)
    model = boosting.fit(df, ["a", "b", "c"], "y", "w", 3, rounds=60, depth=4, rate=0.8, bins=32, held=0.3, patience=2)
    best = int(np.argmin(model.loss))
    assert len(model.loss) == best + 3 < 60 and len(model.rounds) == best
    out = F.pmod(F.xxhash64(F.array("a", "b", "c"), "y", F.lit(42)), F.lit(1_000_000)) < 300_000
    told = model.transform(df.where(out)).collect()
    loss = sum(-r["w"] * np.log(r["probability"][r["y"]]) for r in told) / sum(r["w"] for r in told)
    assert loss == pytest.approx(model.loss[best], abs=1e-5)


def test_missing_values_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 0), (float("nan"), 2.0, 0), (3.0, 3.0, 1), (4.0, None, 1)] * 20, "a double, b double, y int").withColumn("w", F.lit(1.0))
    told = boosting.fit(df, ["a", "b"], "y", "w", 2, rounds=10, depth=2, held=0.0).transform(df)
    assert told.where((F.element_at("probability", F.col("y") + 1) > 0.5) & (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9)).count() == 80
    one = boosting.fit(df.where("y = 0"), ["a", "b"], "y", "w", 1, rounds=2, depth=1).transform(df)
    assert {tuple(r["probability"]) for r in one.collect()} == {(1.0,)}
    assert boosting.fit(df.limit(0), ["a", "b"], "y", "w", 2).rounds == []
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], "y", "w", 2, bins=300)


def test_four_classes_through_the_factory(spark, tmp_path):
    g = np.random.default_rng(3)
    rows = [(k, float(x), float(y), "NESW"[int(2 * (x > 0) + (y > 0.3 * np.sin(3 * x)))]) for k, (x, y) in enumerate(g.uniform(-1, 1, (800, 2)))]
    df = spark.createDataFrame(rows, "ID long, x double, y double, class string")
    known, new = df.where("ID % 4 > 0"), df.where("ID % 4 = 0")
    model = learning.train(known, "class", ["x", "y"], learning.Spec("boosted", {"rounds": 15, "depth": 4, "rate": 0.3}))
    model.save(str(tmp_path / "f"))
    for m in (model, learning.Fitted.load(spark, str(tmp_path / "f"))):
        told = m.predict(new)
        assert metrics.summary(told, "class", "predicted_class").first()["weighted_f1"] > 0.93
        assert told.where("abs(prob_N + prob_E + prob_S + prob_W - 1) > 1e-9").count() == 0
