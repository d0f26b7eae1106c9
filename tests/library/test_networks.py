"""Networks: gradients against differences, weights against repeated rows, early stopping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.operators import learning, metrics, networks


def test_gradient_matches_differences():
    g = np.random.default_rng(1)
    sizes = [3, 5, 4, 2]
    weights = g.normal(0, 0.7, sum((a + 1) * b for a, b in zip(sizes, sizes[1:])))
    x, y, w = g.normal(0, 1, (11, 3)), g.integers(0, 2, 11), g.uniform(0.2, 3, 11)
    loss = lambda v: networks.log_loss(networks.forward(x, v, sizes)[-1], y, w)
    e = 1e-6 * np.eye(len(weights))
    assert networks.gradient(x, y, w, weights, sizes) == pytest.approx([(loss(weights + d) - loss(weights - d)) / 2e-6 for d in e], abs=1e-5)


def frame(spark, n=300, noise=0.0):
    g = np.random.default_rng(6)
    x = g.normal(0, 1, (n, 2))
    y = np.where(g.random(n) < noise, g.integers(0, 3, n), (np.hypot(*x.T) > 1).astype(int) + (x[:, 0] > 1))
    return spark.createDataFrame([(float(a), float(b), int(c), float(1 + (c == 2) * 2)) for (a, b), c in zip(x, y)], "a double, b double, y int, w double")


def test_weights_are_worth_repeated_rows_in_any_partitioning(spark, monkeypatch):
    df = frame(spark, 120)
    base = df.agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    scaled = df.select(((F.col("a") - base[0]) / base[1]).alias("a"), ((F.col("b") - base[2]) / base[3]).alias("b"), "y", "w")
    monkeypatch.setattr(networks, "_standard", lambda columns, *_: F.array(*columns))  # repeated rows would move the means
    args = (["a", "b"], "y", "w", 3, (6,), 6)
    heavy = networks.fit(scaled.repartition(3), *args, held=0.0)
    monkeypatch.setattr(networks, "VECTORS", 1)
    many = networks.fit(scaled.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int")))).withColumn("w", F.lit(1.0)), *args, held=0.0)
    assert heavy.weights == pytest.approx(many.weights, abs=1e-9) and heavy.loss == many.loss == []


def test_the_best_pass_is_kept(spark):
    df = frame(spark, 400, noise=0.5)
    model = networks.fit(df, ["a", "b"], "y", "w", 3, (40, 20), passes=60, held=0.3, patience=4)
    best = int(np.argmin(model.loss))
    assert len(model.loss) == best + 5 < 61
    x = networks._standard(["a", "b"], model.mean, model.deviation)
    told = model.transform(df.where(F.pmod(F.xxhash64(x, "y", F.lit(42)), F.lit(1_000_000)) < 300_000)).collect()
    assert sum(-r["w"] * np.log(r["probability"][r["y"]]) for r in told) / sum(r["w"] for r in told) == pytest.approx(model.loss[best], abs=1e-9)


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 0), (float("nan"), 2.0, 0), (3.0, 3.0, 1), (4.0, None, 1)] * 20, "a double, b double, y int").withColumn("w", F.lit(1.0))
    told = networks.fit(df, ["a", "b"], "y", "w", 2, (16,), 100, held=0.0).transform(df)
    assert told.where((F.element_at("probability", F.col("y") + 1) > 0.5) & (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9)).count() == 80
    assert networks.fit(df.limit(0), ["a", "b"], "y", "w", 2, (4,)).loss == []


def test_network_through_the_factory(spark, tmp_path):
    df = frame(spark, 600).select(F.monotonically_increasing_id().alias("ID"), "a", "b", F.element_at(F.array(F.lit("NVB"), F.lit("ALG"), F.lit("SED")), F.col("y") + 1).alias("class"))
    model = learning.train(df, "class", ["a", "b"], learning.Spec("mlp", {"hidden": (24,), "rounds": 60}))
    model.save(str(tmp_path / "n"))
    for m in (model, learning.Fitted.load(spark, str(tmp_path / "n"))):
        assert metrics.summary(m.predict(df), "class", "predicted_class").first()["weighted_f1"] > 0.9
