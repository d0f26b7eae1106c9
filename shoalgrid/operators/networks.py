"""Feed-forward networks: class weights inside the loss, full passes over all rows, early stopping on held-out rows.

A pass is one job: tasks run the network over their rows and add up the gradient, at most ``VECTORS`` sums of the model's
size reach the driver, and the weights go out again with the next pass. Step sizes are resilient: each
weight's grows while its gradient keeps its sign and is halved when that changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.functions.staging import unwritten, written
from shoalgrid.operators.boosting import softmax

VECTORS = 32
GROW, SHRINK, FIRST, LEAST, MOST = 1.2, 0.5, 0.01, 1e-8, 0.5  # of the step sizes


def layers(weights: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The flat weights as one matrix a layer, whose last row is the bias; views, not copies."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(weights[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def forward(x: np.ndarray, weights: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """What each layer puts out: rectified inside, a softmax at the end; ``x`` first."""
    seen, told = layers(weights, sizes), [x]
    for k, m in enumerate(seen):
        z = told[-1] @ m[:-1] + m[-1]
        told.append(softmax(z) if k == len(seen) - 1 else np.maximum(z, 0))
    return told


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The gradient of the weighted log loss, summed over rows."""
    told, out = forward(x, weights, sizes), np.zeros_like(weights)
    back = told[-1].copy()
    back[np.arange(len(y)), y] -= 1
    back *= w[:, None]
    for m, g, given in reversed(list(zip(layers(weights, sizes), layers(out, sizes), told))):
        g[:-1], g[-1] = given.T @ back, back.sum(axis=0)
        back = (back @ m[:-1].T) * (given > 0)
    return out


def log_loss(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)) @ w)


@dataclass
class Network:
    """A fitted network: means and deviations by column, layer sizes, flat weights; ``loss`` is the held-out loss before each pass."""

    columns: list[str]
    mean: list[float]
    deviation: list[float]
    sizes: list[int]
    weights: list[float]
    loss: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, an array by class that sums to 1."""
        weights, sizes = np.array(self.weights), self.sizes

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            return pd.Series(list(forward(np.array(x.tolist(), float).reshape(len(x), sizes[0]), weights, sizes)[-1]))

        return df.withColumn("probability", told(_standard(self.columns, self.mean, self.deviation)))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(asdict(self)),)], "told string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def _standard(columns: list[str], mean: list[float], deviation: list[float]):
    """Standardised columns as an array; missing values and NaN lie at the mean."""
    return F.array(*[F.coalesce(F.nanvl((F.col(c).cast("double") - m) / s, F.lit(0.0)), F.lit(0.0)) for c, m, s in zip(columns, mean, deviation)])


def _pass(rows: DataFrame, weights: np.ndarray, sizes: list[int], partitions: int) -> np.ndarray:
    """Gradient, rows' weight, held-out loss and held-out weight, summed over all rows, as one vector."""
    long = len(weights) + 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(long)
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, w, held = np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["held"].to_numpy(bool)
            total[:-3] += gradient(x[~held], y[~held], w[~held], weights, sizes)
            total[-3:] += w[~held].sum(), log_loss(forward(x[held], weights, sizes)[-1], y[held], w[held]), w[held].sum()
        yield pd.DataFrame({"v": [total]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"v": [sum((v for pdf in batches for v in pdf["v"]), np.zeros(long))]})

    sums = rows.mapInPandas(run, "v array<double>")
    if partitions > VECTORS:
        sums = sums.repartition(VECTORS).mapInPandas(add, "v array<double>")
    return sum((np.array(r["v"]) for r in sums.collect()), np.zeros(long))


def fit(df: DataFrame, columns: list[str], label: str, weight: str, classes: int, hidden: tuple[int, ...] = (128, 64, 32), passes: int = 200, ridge: float = 1e-4, held: float = 0.1, patience: int = 15, seed: int = 42) -> Network:
    """Fit on rows of features, a class number from 0 and a weight, which the loss takes as it is.

    A ``held`` share of the rows, dealt by a hash of their features and class (equal rows go together), is left out of the gradient; when
    their loss has not fallen for ``patience`` passes, training stops, and the weights of the least loss are kept. Without
    held-out rows all passes are made and the last weights kept. Missing values and NaN count as the column's mean.
    """
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    told = df.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(known) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = [told[f"m{k}"] or 0.0 for k in range(len(columns))]
    deviation = [told[f"s{k}"] or 1.0 for k in range(len(columns))]
    x = _standard(columns, mean, deviation)
    out = (F.pmod(F.xxhash64(x, label, F.lit(seed)), F.lit(1_000_000)) < int(held * 1_000_000)).alias("held")
    rows = written(df.select(x.alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), out))
    partitions, sizes = rows.rdd.getNumPartitions(), [len(columns), *hidden, classes]
    g = np.random.default_rng(seed)
    now = np.concatenate([np.vstack([g.normal(0, np.sqrt(2 / max(a, 1)), (a, b)), np.zeros((1, b))]).ravel() for a, b in zip(sizes, sizes[1:])])
    step, before, best, losses = np.full(len(now), FIRST), np.zeros(len(now)), now, []
    for k in range(passes + 1):
        total = _pass(rows, now, sizes, partitions)
        if total[-1] > 0:
            losses.append(float(total[-2] / total[-1]))
            best = now if losses[-1] == min(losses) else best
        else:
            best = now
        if k == passes or total[-3] <= 0 or (losses and k - int(np.argmin(losses)) >= patience):
            break
        slope = total[:-3] / total[-3] + ridge * now
        turned = np.sign(slope * before)
        step = np.clip(np.where(turned > 0, step * GROW, np.where(turned < 0, step * SHRINK, step)), LEAST, MOST)
        before = np.where(turned < 0, 0.0, slope)
        now = now - np.sign(before) * step
    unwritten(rows)
    return Network(columns, mean, deviation, sizes, best.tolist(), losses)
