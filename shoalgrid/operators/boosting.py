"""Boosted trees for several classes at once: one softmax over all margins, one regression tree a class and round.

Rows are binned once. For each level of a round, tasks add up first and second derivatives of the weighted softmax loss by class,
node, feature and bin; Spark sums these tables and picks the splits, so the driver sees one row a node. Derivatives are rounded to
multiples of 2^-20, whose sums are exact up to 2^33 rows of weight 1, so the trees are the same however the rows are partitioned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import unwritten, written

GRAIN = 2.0**20
SUMS = "k int, node int, f int, bin int, g double, h double"


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Number of cuts below each value, by column; NaN is above all."""
    return np.column_stack([np.searchsorted(np.asarray(c, float), x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)


def descend(bins: np.ndarray, feature: list[int], bound: list[int], levels: int) -> np.ndarray:
    """Each row's node after ``levels`` splits of a tree in heap order; nodes without a split send all rows left."""
    f, b, at = np.asarray(feature), np.asarray(bound), np.zeros(len(bins), int)
    for level in range(levels):
        here = 2**level - 1 + at
        at = 2 * at + ((f[here] >= 0) & (bins[np.arange(len(bins)), np.maximum(f[here], 0)] > b[here]))
    return at


def margins(bins: np.ndarray, rounds: list[list[dict]], depth: int) -> np.ndarray:
    """What the rounds' trees add for each class."""
    return sum((np.column_stack([np.asarray(t["value"])[descend(bins, t["feature"], t["bound"], depth)] for t in trees]) for trees in rounds), np.zeros((len(bins), 1)))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class SoftmaxTrees:
    """A fitted model: cuts by column, first margins, and rounds of one tree a class; ``loss`` is the held-out loss before each round."""

    columns: list[str]
    cuts: list[list[float]]
    start: list[float]
    depth: int
    rounds: list[list[dict]]
    loss: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, an array by class that sums to 1."""
        cuts, start, depth, rounds = self.cuts, np.asarray(self.start), self.depth, self.rounds

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            bins = binned(np.array(x.tolist(), float).reshape(len(x), len(cuts)), cuts)
            return pd.Series(list(softmax(start + margins(bins, rounds, depth))))

        return df.withColumn("probability", told(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(asdict(self)),)], "told string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxTrees:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def _sums(rows: DataFrame, done: list[list[dict]], growing: list[dict], level: int, classes: int, features: int, bins: int, depth: int) -> DataFrame:
    """Sums of derivatives by class, node, feature and bin; at the first level also, as class -1, the held-out loss and its weight.

    A task sends each sum once, so there is nothing to combine before the shuffle, which serves the windows over bins too.
    """
    size = 2**level * bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss = np.zeros((2, classes, features, size)), np.zeros(2)
        for pdf in batches:
            if not len(pdf):
                continue
            b = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), features)
            y, w, held = pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["held"].to_numpy(bool)
            p = softmax(np.array(pdf["m"].tolist()) + margins(b, done, depth))
            if level == 0:
                loss += np.rint(GRAIN * np.array([-np.log(np.maximum(p[held, y[held]], 1e-15)) @ w[held], w[held].sum()]))
            b, y, w, p = b[~held], y[~held], w[~held, None], p[~held]
            one = np.zeros_like(p)
            one[np.arange(len(y)), y] = 1
            sums = np.rint(GRAIN * w * (p - one)), np.rint(GRAIN * w * p * (1 - p))
            for k, tree in enumerate(growing):
                node = descend(b, tree["feature"], tree["bound"], level) * bins
                for f in range(features):
                    for s in (0, 1):
                        total[s, k, f] += np.bincount(node + b[:, f], sums[s][:, k], size)
        k, f, at = np.nonzero((total != 0).any(axis=0))
        out = pd.DataFrame({"k": k, "node": at // bins, "f": f, "bin": at % bins, "g": total[0, k, f, at], "h": total[1, k, f, at]})
        if loss[1]:
            out.loc[len(out)] = [-1, 0, -1, 0, *loss]
        yield out.astype({c: "int32" for c in ("k", "node", "f", "bin")})

    return rows.mapInPandas(run, SUMS).repartition("k", "node", "f").groupBy("k", "node", "f", "bin").agg((F.sum("g") / GRAIN).alias("g"), (F.sum("h") / GRAIN).alias("h"))


def _splits(sums: DataFrame, ridge: float, least: float) -> DataFrame:
    """The best split of each node, one row: ``gain`` (not above 0: none), ``f``, ``bin`` and the sums on its left and in all."""
    own = Window.partitionBy("k", "node", "f")
    upto = own.orderBy("bin")
    each = sums.select("k", "node", "f", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "gh"], *[F.sum(c).over(own).alias(c) for c in "gh"])
    score = lambda g, h: g * g / (h + ridge)
    right = (F.col("g") - F.col("lg"), F.col("h") - F.col("lh"))
    gain = F.when((F.col("lh") >= least) & (right[1] >= least), score(F.col("lg"), F.col("lh")) + score(*right) - score(F.col("g"), F.col("h")))
    return each.withColumn("gain", F.coalesce(gain, F.lit(-1.0))).groupBy("k", "node").agg(F.max_by(F.struct("gain", "f", "bin", "lg", "lh", "g", "h"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("s")).select("k", "node", "s.*")


def fit(df: DataFrame, columns: list[str], label: str, weight: str, classes: int, rounds: int = 40, depth: int = 5, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 0.5, held: float = 0.1, patience: int = 10, seed: int = 42, keep: int = 8) -> SoftmaxTrees:
    """Fit on rows of features, a class number from 0 and a weight.

    A ``held`` share of the rows, dealt by a hash of their features and class (equal rows go together), is left out of the trees; when their
    loss has not fallen for ``patience`` rounds, training stops, and the rounds up to the least loss stay. Without held-out rows all
    rounds are made. Missing values and NaN count as largest. Margins are written every ``keep`` rounds; between these, tasks work them out from the latest trees.
    """
    if not 2 <= bins <= 256:
        raise ValueError(f"bins {bins} must be between 2 and 256, as a bin is one byte")
    x = F.array(*[F.col(c).cast("double") for c in columns])
    cuts = [sorted(set(c)) for c in df.approxQuantile(columns, [k / bins for k in range(1, bins)], 1e-3)]
    out = (F.pmod(F.xxhash64(x, label, F.lit(seed)), F.lit(1_000_000)) < int(held * 1_000_000)).alias("held")
    rows = df.select(x.alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), out)
    share = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    total = sum(share.values()) or 1.0
    start = [float(np.log(max(share.get(k, 0.0) / total, 1e-6))) for k in range(classes)]
    schema = "b binary, y int, w double, held boolean, m array<double>"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = binned(np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(cuts)), cuts)
            yield pd.DataFrame({"b": [r.tobytes() for r in b], "y": pdf["y"], "w": pdf["w"], "held": pdf["held"], "m": [start] * len(pdf)})

    def onward(trees: list[list[dict]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                b = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), len(cuts))
                yield pdf.assign(m=list(np.array(pdf["m"].tolist()).reshape(len(pdf), classes) + margins(b, trees, depth)))

        return run

    now, made, losses, since = written(rows.mapInPandas(begin, schema)), [], [], []
    finished = lambda: not share or len(made) >= rounds or (bool(losses) and len(losses) - 1 - int(np.argmin(losses)) >= patience)
    while True:
        growing = [{"feature": [-1] * (2**depth - 1), "bound": [0] * (2**depth - 1), "value": [0.0] * 2**depth} for _ in range(classes)]
        for level in range(depth):
            best = _splits(_sums(now, since, growing, level, classes, len(cuts), bins, depth), ridge, least).collect()  # a row a node
            if level == 0:
                losses += [s["g"] / s["h"] for s in best if s["k"] < 0]
                if finished():
                    break
            for s in (s for s in best if s["k"] >= 0):
                tree, node = growing[s["k"]], s["node"]
                left, right = (s["g"], s["h"]), (0.0, 0.0)
                if s["gain"] > 0:
                    tree["feature"][2**level - 1 + node], tree["bound"][2**level - 1 + node] = s["f"], s["bin"]
                    left, right = (s["lg"], s["lh"]), (s["g"] - s["lg"], s["h"] - s["lh"])
                if level == depth - 1:
                    tree["value"][2 * node : 2 * node + 2] = [-rate * g / (h + ridge) for g, h in (left, right)]
        if finished():
            break
        made, since = [*made, growing], [*since, growing]
        if len(since) == keep:
            after = written(now.mapInPandas(onward(since), schema))
            unwritten(now)
            now, since = after, []
    unwritten(now)
    return SoftmaxTrees(columns, cuts, start, depth, made[: int(np.argmin(losses))] if losses else made, losses)
