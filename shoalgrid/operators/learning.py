"""Models over feature frames: a factory of estimators, blocked cross-validation, votes, selection, stacking.

Forests and logistic models are ``pyspark.ml``, boosted trees and networks our own; class weights are columns, folds are columns, and predictions come
back as DataFrames that the metrics module scores.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.operators import boosting as bo
from shoalgrid.operators import features as ft
from shoalgrid.operators import metrics as mt
from shoalgrid.operators import networks as nw

MODELS = ("random_forest", "boosted", "deep_boosted", "logistic", "mlp", "forest_boosted", "forest_mlp")

#: Models that are not of pyspark.ml, by the name under which a written model tells its kind.
OWN = {"SoftmaxTrees": bo.SoftmaxTrees, "Network": nw.Network}


@dataclass(frozen=True)
class Spec:
    """A kind of model, its parameters, and for mixtures the weight of the forest."""

    kind: str = "random_forest"
    params: dict = field(default_factory=dict)
    forest_weight: float = 0.5


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``_w``: rows over classes times the class's rows."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    t = n.agg(F.sum("_n").alias("t"), F.count("*").alias("k")).first()
    return df.join(F.broadcast(n.select(label, (F.lit(t["t"]) / (F.lit(t["k"]) * F.col("_n"))).alias("_w"))), label)  # one row per class


def weighted(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """``_w`` from ``weights(label, weight)``, one row per class."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias("_w"))), label)


def _estimator(kind: str, params: dict):
    p = dict(params)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=p.get("trees", 300), maxDepth=p.get("depth", 15), minInstancesPerNode=p.get("leaf", 2), seed=p.get("seed", 42), featuresCol="_x", labelCol="_y", weightCol="_w")
    if kind == "logistic":
        return LogisticRegression(maxIter=p.get("rounds", 600), regParam=p.get("ridge", 1e-3), featuresCol="_x", labelCol="_y", weightCol="_w")
    raise ValueError(f"model {kind!r}; known: {', '.join(MODELS)}")


@dataclass
class Fitted:
    """Fitted parts with their weights, the features' order and medians, and the classes by index."""

    parts: list[tuple[PipelineModel | bo.SoftmaxTrees | nw.Network, float]]
    columns: list[str]
    stats: ft.Statistics
    classes: list[str]

    def save(self, path: str) -> None:
        """Write the parts, and beside them what prediction needs to know."""
        spark = SparkSession.getActiveSession()
        for k, (model, _) in enumerate(self.parts):
            (model if type(model) in OWN.values() else model.write().overwrite()).save(f"{path}/part{k}")
        told = {"kinds": [type(m).__name__ for m, _ in self.parts], "weights": [w for _, w in self.parts], "columns": self.columns, "statistics": asdict(self.stats), "classes": self.classes}
        spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").text(f"{path}/told")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fitted:
        told = json.loads(spark.read.text(f"{path}/told").first()["value"])
        parts = [(OWN[kind].load(spark, f"{path}/part{k}") if kind in OWN else PipelineModel.load(f"{path}/part{k}"), w) for k, (w, kind) in enumerate(zip(told["weights"], told["kinds"]))]
        return cls(parts, told["columns"], ft.Statistics(**told["statistics"]), told["classes"])

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prob_{class}``, ``predicted_class`` and ``confidence``; absent feature columns are 0."""
        ready = ft.impute(df.withColumns({c: F.lit(0.0) for c in self.columns if c not in df.columns}), self.stats)
        out = ready
        for k, (model, _) in enumerate(self.parts):
            told = model.transform(out)
            p = F.col("probability") if type(model) in OWN.values() else vector_to_array("probability")
            out = told.withColumn(f"_p{k}", p).select(*out.columns, f"_p{k}")
        total = sum(w for _, w in self.parts)
        prob = {c: sum((F.coalesce(F.try_element_at(f"_p{k}", F.lit(i + 1)), F.lit(0.0)) * (w / total) for k, (_, w) in enumerate(self.parts)), F.lit(0.0)) for i, c in enumerate(self.classes)}
        scored = out.select(*[c for c in df.columns], *[p.alias(f"prob_{c}") for c, p in prob.items()])
        return mt.argmax(scored, {c: f"prob_{c}" for c in self.classes})


def train(df: DataFrame, label: str, columns: list[str] | None = None, spec: Spec = Spec(), weights: DataFrame | None = None) -> Fitted:  # noqa: B008
    """Fit with balanced class weights, or those of ``weights(label, weight)``; statistics for imputation are those of the training frame.

    All kinds take the weights inside their loss. Boosted trees and networks keep rows out to tell when to stop.
    """
    if spec.kind not in MODELS:
        raise ValueError(f"model {spec.kind!r}; known: {', '.join(MODELS)}")
    columns = columns or [c for c in ft.model_columns(df) if c != label]
    labelled = df.where(F.col(label).isNotNull())
    stats = ft.fit_statistics(labelled, columns)
    filled = ft.impute(labelled, stats)
    ready = balanced(filled, label) if weights is None else weighted(filled, label, weights)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(ready)
    ready = index.transform(ready)
    kinds = {"forest_boosted": [("random_forest", 0.5), ("boosted", 0.5)], "forest_mlp": [("random_forest", spec.forest_weight), ("mlp", 1 - spec.forest_weight)]}.get(spec.kind, [(spec.kind, 1.0)])
    parts = []
    for kind, w in kinds:
        if kind in ("boosted", "deep_boosted"):
            p, deep = spec.params, kind == "deep_boosted"
            parts.append((bo.fit(ready, columns, "_y", "_w", len(index.labels), p.get("rounds", 60 if deep else 40), p.get("depth", 7 if deep else 5), p.get("rate", 0.1), held=p.get("held", 0.1), patience=p.get("patience", 10), seed=p.get("seed", 42)), w))
            continue
        if kind == "mlp":
            p = spec.params
            parts.append((nw.fit(ready, columns, "_y", "_w", len(index.labels), tuple(p.get("hidden", (128, 64, 32))), p.get("rounds", 200), held=p.get("held", 0.1), patience=p.get("patience", 15), seed=p.get("seed", 42)), w))
            continue
        raw = VectorAssembler(inputCols=columns, outputCol="_raw")
        scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
        parts.append((Pipeline(stages=[raw, scaled, _estimator(kind, spec.params)]).fit(ready), w))
    return Fitted(parts, columns, stats, list(index.labels))


def cross_validate(df: DataFrame, label: str, fold: str = "fold", columns: list[str] | None = None, spec: Spec = Spec(), id_: str = "ID") -> DataFrame:  # noqa: B008
    """``(ID, fold, class, predicted_class, confidence)`` out of fold, one model for each fold."""
    out = None
    for k in sorted(r[fold] for r in df.select(fold).distinct().collect()):
        rest, held = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        told = train(rest, label, columns, spec).predict(held).select(id_, fold, F.col(label).alias("class"), "predicted_class", "confidence")
        out = told if out is None else out.unionByName(told)
    return out


def shuffled(df: DataFrame, column: str, seed: int, id_: str = "ID", block: int = 100_000) -> DataFrame:
    """``df`` with one column dealt anew among its rows, every value once.

    Rows are dealt into blocks by a hash, and within a block values go on by one place in a second hash's
    order, so no task sorts more than a block, and values come from all over the frame.
    """
    n = df.count()
    blocks = max(1, -(-n // block))
    b = F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(blocks))
    order = Window.partitionBy("_b").orderBy(F.xxhash64(id_, F.lit(seed + 1_000_003)), id_)
    last = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = df.withColumn("_b", b)
    return dealt.withColumn(column, F.coalesce(F.lag(F.struct(column)).over(order), F.last(F.struct(column)).over(last))[column]).select(*df.columns)


def permutation_importance(model: Fitted, df: DataFrame, label: str, repeats: int = 3, seed: int = 42, id_: str = "ID") -> DataFrame:
    """``(feature_name, importance_mean, importance_std, selected, rank)``: the loss of accuracy when a column is shuffled.

    See ``shuffled`` for how.
    """
    base = mt.summary(model.predict(df), label, "predicted_class").first()["accuracy"]
    rows = []
    for c in model.columns:
        lost = []
        for k in range(repeats):
            mixed = shuffled(df, c, seed + k, id_)
            lost.append(base - mt.summary(model.predict(mixed), label, "predicted_class").first()["accuracy"])
        m = sum(lost) / repeats
        rows.append((c, float(m), float((sum((x - m) ** 2 for x in lost) / repeats) ** 0.5), m > 0))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], "feature_name string, importance_mean double, importance_std double, selected boolean, rank int")


def kmeans_zones(df: DataFrame, columns: list[str], k: int, out: str = "zone", seeds: int = 5) -> DataFrame:
    """Zones by k-means on standardised columns, the best of several starts, fitted on all rows."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    there = df.dropna(subset=columns)
    prepared = Pipeline(stages=stages).fit(there)
    ready = prepared.transform(there)
    best = min((KMeans(k=k, seed=s, featuresCol="_x", predictionCol=out).fit(ready) for s in range(1, seeds + 1)), key=lambda m: m.summary.trainingCost)
    return best.transform(ready).drop("_raw", "_x")


def spatial_groups(df: DataFrame, groups: int = 10, n_splits: int = 5, x: str = "x", y: str = "y") -> DataFrame:
    """``fold`` by k-means groups of the coordinates, groups given greedily to the smallest fold."""
    z = kmeans_zones(df, [x, y], groups, "group", seeds=1)
    sizes = sorted(((r["n"], r["group"]) for r in z.groupBy("group").agg(F.count("*").alias("n")).collect()), reverse=True)
    load, fold = [0] * n_splits, {}
    for n, g in sizes:
        fold[g] = min(range(n_splits), key=lambda k: (load[k], k))
        load[fold[g]] += n
    return z.withColumn("fold", F.element_at(F.create_map(*[F.lit(int(v)) for kv in fold.items() for v in kv]), F.col("group")))


def stack(base: DataFrame, parts: list[DataFrame], label: str, held: DataFrame, id_: str = "ID") -> Fitted:
    """A logistic model over the parts' probabilities, joined on the id; ``held`` holds the ids that are left out of the fit."""
    wide = base
    for k, p in enumerate(parts):
        probs = [c for c in p.columns if c.startswith("prob_")]
        wide = wide.join(p.select(id_, *[F.col(c).alias(f"m{k}_{c}") for c in probs]), id_)
    columns = [c for c in wide.columns if c.startswith("m") and "_prob_" in c]
    return train(wide.join(held.select(id_), id_, "left_anti"), label, columns, Spec("logistic"))


def class_neighbours(rows: DataFrame, label: str, k: int, block: int = 1024) -> DataFrame:
    """``rows(label, _k, _v array<double>)`` -> ``(label, _k, _r, _o)``: the k nearest other rows of the class, ``_r`` from 1, ties to the smaller ``_k``.

    Exact: blocks of a class meet in pairs, and each pair keeps the k nearest of its rows. Null or NaN values are farthest.
    """
    sized = rows.withColumn("_b", F.floor(F.col("_k") / block)).withColumn("_n", F.floor((F.count("*").over(Window.partitionBy(label)) - 1) / block))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n")))
    asking = sized.withColumn("_c", every).select(label, F.col("_b").alias("_q"), F.col("_c").alias("_t"), "_k", "_v")
    others = sized.withColumn("_c", every).select(label, F.col("_c").alias("_q"), F.col("_b").alias("_t"), "_k", "_v")

    def search(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs.sort_values("_k")
        a, b = (np.array(x["_v"].tolist(), float) for x in (mine, theirs))
        at, to = mine["_k"].to_numpy(), theirs["_k"].to_numpy()
        d = np.zeros((len(a), len(b)))
        for j in range(a.shape[1] if d.size else 0):
            d += (a[:, j, None] - b[None, :, j]) ** 2
        d[np.isnan(d)] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
        i = np.repeat(np.arange(len(a)), near.shape[1])
        got = pd.DataFrame({"_k": at[i], "_o": to[near.ravel()], "_d": d[i, near.ravel()]})
        got.insert(0, label, pd.Series([key[0]] * len(got), dtype=mine[label].dtype))
        return got[got["_k"] != got["_o"]]

    kind = rows.schema[label].dataType.simpleString()
    pairs = asking.groupBy(label, "_q", "_t").cogroup(others.groupBy(label, "_q", "_t")).applyInPandas(search, f"`{label}` {kind}, _k long, _o long, _d double")
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_k").orderBy("_d", "_o"))).where(F.col("_r") <= k).select(label, "_k", "_r", "_o")


def oversample(df: DataFrame, label: str, columns: list[str], k: int = 5, seed: int = 7, id_: str = "ID") -> DataFrame:
    """Rows of smaller classes made up to the largest one's number, each between a row and one of its k nearest of the class.

    Neighbours are searched inside the class, exactly, in pairs of blocks of rows; classes of one row are repeated.
    """
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    most = max(n.values(), default=0)
    add = F.element_at(F.create_map(*[F.lit(v) for c, m in n.items() for v in (c, most - m)]), F.col(label)) if n else F.lit(0)
    own = F.element_at(F.create_map(*[F.lit(v) for c, m in n.items() for v in (c, m)]), F.col(label)) if n else F.lit(1)
    spot = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(id_, F.lit(seed)), id_)) - 1
    copies = df.withColumn("_k", spot.cast("long")).withColumn("_t", F.floor(add / own) + F.when(F.col("_k") < add % own, 1).otherwise(0))
    seeds = copies.withColumn("_j", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_t"), F.lit(0)).cast("int")))).where("_j between 1 and _t")
    values = copies.where(add > 0).select(label, "_k", F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    near = class_neighbours(values, label, k).join(copies.select(label, F.col("_k").alias("_o"), *[F.col(c).alias(f"_{c}") for c in columns]), [label, "_o"])
    pick = (F.pmod(F.xxhash64("_k", "_j"), F.greatest(F.lit(1), F.least(F.lit(k), own - 1))) + 1).cast("int")
    best = seeds.withColumn("_r", pick).join(near, [label, "_k", "_r"], "left")
    u = F.pmod(F.xxhash64("_k", "_j", F.lit(seed)), F.lit(1000)) / 1000
    made = best.select(*[F.coalesce(F.col(c) + u * (F.col(f"_{c}") - F.col(c)), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    return df.unionByName(made)
