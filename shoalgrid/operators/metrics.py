"""Scores of predictions, from counts of (truth, prediction), and the gates that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_class(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``class, support, n_predicted, hits, precision, recall, f1`` over the union of labels; 0 where undefined.

    One shuffle on counts: each pair of labels votes for the class it should be and the class it was.
    """
    by = by or []
    n = rows.groupBy(*by, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    votes = n.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")),
    )).alias("v")).select(*by, "v.*")
    c = votes.groupBy(*by, "class").agg(F.sum("s").alias("support"), F.sum("q").alias("n_predicted"), F.sum("h").alias("hits"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    c = c.withColumn("precision", share("hits", "n_predicted")).withColumn("recall", share("hits", "support"))
    return c.withColumn("f1", F.when(F.col("support") + F.col("n_predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("n_predicted"))).otherwise(0.0))


def summary(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """``weighted_f1, macro_f1, accuracy, n`` of all rows, or of each group."""
    c = per_class(rows, truth, predicted, by)
    return c.groupBy(*(by or [])).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("f1").alias("macro_f1"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"),
    )


def fold_summary(rows: DataFrame, truth: str, predicted: str, fold: str = "fold") -> DataFrame:
    """Mean and deviation (population) of the folds' weighted F1, and the pooled one."""
    per = summary(rows, truth, predicted, [fold]).agg(F.avg("weighted_f1").alias("mean_f1"), F.stddev_pop("weighted_f1").alias("std_f1"), F.count("*").alias("folds"))
    return per.crossJoin(F.broadcast(summary(rows, truth, predicted).select(F.col("weighted_f1").alias("pooled_f1"))))  # one row each


def fold_class_means(rows: DataFrame, truth: str, predicted: str, fold: str = "fold") -> DataFrame:
    """Per-class F1 averaged over the folds in which the class occurs, in truth or prediction."""
    return per_class(rows, truth, predicted, [fold]).groupBy("class").agg(F.avg("f1").alias("mean_f1"), F.count("*").alias("folds"))


def recall_spread(rows: DataFrame, truth: str, predicted: str, fold: str = "fold") -> DataFrame:
    """Mean and deviation (sample) of recall over the folds whose truth holds the class."""
    return per_class(rows, truth, predicted, [fold]).where("support > 0").groupBy("class").agg(F.avg("recall").alias("mean_recall"), F.stddev_samp("recall").alias("std_recall"))


def class_lines(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(class, f1, line)``: the scores of a report, numbered by class; classes are few."""
    return per_class(rows, truth, predicted).select("class", "f1", F.row_number().over(Window.orderBy("class")).alias("line")).orderBy("line")


def degraded(baseline: float, candidate: float, tolerance: float = 0.005) -> bool:
    """True if the candidate's weighted F1 falls behind by more than ``tolerance``."""
    return baseline - candidate > tolerance


def promote(baseline_f1: float, f1: float, baseline_recall: float, recall: float, least_gain: float = 0.02) -> bool:
    """True if F1 gains ``least_gain`` and the protected class's recall does not fall."""
    return (f1 - baseline_f1 >= least_gain) & (recall - baseline_recall >= 0)


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Probabilities scaled to sum to one; missing ones are 0, and a sum of 0 is left."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return df.withColumn("_t", F.when(total == 0, 1.0).otherwise(total)).withColumns({c: F.coalesce(c, F.lit(0.0)) / F.col("_t") for c in columns}).drop("_t")


def argmax(df: DataFrame, columns: dict[str, str], label: str = "predicted_class", confidence: str = "confidence") -> DataFrame:
    """The class of the largest probability (the first of equals) and that probability; ``columns`` maps classes to columns."""
    values = F.array(*[F.col(c) for c in columns.values()])
    at = F.array_position(values, F.array_max(values)).cast("int")
    return df.withColumn(label, F.element_at(F.array(*[F.lit(k) for k in columns]), at)).withColumn(confidence, F.array_max(values))


def blend(df: DataFrame, parts: list[tuple[str, float]], classes: list[str]) -> DataFrame:
    """``prob_{class}`` as the weighted mean of ``{prefix}_{class}``; weights must sum to one within 0.01."""
    if abs(sum(w for _, w in parts) - 1) > 0.01:
        raise ValueError("weights must sum to one")
    total = sum(w for _, w in parts)
    return df.withColumns({f"prob_{k}": sum((F.col(f"{p}_{k}") * (w / total) for p, w in parts[1:]), F.col(f"{parts[0][0]}_{k}") * (parts[0][1] / total)) for k in classes})


def blend_search(df: DataFrame, left: str, right: str, classes: list[str], truth: str, steps: int = 10) -> DataFrame:
    """Weighted F1 of ``w * left + (1 - w) * right`` for each weight of a grid; ``weight`` is that of the left."""
    grid = df.withColumn("step", F.explode(F.array(*map(F.lit, range(steps + 1)))))
    w = F.col("step") / steps
    mixed = grid.withColumns({f"_p_{k}": w * F.col(f"{left}_{k}") + (1 - w) * F.col(f"{right}_{k}") for k in classes})
    told = argmax(mixed, {k: f"_p_{k}" for k in classes}, "_pred", "_conf")
    return summary(told, truth, "_pred", ["step"]).select((F.col("step") / steps).alias("weight"), "weighted_f1")


def majority_vote(votes: DataFrame, scores: dict[int, float], id_: str = "ID", seed: str = "seed", label: str = "class") -> DataFrame:
    """``(ID, class, votes, total)``; ties go to the class that the best-scored seed among the tied voted for."""
    score = F.element_at(F.create_map(*[F.lit(x) for s, v in scores.items() for x in (s, v)]), F.col(seed))
    n = votes.withColumn("_s", score).groupBy(id_, label).agg(F.count("*").alias("votes"), F.max("_s").alias("_s"), F.min(seed).alias("_f"))
    best = n.withColumn("total", F.sum("votes").over(Window.partitionBy(id_)))
    return best.groupBy(id_).agg(F.max_by(F.struct(label, "votes", "total"), F.struct("votes", F.coalesce("_s", F.lit(-1.0)), -F.col("_f"))).alias("b")).select(id_, F.col(f"b.{label}").alias(label), "b.votes", "b.total")
