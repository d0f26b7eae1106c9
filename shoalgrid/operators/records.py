"""Around the models: class masks, submissions, run records and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators.asof import asof_join


def grid_indices(points: DataFrame, x: str = "x", y: str = "y", width: float | None = None) -> DataFrame:
    """``gx`` and ``gy``: dense ranks of the coordinates from 0, by joins with the distinct values.

    Values are ranked inside ranges of about equal extent, whose offsets are counted, so no task sorts them all.
    """
    m = points.agg(*[f(c).alias(f"{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def ranks(c: str, out: str) -> DataFrame:
        lo, hi = float(m[f"lo{c}"] or 0), float(m[f"hi{c}"] or 0)
        step = width or ((hi - lo) / 256 or 1.0)
        values = points.where(F.col(c).isNotNull()).select(c).distinct().withColumn("_p", F.floor((F.col(c) - lo) / step))
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
        offsets = values.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_o")
        placed = values.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(c))).join(offsets, "_p")
        return placed.select(c, (F.col("_o") + F.col("_r") - 1).cast("int").alias(out))

    return points.join(ranks(x, "gx"), x).join(ranks(y, "gy"), y)


def class_indices(points: DataFrame, label: str, order: str) -> DataFrame:
    """``(label, cls)``: classes numbered from 0 by first appearance in ``order``."""
    first = points.groupBy(label).agg(F.min(order).alias("_o"))
    return first.select(label, (F.row_number().over(Window.orderBy("_o")) - 1).cast("smallint").alias("cls"))


def paint_masks(points: DataFrame, label: str, order: str, window: int = 5, x: str = "x", y: str = "y") -> DataFrame:
    """``(gy, gx, cls)``: every point paints a square of cells; the earliest in ``order`` keeps a cell."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd")
    grid = grid_indices(points, x, y).join(F.broadcast(class_indices(points, label, order)), label)  # one row per class
    size = grid.agg(F.max("gx").alias("w"), F.max("gy").alias("h")).first()
    span = F.sequence(F.lit(-(window // 2)), F.lit(window // 2))
    cells = grid.withColumn("_y", F.explode(span)).withColumn("_x", F.explode(span))
    cells = cells.select((F.col("gy") + F.col("_y")).alias("gy"), (F.col("gx") + F.col("_x")).alias("gx"), "cls", F.col(order).alias("_o"))
    cells = cells.where(F.col("gy").between(0, size["h"] or 0) & F.col("gx").between(0, size["w"] or 0))
    return cells.groupBy("gy", "gx").agg(F.min_by("cls", "_o").alias("cls"))


def submission_problems(submission: DataFrame, expected: DataFrame, classes: list[str], id_: str = "ID", label: str = "class") -> DataFrame:
    """``(problem, value)``: duplicate, missing and unexpected ids, and classes outside the vocabulary; empty if all is well."""
    if submission.columns != [id_, label]:
        raise ValueError(f"columns must be {id_}, {label}")
    key = F.col(id_).cast("string").alias("value")
    ids, due = submission.select(key), expected.select(key).distinct()
    found = ids.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), "value")
    found = found.unionByName(due.join(ids, "value", "left_anti").select(F.lit("missing").alias("problem"), "value"))
    found = found.unionByName(ids.distinct().join(due, "value", "left_anti").select(F.lit("unexpected").alias("problem"), "value"))
    bad = submission.where(~F.coalesce(F.col(label).isin(classes), F.lit(False))).select(F.lit("class").alias("problem"), F.coalesce(F.col(label), F.lit("")).alias("value")).distinct()
    return found.unionByName(bad)


def write_submission(submission: DataFrame, expected: DataFrame, classes: list[str], path: str) -> None:
    """Validated ``ID,class`` CSV in one file; problems raise an error that shows the first five."""
    if bad := [(r["problem"], r["value"]) for r in submission_problems(submission, expected, classes).limit(5).collect()]:
        raise ValueError(f"invalid submission: {bad}")
    submission.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def lineage(runs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Each run beside the first other run of the same ``config_ref``, ``seed`` and ``run_type``.

    ``status`` is ``no_lineage`` or ``evaluated``; ``within`` tells whether the scores differ by
    at most ``tolerance``. ``ord`` is the order of registration.
    """
    key = Window.partitionBy("config_ref", "seed", "run_type").orderBy("ord")
    first, second = F.first("ord").over(key), F.nth_value("ord", 2).over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    score = lambda k: F.nth_value("metric_weighted_f1", k).over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = F.col("ord") == first
    out = runs.withColumn("other", F.when(own, second).otherwise(first)).withColumn("_m", F.when(own, score(2)).otherwise(score(1)))
    drift = F.abs(F.col("metric_weighted_f1") - F.col("_m"))
    return out.select("run_id", "ord", "other", drift.alias("drift"), F.when(F.col("other").isNull(), "no_lineage").otherwise("evaluated").alias("status"), (drift <= tolerance + 1e-12).alias("within"))


def latest_baseline(runs: DataFrame, run_type: str = "baseline", before: int | None = None) -> DataFrame:
    """The last registered run of a type, optionally before another one."""
    r = runs.where(F.col("run_type") == run_type)
    r = r if before is None else r.where(F.col("ord") < before)
    return r.groupBy().agg(F.max_by(F.struct(*runs.columns), "ord").alias("r")).where("r is not null").select("r.*")


def earlier_baselines(runs: DataFrame, by: list[str], run_type: str = "baseline") -> DataFrame:
    """Every run that is no baseline, with the last baseline of the same ``by`` registered before it and how much the score has risen.

    ``(run_id, ord, baseline, baseline_ord, rise)``; the last three are null for runs without an earlier baseline.
    """
    told = asof_join(runs.where(F.col("run_type") != run_type), runs.where(F.col("run_type") == run_type), by, "ord", "run_id")
    rise = F.col("metric_weighted_f1") - F.col("earlier.metric_weighted_f1")
    return told.select("run_id", "ord", F.col("earlier.run_id").alias("baseline"), F.col("earlier.ord").alias("baseline_ord"), rise.alias("rise"))


def compare_runs(candidate: DataFrame, baseline: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per-class scores side by side; ``(class, f1)`` each."""
    both = candidate.select("class", F.col("f1").alias("candidate_f1")).join(baseline.select("class", F.col("f1").alias("baseline_f1")), "class", "full")
    d = F.coalesce("candidate_f1", F.lit(0.0)) - F.coalesce("baseline_f1", F.lit(0.0))
    return both.withColumn("delta", d).withColumn("degraded", -d > tolerance)


def gate_report(runs: DataFrame, least_score: float = 0.65, least_class_f1: float = 0.30, name: str = "SGZ") -> DataFrame:
    """The best run at or above ``least_score``, and whether any run's F1 of a class reaches ``least_class_f1``."""
    f = F.try_element_at("metric_per_class_f1", F.lit(name))
    return runs.groupBy().agg(
        F.max_by("run_id", "metric_weighted_f1").alias("best_run"), F.max("metric_weighted_f1").alias("best_f1"), (F.max("metric_weighted_f1") >= least_score).alias("score_gate"),
        F.max_by("run_id", f).alias("best_class_run"), F.max(f).alias("best_class_f1"), (F.coalesce(F.max(f), F.lit(0.0)) >= least_class_f1).alias("class_gate"),
    )
