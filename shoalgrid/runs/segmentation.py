"""Candidates that give every point class probabilities, their benchmark, and a stack over them with a gate."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.operators import features as ft
from shoalgrid.operators import frames as fr
from shoalgrid.operators import learning as ln
from shoalgrid.operators import metrics as mt
from shoalgrid.operators import records as rc
from shoalgrid.operators import zonal as zn
from shoalgrid.runs import config as cf
from shoalgrid.sources import tables

#: The candidates, in the order they are tried; names of configuration files. Fixed values.
CANDIDATES = ("segformer_ft", "segformer_ft_crf", "deeplabv3_ft")


def build_masks(spark: SparkSession, train_csv: str, out: str, label: str = "class", window: int = 5) -> str:
    """Class masks of labelled points, as Parquet cells, and what they hold as JSON."""
    points = tables.numbered(spark.read.csv(train_csv, header=True, inferSchema=True), "_ord")
    masks = rc.paint_masks(points, label, "_ord", window)
    masks.write.mode("overwrite").parquet(f"{out}/masks")
    classes = [r[label] for r in rc.class_indices(points, label, "_ord").orderBy("cls").collect()]
    size = spark.read.parquet(f"{out}/masks").agg(F.max("gy").alias("h"), F.max("gx").alias("w"), F.count("*").alias("n")).first()
    cf.write_json(spark, f"{out}/mask_metadata.json", {"classes": classes, "window_size": window, "painted": size["n"], "height": (size["h"] or 0) + 1, "width": (size["w"] or 0) + 1})
    return out


def candidate(kind: str, train: DataFrame, rows: DataFrame, columns: list[str], cap: float, seed: int, params: dict) -> DataFrame:
    """``(ID, prob_..., predicted_class, confidence)`` of ``rows`` by one of the candidates, fitted with capped class weights."""
    weights = ft.class_weights(train, "class", 1.0, cap)
    spec = ln.Spec("random_forest", {"seed": seed} | params) if kind == "deeplabv3_ft" else ln.Spec("logistic", {})
    told = ln.train(train, "class", columns, spec, weights).predict(rows)
    probs = [c for c in told.columns if c.startswith("prob_")]
    if kind == "segformer_ft_crf":
        extent = rows.agg((F.max("x") - F.min("x")).alias("w"), F.count("*").alias("n")).first()
        bucket = max(1e-9, 3 * (extent["w"] or 1.0) / max(1.0, extent["n"] or 1) ** 0.5)
        smooth = zn.smooth_probabilities(told.select("ID", "x", "y", *probs), probs, 5, bucket, id_="ID").select("ID", *probs)
        told = mt.argmax(smooth, {c.removeprefix("prob_"): c for c in probs})
    return told.select("ID", *probs, "predicted_class", "confidence")


def benchmark(spark: SparkSession, config: str) -> str:
    """Try all candidates on a stratified split; the best one's predictions and all scores go to a folder, which is returned.

    A candidate that fails is recorded with its message; only if all fail an error is raised.
    """
    told = yaml.safe_load(cf.read_text(spark, config))
    split, cap = told.get("split") or {}, float((told.get("weights") or {}).get("cap", 5.0))
    seed, share = int(split.get("random_state", 42)), float(split.get("val_fraction", 0.2))
    if tuple(told.get("candidates", CANDIDATES)) != CANDIDATES:
        raise ValueError(f"candidates must be {', '.join(CANDIDATES)}")
    train, test = (tables.read_points(spark, told["input"][k]) for k in ("train_csv", "test_csv"))
    if "class" not in train.columns:
        raise ValueError("missing columns: class")
    parted = fr.stratified_split(train.withColumn("class", F.col("class").cast("string")), "class", share, seed)
    rest, val = parted.where("not held").drop("held"), parted.where("held").drop("held")
    columns = [c for c in ft.numeric_columns(train, ("ID", "class")) if c in test.columns]
    run_id = f"seg-{datetime.now(UTC).strftime('%Y%m%d%H%M%S%f')}"
    at = f"{told['output']['base_dir']}/{run_id}"
    rows = []
    for k, kind in enumerate(CANDIDATES):
        began = time.perf_counter()
        try:
            parts = {name: candidate(kind, rest, frame, columns, cap, seed, told.get("model_params") or {}) for name, frame in (("val", val), ("test", test))}
            for name, df in parts.items():
                df.withColumnRenamed("ID", "location_id").write.mode("overwrite").parquet(f"{at}/{kind}/{name}")
            scored = val.select("ID", "class").join(spark.read.parquet(f"{at}/{kind}/val").withColumnRenamed("location_id", "ID"), "ID")
            s = mt.summary(scored, "class", "predicted_class").first()
            recall = mt.per_class(scored, "class", "predicted_class").where(F.col("class") == "SGAM").first()
            rows.append({"candidate_type": kind, "status": "success", "ord": k, "weighted_f1": s["weighted_f1"], "macro_f1": s["macro_f1"], "sgam_recall": recall["recall"] if recall else 0.0, "runtime_minutes": (time.perf_counter() - began) / 60, "class_weight_cap": cap})
        except Exception as e:  # noqa: BLE001  one candidate's failure is a result
            rows.append({"candidate_type": kind, "status": "failed", "ord": k, "weighted_f1": None, "macro_f1": None, "sgam_recall": None, "runtime_minutes": (time.perf_counter() - began) / 60, "class_weight_cap": cap, "message": str(e)[:500]})
    good = [r for r in rows if r["status"] == "success"]
    if not good:
        raise RuntimeError("all candidates failed")
    best = max(good, key=lambda r: (r["weighted_f1"], -r["ord"]))["candidate_type"]
    for name in ("val", "test"):
        spark.read.parquet(f"{at}/{best}/{name}").coalesce(1).write.option("header", True).csv(f"{at}/{name}_location_predictions")
    val.select(F.col("ID").alias("location_id"), "class").coalesce(1).write.option("header", True).csv(f"{at}/val_truth")
    payload = {"run_id": run_id, "candidates": rows, "recommended_candidate": best, "class_weight_strategy": "inverse_freq_capped", "class_weight_cap": cap, "split": {"val_fraction": share, "random_state": seed}}
    cf.write_json(spark, f"{at}/candidate_metrics.json", checked_metrics(payload))
    return at


def checked_metrics(payload: dict) -> dict:
    """The payload, if it lists candidates with their type, status and run time; else a ValueError."""
    rows = payload.get("candidates")
    if not isinstance(rows, list) or not rows:
        raise ValueError("candidate metrics must list candidates")
    for r in rows:
        if not isinstance(r, dict) or (lacking := {"candidate_type", "status", "runtime_minutes"} - set(r)):
            raise ValueError(f"a candidate lacks {sorted(lacking) if isinstance(r, dict) else 'its fields'}")
    return payload


def hybrid_stack(spark: SparkSession, baseline_run: str, seg_run: str, train_csv: str, test_csv: str, base_dir: str, home: str, seed: int = 42, params: dict | None = None) -> dict:
    """A logistic stack over a forest, a network and the benchmark's best candidate, and whether it passes the gate.

    Forest and network learn from the rows outside the benchmark's validation part. The stack learns from
    one half of that part and is scored, against the candidate, on the other. Everything meets by id. If the gate fails,
    the baseline's predictions stand, or the candidate's if there are none.
    """
    seg = f"{base_dir}/{seg_run}"
    val, test = (tables.read_predictions(spark, f"{seg}/{k}_location_predictions").withColumnRenamed("location_id", "ID") for k in ("val", "test"))
    truth = spark.read.csv(f"{seg}/val_truth", header=True, inferSchema=True)
    rows, todo = (tables.read_points(spark, p) for p in (train_csv, test_csv))
    columns = [c for c in ft.numeric_columns(rows, ("ID", "class")) if c in todo.columns]
    held, rest = fr.split_by_ids(rows, truth)
    forest = ln.train(rest, "class", columns, ln.Spec("random_forest", {"seed": seed, "trees": 250} | (params or {})))
    network = ln.train(rest, "class", columns, ln.Spec("mlp", {"seed": seed, "hidden": (32,)}))

    def meta(frame: DataFrame, told: DataFrame) -> DataFrame:
        out = frame.select(F.col("ID").cast("string").alias("ID"), *(["class"] if "class" in frame.columns else []))
        for k, part in (("rf", forest.predict(frame)), ("mlp", network.predict(frame)), ("seg", told)):
            probs = [c for c in part.columns if c.startswith("prob_")] + (["confidence"] if k == "seg" else [])
            out = out.join(part.select(F.col("ID").cast("string").alias("ID"), *[F.col(c).alias(f"{k}_{c}") for c in probs]), "ID")
        return out

    known, unknown = meta(held, val), meta(todo, test)
    used = [c for c in known.columns if c.startswith(("rf_", "mlp_", "seg_"))]
    half = fr.stratified_split(known, "class", 0.5, seed)
    stack = ln.train(half.where("not held").drop("held"), "class", used, ln.Spec("logistic"))
    judged = half.where("held").select("ID")
    hybrid = stack.predict(known.join(judged, "ID", "left_semi")).select("ID", "class", "predicted_class")
    plain = known.join(judged, "ID", "left_semi").select("ID", "class").join(val.select("ID", "predicted_class"), "ID")
    score = lambda df: mt.summary(df, "class", "predicted_class").first()["weighted_f1"]

    def recall(df: DataFrame) -> float:
        r = mt.per_class(df, "class", "predicted_class").where(F.col("class") == "SGAM").first()
        return r["recall"] if r else 0.0

    told = {"baseline_run": baseline_run, "seg_run": seg_run, "hybrid_weighted_f1": score(hybrid), "baseline_weighted_f1": score(plain), "hybrid_sgam_recall": recall(hybrid), "baseline_sgam_recall": recall(plain)}
    passed = bool(mt.promote(told["baseline_weighted_f1"], told["hybrid_weighted_f1"], told["baseline_sgam_recall"], told["hybrid_sgam_recall"]))
    run_id = f"hybrid-{datetime.now(UTC).strftime('%Y%m%d%H%M%S%f')}"
    told |= {"run_id": run_id, "gate_passed": passed, "decision_reason": "stack promoted" if passed else "gate failed, baseline kept"}
    earlier = f"{home}/predictions/{baseline_run}_test_predictions"
    if passed:
        final = stack.predict(unknown).select("ID", F.col("predicted_class").alias("class"))
    elif cf.exists(spark, earlier):
        final = spark.read.csv(earlier, header=True, inferSchema=True).select("ID", "class")
    else:
        final = test.select("ID", F.col("predicted_class").alias("class"))
    told["predictions"] = f"{home}/predictions/{run_id}_test_predictions"
    final.coalesce(1).write.mode("overwrite").option("header", True).csv(told["predictions"])
    cf.write_json(spark, f"{home}/runs/{run_id}/hybrid_metrics.json", {k: told[k] for k in told if k != "decision_reason"})
    cf.write_json(spark, f"{home}/runs/{run_id}/promotion_decision.json", {k: told[k] for k in ("gate_passed", "decision_reason", "hybrid_weighted_f1", "baseline_weighted_f1", "hybrid_sgam_recall", "baseline_sgam_recall")})
    return json.loads(json.dumps(told))
