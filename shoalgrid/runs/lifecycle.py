"""The life of a run: train and register, evaluate against the last baseline, predict, write a submission.

Everything lies under one folder, ``home``: ``runs/<id>`` holds a run's model and records,
``registry`` the run records, ``predictions`` and ``reports`` what came of them.
"""

from __future__ import annotations

import json
import subprocess
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.operators import features as ft
from shoalgrid.operators import frames as fr
from shoalgrid.operators import learning as ln
from shoalgrid.operators import metrics as mt
from shoalgrid.operators import records as rc
from shoalgrid.operators import sampling as sp
from shoalgrid.runs import config as cf
from shoalgrid.sources import rasters, tables


def sampled_points(spark: SparkSession, points: DataFrame, bathymetry: str, backscatter: str) -> DataFrame:
    """Points with ``bathymetry`` and ``backscatter`` of their cells, each raster by its own map."""
    out = points
    for name, path in (("bathymetry", bathymetry), ("backscatter", backscatter)):
        meta = rasters.read_meta(spark, path)
        cells = rasters.read_tiff(spark, path, name).drop("file")
        out = sp.sample(out, cells, meta.shape(), sp.Affine(meta.a, meta.c, meta.e, meta.f), [name], flag=f"{name}_flag")
    return out


def _points(spark: SparkSession, path: str, bathymetry: str, backscatter: str, label: bool, brought: tuple[str, ...]) -> DataFrame:
    df = tables.require_coordinates(tables.read_points(spark, path))
    if label and "class" not in df.columns:
        raise ValueError("missing columns: class")
    keep = ["ID", "x", "y", *(["class"] if label else []), *(c for c in df.columns if c.startswith(brought))]
    return sampled_points(spark, df.select(*keep), bathymetry, backscatter)


def _revision() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def train_run(spark: SparkSession, train_csv: str, bathymetry: str, backscatter: str, config: str, home: str, run_type: str = "baseline", seed: int = 42, command: str = "train") -> dict:
    """Fit, cross-validate, save and register a run; its record is returned.

    Medians, means, deviations and ecological thresholds are learnt from the training frame and saved
    with the model, so that prediction works with the same. Run ids hold the time to the microsecond.
    """
    text = cf.read_text(spark, config)
    cfg = cf.parse_config(text)
    raw = _points(spark, train_csv, bathymetry, backscatter, True, cfg.brought)
    raw = raw.withColumn("class", F.col("class").cast("string"))
    own = [c for c in ft.numeric_columns(raw) if c != "ID"]
    stats = ft.fit_statistics(raw, own)
    plain = ft.engineer(raw, stats, ft.Flags(**{**asdict(cfg.flags), "include_eco_features": False}))
    eco = ft.EcoModel.fit(plain, "class") if cfg.flags.include_eco_features else None
    made = eco.transform(plain) if eco else plain
    columns = ft.model_columns(made, cfg.exclude_coords)
    spec = cfg.spec(run_type, seed)
    folded = ft.spatial_folds(made, cfg.n_splits, cfg.spatial_bins, seed) if cfg.fold_scheme == "spatial_blocked" else ft.stratified_folds(made, "class", cfg.n_splits, seed)
    told = ln.cross_validate(folded, "class", columns=columns, spec=spec)
    score = float(mt.fold_summary(told, "class", "predicted_class").first()["mean_f1"])
    per_class = {r["class"]: float(r["mean_f1"]) for r in mt.fold_class_means(told, "class", "predicted_class").collect()}
    model = ln.train(made, "class", columns, spec)

    run_id = f"{run_type}-{datetime.now(UTC).strftime('%Y%m%d%H%M%S%f')}"
    at = f"{home}/runs/{run_id}"
    files = {k: f"{at}/{k}.json" for k in ("feature_columns", "class_vocab", "metrics", "provenance", "features")}
    model.save(f"{at}/model")
    vocab = [r["class"] for r in fr.vocabulary(raw, "class").orderBy("ord").collect()]
    cf.write_json(spark, files["feature_columns"], columns)
    cf.write_json(spark, files["class_vocab"], vocab)
    cf.write_json(spark, f"{home}/class_vocabulary.json", vocab)
    cf.write_json(spark, files["features"], {"statistics": asdict(stats), "flags": asdict(cfg.flags), "eco": eco.to_dict() if eco else None, "brought": cfg.brought})
    if eco:
        cf.write_json(spark, f"{at}/eco_thresholds.json", eco.to_dict())
    cf.write_json(spark, files["metrics"], {"run_id": run_id, "run_type": run_type, "weighted_f1": score, "per_class_f1": per_class, "fold_scheme": cfg.fold_scheme})
    record = {
        "run_id": run_id, "run_type": run_type, "code_revision": _revision(), "config_ref": config, "fold_scheme": cfg.fold_scheme, "command": command, "config_hash": cf.config_hash(text),
        "data_split_ref": train_csv, "model_type_used": cfg.model_type or ("rf" if run_type == "baseline" else "xgb"), "timestamp": datetime.now(UTC).isoformat(), "seed": seed,
        "metric_weighted_f1": score, "artifacts": {"model": f"{at}/model", **files}, "metric_per_class_f1": per_class, "feature_flags_used": asdict(cfg.flags),
    }
    cf.write_json(spark, files["provenance"], {k: v for k, v in record.items() if not k.startswith("metric")})
    tables.append_run(spark, f"{home}/registry", record)
    return record


def _record(spark: SparkSession, home: str, run_id: str) -> dict:
    found = tables.find_run(tables.read_runs(spark, f"{home}/registry"), run_id).collect()
    if not found:
        raise ValueError(f"run {run_id} is not registered")
    return found[0].asDict(recursive=True)


def predict_run(spark: SparkSession, run_id: str, test_csv: str, bathymetry: str, backscatter: str, home: str) -> str:
    """``ID,class`` of the points, by the run's model and with the statistics and flags it was trained with."""
    run = _record(spark, home, run_id)
    saved = json.loads(cf.read_text(spark, run["artifacts"]["features"]))
    stats, eco = ft.Statistics(**saved["statistics"]), saved["eco"]
    flags = ft.Flags(**{**saved["flags"], "include_eco_features": False})
    made = ft.engineer(_points(spark, test_csv, bathymetry, backscatter, False, tuple(saved["brought"])), stats, flags)
    if eco:
        made = ft.EcoModel.from_dict(eco).transform(made)
    told = ln.Fitted.load(spark, run["artifacts"]["model"]).predict(made)
    path = f"{home}/predictions/{run_id}_test_predictions"
    told.select("ID", F.col("predicted_class").alias("class")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def evaluate_run(spark: SparkSession, run_id: str, home: str, fold_scheme: str = "spatial_blocked", tolerance: float = 0.005, drift: float = 0.01) -> dict:
    """Compare a run with the last baseline registered before it; reports go to ``reports/metrics`` and ``reports/reproducibility``.

    Without an earlier baseline the run is compared with itself. The gate raises a ValueError if weighted F1 falls behind.
    """
    if fold_scheme != "spatial_blocked":
        raise ValueError("runs are chosen by spatial_blocked folds only")
    runs = tables.read_runs(spark, f"{home}/registry")
    run = _record(spark, home, run_id)
    base = rc.latest_baseline(runs, before=run["ord"]).collect()
    base = base[0].asDict(recursive=True) if base else run
    gain = run["metric_weighted_f1"] - base["metric_weighted_f1"]
    payload = {
        "run_id": run_id, "run_type": run["run_type"], "fold_scheme": run["fold_scheme"], "weighted_f1": run["metric_weighted_f1"], "per_class_f1": run["metric_per_class_f1"],
        "comparison": {"baseline_run_id": base["run_id"], "baseline_weighted_f1": base["metric_weighted_f1"], "delta_weighted_f1": gain, "degraded": bool(mt.degraded(base["metric_weighted_f1"], run["metric_weighted_f1"], tolerance))},
    }
    scores = sorted(run["metric_per_class_f1"].items())
    facts = {"run type": run["run_type"], "fold scheme": run["fold_scheme"], "weighted F1": f"{run['metric_weighted_f1']:.6f}", "baseline": base["run_id"], "baseline's weighted F1": f"{base['metric_weighted_f1']:.6f}", "difference": f"{gain:.6f}"}
    at = f"{home}/reports/metrics/{run_id}"
    cf.write_text(spark, f"{at}_comparison.md", _page(f"Comparison of {run_id}", facts, "F1 by class", [f"{c}: {v:.6f}" for c, v in scores]))
    cf.write_json(spark, f"{at}_metrics.json", payload)
    cf.write_text(spark, f"{at}_per_class.csv", "class,f1\n" + "".join(f"{c},{v}\n" for c, v in scores))
    reproducibility(spark, run_id, home, drift)
    if payload["comparison"]["degraded"]:
        raise ValueError(f"weighted F1 falls {-gain:.6f} behind {base['run_id']}")
    return payload


def reproducibility(spark: SparkSession, run_id: str, home: str, tolerance: float = 0.01) -> dict:
    """How far a run is from the first other one of its configuration, seed and type, as a page and as JSON."""
    told = rc.lineage(tables.read_runs(spark, f"{home}/registry"), tolerance).where(F.col("run_id") == run_id).first()
    if told is None:
        raise ValueError(f"run {run_id} is not registered")
    payload = {"run_id": run_id, "status": told["status"], "drift": told["drift"], "drift_detected": told["within"] is False, "tolerance": tolerance}
    at = f"{home}/reports/reproducibility/{run_id}_reproducibility"
    lines = [f"difference of weighted F1: {told['drift']:.6f}"] if told["drift"] is not None else ["no other run of this configuration, seed and type"]
    cf.write_json(spark, f"{at}.json", payload)
    cf.write_text(spark, f"{at}.md", _page(f"Reproducibility of {run_id}", {k: payload[k] for k in ("status", "drift_detected", "tolerance")}, "Difference", lines))
    return payload


def _page(title: str, facts: dict, section: str, lines: list[str]) -> str:
    return "\n".join([f"# {title}", "", *(f"* {k}: {v}" for k, v in facts.items()), "", f"## {section}", "", *(f"* {x}" for x in lines), ""])


def make_submission(spark: SparkSession, predictions: str, sample: str, out: str, home: str) -> str:
    """A checked ``ID,class`` CSV of the predictions for the ids of a sample submission."""
    classes = json.loads(cf.read_text(spark, f"{home}/class_vocabulary.json"))
    read = lambda p: spark.read.csv(p, header=True, inferSchema=True)
    rc.write_submission(read(predictions), read(sample), classes, out)
    return out
