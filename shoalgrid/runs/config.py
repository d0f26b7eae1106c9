"""Configuration of runs: YAML files, the data files that may be used, and small text files in Spark's file systems."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import yaml
from pyspark.sql import SparkSession

from shoalgrid.operators.features import Flags
from shoalgrid.operators.learning import Spec
from shoalgrid.sources.dictionaries import read_bytes

#: Names of model types in configuration files, and the kinds of models they stand for. Fixed values.
MODEL_TYPES = {
    "rf": "random_forest", "xgb": "boosted", "lgbm": "boosted", "catboost": "deep_boosted", "rf_lgbm_ensemble": "forest_boosted", "mlp": "mlp", "rf_mlp_ensemble": "forest_mlp",
}
#: Data files that a run may read: kinds of files (fixed values), and folders below the data folder.
EXTENSIONS = (".csv", ".tif", ".tiff", ".md", ".json", ".yaml", ".yml")
FOLDERS = ("MBES", "mbes", "rasters")
SCHEMES = ("spatial_blocked", "stratified_random")


@dataclass(frozen=True)
class RunConfig:
    """What a run's YAML file says; without a model type, baselines are forests and candidates boosted."""

    model_type: str | None = None
    n_splits: int = 5
    fold_scheme: str = "spatial_blocked"
    spatial_bins: int = 4
    exclude_coords: bool = False
    flags: Flags = Flags()
    params: dict = field(default_factory=dict)
    #: Columns of terrain layers that a points file may bring along.
    brought: tuple[str, ...] = ("terrain_",)

    def spec(self, run_type: str, seed: int) -> Spec:
        kind = MODEL_TYPES[self.model_type or ("rf" if run_type == "baseline" else "xgb")]
        own = dict(self.params)
        return Spec(kind, {"seed": seed} | own, float(own.get("rf_weight", 0.5)))


def parse_config(text: str) -> RunConfig:
    told = yaml.safe_load(text) or {}
    if not isinstance(told, dict):
        raise ValueError("the configuration must be a mapping")
    kind = told.get("model_type")
    if kind is not None and kind not in MODEL_TYPES:
        raise ValueError(f"model type {kind!r}; known: {', '.join(sorted(MODEL_TYPES))}")
    cv, flags = told.get("cv") or {}, dict(told.get("feature_flags") or {})
    scheme = cv.get("fold_scheme", "spatial_blocked")
    if scheme not in SCHEMES:
        raise ValueError(f"fold scheme {scheme!r}; known: {', '.join(SCHEMES)}")
    coords = bool(flags.pop("exclude_coords", False))
    # switches of groups of columns that a points file brings along have no effect: such columns are taken as they come
    flags = {k: v for k, v in flags.items() if k in Flags.__dataclass_fields__ or not re.fullmatch(r"include_\w+_features", k)}
    if unknown := set(flags) - set(Flags.__dataclass_fields__):
        raise ValueError(f"unknown feature flags: {', '.join(sorted(unknown))}")
    return RunConfig(kind, int(cv.get("n_splits", 5)), scheme, int(cv.get("spatial_bins", 4)), coords, Flags(**flags), told.get("model_params") or {}, tuple(told.get("brought_prefixes") or RunConfig.brought))


def config_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def allowed_data(target: str, root: str, folders: tuple[str, ...] = FOLDERS) -> str:
    """``target`` if it is a data file in ``root`` or in one of these folders of it; else a ValueError."""
    at, base = PurePosixPath(target), PurePosixPath(root)
    if ".." in at.parts or not at.is_relative_to(base):
        raise ValueError(f"{target} is not in {root}")
    parts = at.relative_to(base).parts
    known = at.suffix.lower() in EXTENSIONS
    if known and (len(parts) == 1 or (len(parts) == 2 and parts[0] in folders)):
        return target
    raise ValueError(f"{target} is no data file of {root}")


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode("utf-8-sig")


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file, written by the driver where Spark's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return path


def write_json(spark: SparkSession, path: str, payload: dict | list) -> str:
    return write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True) + "\n")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
