"""Commands over raster files: ``python -m shoalgrid.cli COMMAND ...``.

Exit codes: 0 done, 1 bad parameters, 2 missing input, 3 unusable dictionary or columns,
4 nothing classified, 5 unexpected.
"""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.operators import classify as cl
from shoalgrid.operators import terrain as t
from shoalgrid.operators.grid import dense
from shoalgrid.operators.sampling import Affine
from shoalgrid.sources import dictionaries, rasters, tables


_log = logging.getLogger("shoalgrid")
#: Commands around runs and their options: required ones, choices with the default first, or defaults.
LIFECYCLE = {
    "train": {"train_csv": ..., "bathymetry_tif": ..., "backscatter_tif": ..., "config": ..., "seed": 42, "run_type": ("baseline", "candidate"), "home": "artifacts"},
    "evaluate": {"run_id": ..., "fold_scheme": ("spatial_blocked", "stratified_random"), "home": "artifacts"},
    "predict": {"run_id": ..., "test_csv": ..., "bathymetry_tif": ..., "backscatter_tif": ..., "home": "artifacts"},
    "make-submission": {"predictions": ..., "sample_submission": ..., "output": ..., "home": "artifacts"},
    "segmentation-build-masks": {"train_csv": ..., "output_dir": ..., "class_col": "class", "window_size": 5},
    "segmentation-benchmark": {"config": ...},
    "hybrid-stack": {"baseline_run": ..., "seg_run": ..., "train_csv": ..., "test_csv": ..., "seg_base_dir": "artifacts/segmentation", "home": "artifacts", "seed": 42},
}


def _spark() -> SparkSession:
    return SparkSession.builder.appName("shoalgrid").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def load(spark: SparkSession, path: str, value: str = "z") -> tuple[DataFrame, rasters.Meta]:
    """Dense cells and the map of one TIFF file."""
    try:
        meta = rasters.read_meta(spark, path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return dense(rasters.read_tiff(spark, path, value).drop("file"), meta.shape()), meta


def save(cells: DataFrame, value: str, meta: rasters.Meta, path: str, dtype: str = "float32", nodata: float | None = -9999) -> None:
    """A TIFF file on the driver for ``.tif``, else Parquet cells."""
    if not path.lower().endswith((".tif", ".tiff")):
        rasters.write_cells(cells.select("r", "c", value), path)
        return
    with open(path, "wb") as f:
        f.write(rasters.to_tiff(cells, value, replace(meta, nodata=nodata if meta.nodata is None else meta.nodata), dtype))


def model(cells: DataFrame, s, entries, broad: tuple[int, int], fine: tuple[int, int]) -> DataFrame:
    """All six layers: both position indices, both standardised, slope and class."""
    return cl.classify(t.habitat_layers(cells, s, broad, fine), entries)


def run_lifecycle(args: argparse.Namespace, spark: SparkSession) -> int:
    """Commands around runs; what they wrote is printed."""
    from shoalgrid.runs import config, lifecycle, segmentation

    match args.command:
        case "train":
            root = args.train_csv.rsplit("/", 1)[0] if "/" in args.train_csv else "."
            for path in (args.train_csv, args.bathymetry_tif, args.backscatter_tif):
                config.allowed_data(path if "/" in path else f"./{path}", root)
            tables.parse_metadata(config.read_text(spark, f"{root}/METADATA.MD"))
            done = lifecycle.train_run(spark, args.train_csv, args.bathymetry_tif, args.backscatter_tif, args.config, args.home, args.run_type, args.seed, " ".join(sys.argv[1:]))["run_id"]
        case "evaluate":
            done = lifecycle.evaluate_run(spark, args.run_id, args.home, args.fold_scheme)["comparison"]
        case "predict":
            done = lifecycle.predict_run(spark, args.run_id, args.test_csv, args.bathymetry_tif, args.backscatter_tif, args.home)
        case "make-submission":
            done = lifecycle.make_submission(spark, args.predictions, args.sample_submission, args.output, args.home)
        case "segmentation-build-masks":
            done = segmentation.build_masks(spark, args.train_csv, args.output_dir, args.class_col, args.window_size)
        case "segmentation-benchmark":
            done = segmentation.benchmark(spark, args.config)
        case "hybrid-stack":
            done = segmentation.hybrid_stack(spark, args.baseline_run, args.seg_run, args.train_csv, args.test_csv, args.seg_base_dir, args.home, args.seed)["predictions"]
    _log.info("%s: %s", args.command, done)
    print(done)
    return 0


def classify_layers(args: argparse.Namespace, spark: SparkSession) -> int:
    """Class raster of standardised positions, slope and depth; 4 if no cell has a class."""
    cells, meta = load(spark, args.bathy)
    for name, path in (("broad", args.broad_std), ("fine", args.fine_std), ("slope", args.slope)):
        cells = cells.join(load(spark, path, name)[0], ["r", "c"], "left")
    out = cl.classify(cells, dictionaries.read_dictionary(spark, args.classdict)).cache()
    if not out.where("code > 0").limit(1).count():
        return 4
    save(out, "code", replace(meta, nodata=0), args.output, "int32")
    return 0


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command in LIFECYCLE:
        return run_lifecycle(args, spark)
    if args.command == "classify":
        return classify_layers(args, spark)
    cells, meta = load(spark, args.bathy)
    s = meta.shape()
    match args.command:
        case "bpi":
            save(t.position_index(cells, s, args.inner, args.outer), "bpi", meta, args.out, "int32")
        case "standardize-bpi":
            save(t.standardise(cells, "z"), "std", meta, args.out, "int32")
        case "slope":
            save(t.slope(cells, s), "slope", meta, args.out)
        case "vrm":
            save(t.ruggedness(cells, s, args.size), "vrm", meta, args.out)
        case "surface-ratio":
            save(t.surface_ratio(cells, s), "surface_ratio", meta, args.out)
        case "depth-stats":
            out = t.focal_stats(cells, s, args.size, tuple(args.stats.split(",")), args.window)
            for k in args.stats.split(","):
                save(out, f"stat_{k}", meta, f"{args.out}_{k}_{args.size:03d}.tif")
        case "scale-compare":
            for n in t.scale_sizes(args.min, args.max, args.count):
                save(t.scale_filter(cells, s, args.filter, n), "filtered", meta, f"{args.out}_{args.filter}_{n:03d}.tif")
        case "run-model":
            out = model(cells, s, dictionaries.read_dictionary(spark, args.dictionary), (args.broad_inner, args.broad_outer), (args.fine_inner, args.fine_outer)).cache()
            for name, kind in (("broad_bpi", "int32"), ("fine_bpi", "int32"), ("broad", "int32"), ("fine", "int32"), ("slope", "float32")) if args.keep else ():
                save(out, name, meta, f"{args.out}_{name}.tif", kind)
            save(out, "code", replace(meta, nodata=0), f"{args.out}_class.tif", "int32")
            return 0 if out.where("code > 0").limit(1).count() else 4
        case "export-features":
            from shoalgrid.plans.table_queries import export_features

            points = tables.read_points(spark, args.points, args.id_col, args.x_col, args.y_col).withColumnRenamed("ID", "id")
            out = export_features(points, cells, s, Affine(meta.a, meta.c, meta.e, meta.f), args.prefix, eco=args.eco)
            out.withColumnsRenamed({"id": args.id_col, "x": args.x_col, "y": args.y_col}).coalesce(1).write.mode("overwrite").option("header", True).csv(args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shoalgrid")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **options) -> None:
        c = sub.add_parser(name)
        c.add_argument("--bathy", required=True)
        c.add_argument("--out", required=True)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **({"required": True} if v is ... else {"action": "store_true"} if v is False else {"default": v, "type": type(v)}))

    add("bpi", inner=1, outer=3)
    add("standardize-bpi")
    add("slope")
    add("vrm", size=3)
    add("surface-ratio")
    add("depth-stats", size=3, stats="mean,std", window="rectangle")
    add("scale-compare", filter="median", min=3, max=11, count=5)
    add("run-model", dictionary=..., broad_inner=1, broad_outer=5, fine_inner=1, fine_outer=3, keep=False)
    for name, options in LIFECYCLE.items():
        c = sub.add_parser(name)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **({"required": True} if v is ... else {"choices": v, "default": v[0]} if isinstance(v, tuple) else {"default": v, "type": type(v)}))
    c = sub.add_parser("classify")
    for k in ("broad-std", "fine-std", "slope", "bathy", "classdict", "output"):
        c.add_argument("--" + k, required=True)
    add("export-features", points=..., id_col="ID", x_col="x", y_col="y", prefix="terrain_", eco=False)
    for c in sub.choices.values():
        c.add_argument("--verbose", action="store_true")
        c.add_argument("--quiet", action="store_true")
        c.add_argument("--log-file")
    return p


def configure_logging(verbose: bool, quiet: bool, log_file: str | None) -> None:
    """Messages to the standard error, or to a file as well; ``verbose`` beats ``quiet``."""
    _log.setLevel(logging.DEBUG if verbose else logging.ERROR if quiet else logging.INFO)
    _log.handlers = [logging.StreamHandler(sys.stderr), *([logging.FileHandler(log_file)] if log_file else [])]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    configure_logging(args.verbose, args.quiet, args.log_file)
    try:
        return run(args, spark or _spark())
    except FileNotFoundError as e:
        code, why = 2, e
    except (dictionaries.DictionaryError, TypeError) as e:
        code, why = 3, e
    except ValueError as e:
        code, why = (3 if "missing columns" in str(e) else 1), e
    except Exception as e:  # noqa: BLE001
        code, why = 5, e
    _log.error("%s: %s", args.command, why)
    return code


if __name__ == "__main__":
    sys.exit(main())
