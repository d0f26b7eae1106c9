"""Points, run records, predictions and metadata: tables in text files, with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, run_type string, code_revision string, config_ref string, fold_scheme string, command string, config_hash string, data_split_ref string, "
    "model_type_used string, timestamp string, seed int, metric_weighted_f1 double, artifacts map<string,string>, metric_per_class_f1 map<string,double>, feature_flags_used map<string,boolean>"
)
PREDICTION_COLUMNS = ("location_id", "predicted_class", "confidence")


def numbered(df: DataFrame, id_: str) -> DataFrame:
    """Rows numbered from 1 without gaps, in the order of their partitions: one count for each partition, no sort."""
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = sorted((r["_part"], r["count"]) for r in at.groupBy("_part").count().collect())  # as many rows as partitions
    offsets, total = {}, 0
    for part, n in counts:
        offsets[part], total = total, total + n
    known = df.sparkSession.createDataFrame([(k, v) for k, v in offsets.items()], "_part long, _before long")
    return at.join(F.broadcast(known), "_part").withColumn(id_, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def read_points(spark: SparkSession, path: str, id_: str = "ID", x: str = "x", y: str = "y") -> DataFrame:
    """CSV points with the named columns as ``ID, x, y`` and all others kept; without ids, rows are numbered in file order."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if missing := [c for c in (x, y) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if id_ not in df.columns:
        df = numbered(df, id_)
    for old, new in ((id_, "ID"), (x, "x"), (y, "y")):
        df = df if old == new else df.withColumnRenamed(old, new)
    return df.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})


def require_coordinates(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    if missing := [c for c in (x, y) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    n = df.agg(F.count(x).alias("x"), F.count(y).alias("y")).first()
    if not n["x"] or not n["y"]:
        raise ValueError("coordinates hold no value")
    return df


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path`` if a write of it has ended; otherwise what ``build`` gives, written there first."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_zones(cells: DataFrame, zone: str, path: str, cell: float = 1.0, area: float = 100.0) -> None:
    """Cells of the zones whose area is above ``area``, with the area, as Parquet: a polygon is the cells it covers."""
    wide = cells.where(F.col(zone).isNotNull()).groupBy(zone).agg((F.count("*") * cell * cell).alias("area")).where(F.col("area") > area)
    cells.join(wide, zone).write.mode("overwrite").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The append-only registry of runs, with ``ord`` in the order of registration; a folder of JSON lines files, or none yet.

    Records without a number, of files from elsewhere, come before the others in the order of their time.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{RUN_SCHEMA}, ord long")
    df = spark.read.schema(f"{RUN_SCHEMA}, ord long").json(path).where("run_id is not null")
    return df.withColumn("ord", F.coalesce("ord", F.unix_micros(F.try_to_timestamp("timestamp")) - F.lit(1 << 62)))


def append_run(spark: SparkSession, path: str, record: dict) -> None:
    """Add a record, numbered after all that are there; one writer at a time."""
    last = read_runs(spark, path).agg(F.max("ord").alias("o")).first()["o"]
    row = spark.createDataFrame([record], RUN_SCHEMA).withColumn("ord", F.lit(max(0, (-1 if last is None else last)) + 1).cast("long"))
    row.coalesce(1).write.mode("append").json(path)


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The first record of a run."""
    return runs.where(F.col("run_id") == run_id).orderBy("ord").limit(1)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction frames: the required columns, and probabilities that lie in 0..1."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    probs = [c for c in df.columns if c.startswith("prob_")]
    if missing := [c for c in PREDICTION_COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    bad = F.lit(False)
    for c in [*probs, "confidence"]:
        bad = bad | ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    if df.where(bad).limit(1).count():
        raise ValueError("probabilities must lie in 0..1")
    return df.withColumn("location_id", F.col("location_id").cast("string"))


def parse_metadata(text: str) -> dict[str, str]:
    """``key: value`` lines first, then Markdown sections for keys not found; four keys are required."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        if m := re.match(r"\s*[-*]*\s*\**(\w[\w ]*?)\**\s*:\s*(.+)", line):
            found.setdefault(m[1].strip().lower(), m[2].strip())
    section = None
    for line in text.splitlines():
        if m := re.match(r"(#+)\s*(.+)", line):
            section = m[2].strip().lower()
            if len(m[1]) == 1:
                found.setdefault("title", m[2].strip())
        elif section and line.strip():
            found.setdefault(section, line.strip().lstrip("-* "))
    if "title" in found:
        found.setdefault("description", found["title"])
    if missing := [k for k in ("title", "description", "source", "license") if k not in found]:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    return found
