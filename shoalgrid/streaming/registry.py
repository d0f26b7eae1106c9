"""Run records as a stream: the registry's folder read incrementally, with a running best by run type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.sources.tables import RUN_SCHEMA


def stream_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUN_SCHEMA).json(path)


def best_by_type(runs: DataFrame) -> DataFrame:
    """The best score so far of each run type, and the number of runs; state is one row a type."""
    return runs.groupBy("run_type").agg(F.max("metric_weighted_f1").alias("best_f1"), F.max_by("run_id", "metric_weighted_f1").alias("best_run"), F.count("*").alias("runs"))
