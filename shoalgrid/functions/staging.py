"""Cutting lineage: a result that several later steps read is written once to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the folder that ``spark.checkpoint.dir`` (or the context) names.

    Where neither does, a session whose executors are threads of this process gets a temporary
    folder, once; on a cluster, where no folder of one machine would serve, it is an error.
    """
    _checkpoint_dir(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the same folder and read back, for rounds of joins: ``df`` is worked out once, and its
    size is that of its files. A checkpoint keeps the planner's guess, which squares with every round until planning takes longer than the work.

    The files go when ``unwritten`` is called, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_checkpoint_dir(df)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _checkpoint_dir(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shoalgrid-"))
    return sc._jsc.sc().getCheckpointDir().get()
