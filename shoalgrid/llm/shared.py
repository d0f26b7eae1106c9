"""What the corpus operators share: staging tables, text columns, labelled samples.

Everything here is written so that a job survives the loss of an executor: lineage is
cut only by writing a Parquet table into the folder that ``spark.checkpoint.dir`` names,
which every executor can read, never by a copy that lives on one executor.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of every contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` (or the context) names.

    Where neither does, a session whose executors are threads of this process gets a temporary
    folder, once; on a cluster, where no folder of one machine would serve, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="shoalgrid-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here.

    The shuffle files of the write go with it; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shoalgrid/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a table written by ``staged`` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null ids give null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and 0/1 targets of a bounded sample of labelled rows, for fitting on the driver; and the labels' counts by class.

    ``held_out`` is a condition on ``doc_id``; rows that fulfil it, and rows where it is
    null, are never taken. At most ``per_class`` ids of each class are chosen, in the order
    of a hash of the id, so reruns agree; their texts are taken whole, null ones as empty. The
    ids are chosen from the narrow label table alone, so only the chosen rows' texts ever move;
    their number is bounded by ``2 * per_class``, which is what makes the broadcast safe.
    """
    votes = (
        labels.select("doc_id", F.col(target).cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id").agg(F.max("_y").alias("_y"))
    )
    totals = {r["_y"]: r["count"] for r in votes.groupBy("_y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = votes.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_y")
    )
    rows = sorted({(r["doc_id"], r["text"], r["_y"]) for r in texts.toLocalIterator(prefetchPartitions=True)})
    return [(t, y) for _, t, y in rows], {y: totals.get(y, 0) for y in (0, 1)}


def release_memory() -> None:
    """Give what a worker no longer uses back to the system: workers live on between tasks, and share their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def skewed_left_join(big: DataFrame, small: DataFrame, on: list[str], bytes_bound: int = 8 << 20) -> DataFrame:
    """Left join that broadcasts ``small``, a table read from files, only if its files are within ``bytes_bound``.

    Beyond the bound the plain shuffle join is left to adaptive execution, which splits the
    partitions of ``big`` that a hot key fills.
    """
    if stored_bytes(small) <= bytes_bound:
        small = F.broadcast(small)
    return big.join(small, on, "left")


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
