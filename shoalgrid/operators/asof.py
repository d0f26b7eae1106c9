"""As-of joins: each row beside the latest earlier row of another table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import written


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, tie: str, out: str = "earlier", allow_equal: bool = False) -> DataFrame:
    """``left`` with ``out``, the row of ``right`` (a struct) that is the latest before its ``time`` among those with the same ``by``.

    Earlier means strictly so, unless ``allow_equal``. Of rows of ``right`` at one time the one with the largest ``tie``
    counts. Nulls in ``by`` equal each other; a row without a time meets nothing, and is nothing's earlier row. ``out`` is null
    where there is none. ``by`` may be empty.

    No join by inequality: both tables are sorted together over sampled ranges of key and time, each row takes the last one of
    ``right`` before it in its range, and what a range lacks is carried over from the ranges before it, a
    row for each key and range. So a key that holds a third of all rows, or no key at all, is spread over many tasks.
    """
    keys = [f"_by{k}" for k in range(len(by))]
    own = [F.col(c).alias(k) for c, k in zip(by, keys)]
    row, hit = F.struct(*left.columns), F.struct(*right.columns)
    none = lambda df: F.lit(None).cast(df.schema.simpleString())
    first = 0 if allow_equal else 1
    asks = left.select(*own, F.col(time).alias("_t"), F.lit(1 - first).alias("_kind"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_tie"), row.alias("_row"), none(right).alias("_hit"))
    offers = right.where(F.col(time).isNotNull()).select(*own, F.col(time).alias("_t"), F.lit(first).alias("_kind"), F.col(tie).alias("_tie"), none(left).alias("_row"), hit.alias("_hit"))
    order = ["_t", "_kind", "_tie"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(asks.unionByName(offers).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = held.withColumn("_near", F.last("_hit", ignorenulls=True).over(before)).where("_row is not null")
    ends = held.groupBy("_part", *keys).agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).where("_carried is not null").select(F.col("_part").alias("_p"), *[F.col(k).alias(f"{k}_") for k in keys], "_carried")
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("_part") == F.col("_p"))
    found = near.join(carried, met, "left")
    return found.select("_row.*", F.when(F.col("_t").isNotNull(), F.coalesce("_near", "_carried")).alias(out))
