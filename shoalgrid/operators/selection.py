"""Ranks and exact quantiles of a column of any size, without a task that holds all its values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import unwritten, written

#: Accuracy of the sketch that brackets a quantile, and from how many rows on a bracket is narrowed further.
ACCURACY, WIDE, PASSES = 10_000, 1_000_000, 3


def running_counts(counts: DataFrame, order: list[str], n: str = "n", out: str = "before") -> DataFrame:
    """Add ``out``, the sum of ``n`` over all rows that sort before; ``order`` tells rows apart.

    Rows are range-partitioned by sampled borders and written with their partition. Sums run within a
    partition; what lies before it is a table with one row a partition.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = written(counts.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums, offsets, before = held.groupBy("_part").agg(F.sum(n).alias("s")).orderBy("_part").collect(), [], 0
    for r in sums:
        offsets.append((r["_part"], before))
        before += r["s"]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _start long"))
    within = F.sum(n).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, "_part").withColumn(out, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """``(column, out)``: each distinct value's rank from 1, ties at their mean; NaN is one value, the largest. Nulls have no rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    told = running_counts(counts, [column], "_n", "_before")
    return told.select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], wide: int = WIDE, stored: bool = False) -> dict[str, list[float | None]]:
    """The quantiles of each column that ``percentile`` gives: between the two nearest ranks, linearly; None without values.

    Nulls are left out, NaN counts as the largest value. A mergeable sketch brackets each wanted rank; what lies
    within the bracket is sketched again while it is more than ``wide`` rows (a few times at most: a
    bracket holds some 1 in 2,500 of what it is taken from), and then counted by value and ranked over all tasks. That the
    brackets hold the ranks is checked by counts, and one that doesn't is opened to all values. Only counts, borders and the
    wanted values come to the driver. The columns are written once, unless ``df`` is ``stored`` already.
    """
    columns = list(wanted)
    held = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    held = held if stored else written(held)
    value = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(columns))]
    sizes = held.agg(*[a for i, v in enumerate(value) for a in (F.count(v).alias(f"n{i}"), F.count(f"c{i}").alias(f"a{i}"))]).first()
    marks = []  # column, probability, lower and upper rank
    for i, c in enumerate(columns):
        for p in wanted[c]:
            if not 0 <= p <= 1:
                raise ValueError("probabilities lie between 0 and 1")
            at = p * (sizes[f"a{i}"] - 1)
            marks.append((i, p, math.floor(at), math.ceil(at)))
    infinite = float("inf")
    open_ = [q for q, (i, _, lo, _) in enumerate(marks) if sizes[f"a{i}"] and lo < sizes[f"n{i}"]]
    bracket = {q: (-infinite, infinite, 0, sizes[f"n{marks[q][0]}"]) for q in open_}  # from, to, rows before, rows within

    def top(q: int) -> int:
        return min(marks[q][3], sizes[f"n{marks[q][0]}"] - 1)

    inside = lambda q, b: (value[marks[q][0]] >= b[0]) & (value[marks[q][0]] <= b[1])
    for _ in range(PASSES):
        again = [q for q in open_ if bracket[q][3] > wide and bracket[q][0] < bracket[q][1]]
        if not again:
            break
        asks = []
        for q in again:
            _, _, before, within = bracket[q]
            ends = [max(0.0, (marks[q][2] - before) / within - 2 / ACCURACY), min(1.0, (top(q) - before + 1) / within + 2 / ACCURACY)]
            asks.append(F.percentile_approx(F.when(inside(q, bracket[q]), value[marks[q][0]]), F.array(*map(F.lit, ends)), ACCURACY).alias(f"q{q}"))
        found = held.agg(*asks).first()
        tried = {q: tuple(found[f"q{q}"]) for q in again}
        counted = held.agg(*[a for q in again for a in (F.count(F.when(value[marks[q][0]] < tried[q][0], 1)).alias(f"b{q}"), F.count(F.when(inside(q, tried[q]), 1)).alias(f"w{q}"))]).first()
        for q in again:
            before, within = counted[f"b{q}"], counted[f"w{q}"]
            if before <= marks[q][2] and top(q) < before + within:
                bracket[q] = (*tried[q], before, within)
    rows = F.array(*[F.when(inside(q, bracket[q]), F.struct(F.lit(q).alias("q"), value[marks[q][0]].alias("v"))) for q in open_])
    result: dict[int, dict[int, float]] = {q: {} for q in open_}
    if open_:
        counts = held.select(F.explode(rows).alias("x")).where("x is not null").select("x.*").groupBy("q", "v").agg(F.count("*").alias("n"))
        told = running_counts(counts, ["q", "v"])
        first, start = {}, 0
        for q in open_:
            first[q], start = start, start + bracket[q][3]
        near = F.lit(False)
        for q in open_:
            for rank in {marks[q][2], top(q)}:
                at = first[q] + rank - bracket[q][2]
                near = near | ((F.col("q") == q) & (F.col("before") <= at) & (F.col("before") + F.col("n") > at))
        for r in told.where(near).collect():  # two rows a quantile at most
            q = r["q"]
            for rank in {marks[q][2], top(q)}:
                if r["before"] <= first[q] + rank - bracket[q][2] < r["before"] + r["n"]:
                    result[q][rank] = r["v"]
    if not stored:
        unwritten(held)
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for q, (i, p, lo, hi) in enumerate(marks):
        if not sizes[f"a{i}"]:
            out[columns[i]].append(None)
            continue
        at, n = p * (sizes[f"a{i}"] - 1), sizes[f"n{i}"]
        low = result[q][lo] if lo < n else math.nan
        high = result[q][hi] if hi < n else math.nan
        out[columns[i]].append(low if lo == hi or low == high else (hi - at) * low + (at - lo) * high)
    return out
