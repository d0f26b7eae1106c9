"""Frames of points and records: unions, joins on keys, splits, bands of zones, spreads and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.operators.features import with_average_rank


def seeded_order(id_: str, seed: int) -> Column:
    """A text that orders rows at random by their ids, the same in every run and engine."""
    return F.md5(F.concat_ws("-", F.col(id_).cast("string"), F.lit(str(seed))))


def merge_features(left: DataFrame, right: DataFrame, id_: str = "ID") -> DataFrame:
    """Both frames' columns by id; of columns in both, the left one's stay. Rows are never matched by position."""
    fresh = [c for c in right.columns if c == id_ or c not in left.columns]
    return left.join(right.select(*fresh), id_)


def split_by_ids(rows: DataFrame, ids: DataFrame, id_: str = "ID", other: str = "location_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose id (as text) is among ``ids``, and all others."""
    keys = ids.select(F.col(other).cast("string").alias("_id")).distinct()
    same = rows[id_].cast("string") == keys["_id"]
    return rows.join(keys, same, "left_semi"), rows.join(keys, same, "left_anti")


def stratified_split(df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42, id_: str = "ID", out: str = "held") -> DataFrame:
    """Add ``held``: true for the share ``fraction`` of each class, rounded to whole rows, in a seeded order."""
    w = Window.partitionBy(label)
    place = F.row_number().over(w.orderBy(seeded_order(id_, seed), id_))
    return df.withColumn("_n", F.count("*").over(w)).withColumn(out, place <= F.floor(F.col("_n") * fraction + 0.5)).drop("_n")


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_: str = "ID") -> DataFrame:
    """``n`` rows without replacement, the same in every run."""
    return df.orderBy(seeded_order(id_, seed), id_).limit(n)


def stride(cells: DataFrame, step: int = 20) -> DataFrame:
    """Every ``step``-th cell of every ``step``-th row."""
    if step < 1:
        raise ValueError("the step must be positive")
    return cells.where((F.col("r") % step == 0) & (F.col("c") % step == 0))


def in_band(points: DataFrame, zones: DataFrame, zone: str = "zone", width: int = 1, least: int = 20) -> DataFrame:
    """``points`` once for each of ``zones(zone)`` that they serve, as ``for_zone``: those within ``width`` zones of it.

    A zone with fewer than ``least`` such points is served by all points. Bands are an equi-join on
    the exploded zone, not a join by inequality.
    """
    wanted = zones.select(F.col(zone).alias("for_zone")).where("for_zone is not null").distinct()
    near = points.withColumn("for_zone", F.explode(F.sequence(F.col(zone) - width, F.col(zone) + width))).join(wanted, "for_zone")
    enough = near.groupBy("for_zone").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("for_zone")
    lacking = wanted.join(enough, "for_zone", "left_anti").agg(F.array_sort(F.collect_set("for_zone")).alias("_z"))  # one row, a number for each zone
    every = points.crossJoin(F.broadcast(lacking)).withColumn("for_zone", F.explode("_z")).drop("_z")
    return near.join(enough, "for_zone", "left_semi").unionByName(every)


def zone_fraction(df: DataFrame, value: str, edges: list[float], zone: str = "depth_zone", out: str = "depth_zone_frac") -> DataFrame:
    """Zone of a value by ascending edges, clipped to the first and last, and how far into it the value lies."""
    at = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    lo, hi = (F.element_at(F.array(*map(F.lit, part)), F.col(zone) + 1) for part in (edges[:-1], edges[1:]))
    return df.withColumn(zone, F.when(F.col(value).isNotNull(), at)).withColumn(out, (F.col(value) - lo) / (hi - lo + 1e-8))


def scale_ratio(df: DataFrame, fine: str, coarse: str, out: str = "tpi_ratio") -> DataFrame:
    return df.withColumn(out, F.col(coarse) / (F.abs(fine) + 1))


def texture_interactions(df: DataFrame, depth: str, back: str, slope: str, depth_fine: str, depth_coarse: str, back_fine: str) -> DataFrame:
    """Products of backscatter with depth and slope, coarse over fine depth texture, and the sum of both fine textures."""
    return df.withColumns({
        "bathy_x_back": F.col(depth) * F.col(back), "slope_x_back": F.col(slope) * F.col(back),
        "bathy_roughness_ratio": F.col(depth_coarse) / (F.col(depth_fine) + 1e-6), "relief_index": F.col(depth_fine) + F.col(back_fine),
    })


def valid_cells(cells: DataFrame, values: list[str]) -> DataFrame:
    """Cells that hold all values; also rows that hold an annotation."""
    return cells.dropna(subset=values)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over the frame; those that don't vary become 0."""
    m = F.broadcast(df.agg(*[f(c).alias(f"_{n}{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]))  # one row
    span = lambda c: F.col(f"_hi{c}") - F.col(f"_lo{c}")
    scaled = {c: F.when(F.col(c).isNull(), None).when(span(c) == 0, 0.0).otherwise((F.col(c) - F.col(f"_lo{c}")) / span(c)) for c in columns}
    return df.crossJoin(m).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that a model needs and the frame lacks, as 0."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def vocabulary(df: DataFrame, label: str) -> DataFrame:
    """``(ord, label)``: the distinct labels in order, from 0; labels are few."""
    return df.agg(F.array_sort(F.collect_set(label)).alias("v")).select(F.posexplode("v").alias("ord", label))


def zone_sizes(cells: DataFrame, zone: str) -> DataFrame:
    """Zones, and mean, least and largest number of cells of one."""
    n = cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("zones"), F.avg("n").alias("mean_cells"), F.min("n").alias("least"), F.max("n").alias("largest"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by ``order``."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*").select(*df.columns)


def spread(df: DataFrame, by: str, scores: list[str]) -> DataFrame:
    """Number of runs, and mean, deviation (population), least and largest of each score, by label."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[a for s in scores for a in (F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max"))])


def best_first(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the largest score, the first by ``order`` of equals."""
    return df.where(F.col(score).isNotNull()).groupBy().agg(F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(order))).alias("_r")).where("_r is not null").select("_r.*")


def descending_rank(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Rank from 1 by falling value, ties at their mean cut to a whole number, missing values last."""
    n = F.broadcast(df.agg(F.count(column).alias("_n"), F.count("*").alias("_all")))  # one row
    up = with_average_rank(df, column, "_up").crossJoin(n)
    rank = F.coalesce(F.col("_n") + 1 - F.col("_up"), (F.col("_n") + 1 + F.col("_all")) / 2)
    return up.withColumn(out, rank.cast("int")).select(*df.columns, out)


def top_rows(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(column), tie).limit(n)


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, rho)`` for each pair of columns: correlations of average ranks, one aggregate over joined ranks."""
    ranked = df.select(*columns)
    for c in columns:
        ranked = with_average_rank(ranked, c, f"_r_{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("p")).select("p.*")
