"""Feature frames: imputation, scaling, ranks, bins, folds, and the ecological transformer.

Statistics are fitted once and kept in small models, so that prediction uses those of training.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.staging import unwritten, written
from shoalgrid.operators.selection import average_ranks, exact_quantiles

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in exclude]


def model_columns(df: DataFrame, exclude_coords: bool = False) -> list[str]:
    """Numeric columns that are neither ids nor labels, nor coordinates if these are excluded."""
    return numeric_columns(df, ("ID", "id", "class", "location_id", *(("x", "y") if exclude_coords else ())))


@dataclass(frozen=True)
class Statistics:
    """What is learnt from a training frame: medians, means and sample deviations by column."""

    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]


def fit_statistics(df: DataFrame, columns: list[str] | None = None) -> Statistics:
    """Exact medians, and one aggregate over the frame; a column without values has median and mean 0 and deviation 1."""
    columns = columns or numeric_columns(df)
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    plain = written(df.select(*[x.alias(c) for c, x in clean.items()]))  # read by the medians and the aggregate
    medians = {c: m[0] for c, m in exact_quantiles(plain, {c: [0.5] for c in columns}, stored=True).items()}
    row = plain.agg(*[a for c in columns for a in (F.avg(c).alias(f"a_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    unwritten(plain)
    return Statistics({c: medians[c] or 0.0 for c in columns}, {c: row[f"a_{c}"] or 0.0 for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})


def impute(df: DataFrame, stats: Statistics) -> DataFrame:
    """Missing values become medians; infinite ones 0."""
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) == float("inf"), 0.0).otherwise(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(stats.median[c])))
    return df.withColumns({c: finite(c) for c in stats.median if c in df.columns})


def with_average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank from 1 with ties at their mean, through the distinct values, which are ranked over all tasks."""
    return df.join(average_ranks(df, column, out), column, "left").select(*df.columns, out)


@dataclass(frozen=True)
class Flags:
    include_interactions: bool = True
    include_focal_stats: bool = True
    include_spatial_z_scores: bool = True
    include_eco_features: bool = False


def engineer(df: DataFrame, stats: Statistics | None = None, flags: Flags = Flags(), eco: "EcoModel | None" = None) -> DataFrame:  # noqa: B008, UP037
    """Imputation, interactions, standardised values and a joint rank of ``bathymetry`` and ``backscatter``."""
    stats = stats or fit_statistics(df)
    out, has = impute(df, stats), set(df.columns)
    pair = {"bathymetry", "backscatter"} <= has
    if flags.include_interactions and pair:
        out = out.withColumn("bathymetry_x_backscatter", F.col("bathymetry") * F.col("backscatter"))
        out = out.withColumn("acoustic_hardness_proxy", F.col("backscatter") / (F.abs("bathymetry") + 1))
    if flags.include_interactions and flags.include_focal_stats:
        part = [F.col(c) if c in has else F.lit(0.0) for c in ("bathymetry_std_3", "backscatter_std_3")]
        out = out.withColumn("relief_index", part[0] + part[1])
    if flags.include_spatial_z_scores:
        for c in ("bathymetry", "backscatter"):
            if c in has:
                out = out.withColumn(f"{c}_z", (F.col(c) - F.lit(stats.mean[c])) / F.lit(stats.std[c]))
        if pair:
            two = written(out.select("bathymetry", "backscatter"))  # counted, and read by both ranks
            n = two.count()
            for c, rank in (("bathymetry", "_rb"), ("backscatter", "_rk")):
                out = out.join(average_ranks(two, c, rank), c, "left").select(*out.columns, rank)
            unwritten(two)
            out = out.withColumn("bathymetry_backscatter_rank", (F.col("_rb") + F.col("_rk")) / (2.0 * n)).drop("_rb", "_rk")
    if flags.include_eco_features:
        out = (eco or EcoModel.fit(out)).transform(out)
    return out


@dataclass(frozen=True)
class EcoModel:
    """Depth bins at the training quartiles, and the niche of one class by position, slope and depth."""

    depth_bin_edges: tuple[float, ...]
    p25_bpi: float
    p25_slope: float
    sgam_depth_min: float
    sgam_depth_max: float

    @classmethod
    def fit(cls, df: DataFrame, label: str | None = None, target: str = "SGAM") -> EcoModel:
        own = F.when(F.col(label) == target, F.col("bathymetry")) if label else F.lit(None).cast("double")
        r = df.agg(F.min(own).alias("lo"), F.max(own).alias("hi")).first()
        q = exact_quantiles(df, {"bathymetry": [0.0, 0.25, 0.5, 0.75, 1.0], "terrain_fine_bpi": [0.25], "terrain_slope": [0.25]})
        edges = q["bathymetry"]
        for k in range(1, len(edges)):
            edges[k] = max(edges[k], edges[k - 1] + 1e-9) if edges[k] <= edges[k - 1] else edges[k]
        return cls(tuple(edges), q["terrain_fine_bpi"][0], q["terrain_slope"][0], r["lo"] or 0.0, r["hi"] or 0.0)

    def transform(self, df: DataFrame) -> DataFrame:
        zone = sum((F.when(F.col("bathymetry") > e, 1).otherwise(0) for e in self.depth_bin_edges[1:-1]), F.lit(1))
        niche = (F.col("terrain_fine_bpi") < self.p25_bpi) & (F.col("terrain_slope") < self.p25_slope) & F.col("bathymetry").between(self.sgam_depth_min, self.sgam_depth_max)
        return df.withColumn("terrain_depth_zone", zone).withColumn("terrain_sgam_niche", F.coalesce(niche, F.lit(False)).cast("int"))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> EcoModel:
        if not d:
            raise ValueError("the transformer is not fitted")
        return cls(**(d | {"depth_bin_edges": tuple(d["depth_bin_edges"])}))


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Exact quantiles that bound equal shares, without repeats."""
    q = exact_quantiles(df, {column: [k / bins for k in range(bins + 1)]})[column]
    return sorted({e for e in q if e is not None})


def quantile_bin(column: str, edges: list[float]) -> Column:
    """Bins closed on the right, the lowest edge included."""
    return sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def spatial_blocks(df: DataFrame, bins: int = 4, x: str = "x", y: str = "y") -> DataFrame:
    """``block``: quantile bin of x times the number of y bins, plus the bin of y."""
    ex, ey = quantile_edges(df, x, bins), quantile_edges(df, y, bins)
    return df.withColumn("block", quantile_bin(x, ex) * F.lit(max(1, len(ey) - 1)) + quantile_bin(y, ey))


def spatial_folds(df: DataFrame, n_splits: int = 5, bins: int = 4, seed: int = 42, x: str = "x", y: str = "y") -> DataFrame:
    """``fold`` of each row, whole blocks together, by a seeded permutation of the at most bins * bins blocks."""
    blocks = spatial_blocks(df, bins, x, y)
    found = sorted(r["block"] for r in blocks.select("block").distinct().collect())
    order = np.random.default_rng(seed).permutation(np.array(found))
    fold = F.create_map(*[F.lit(int(v)) for k, b in enumerate(order) for v in (b, k % n_splits)])
    return blocks.withColumn("fold", F.element_at(fold, F.col("block")))


def stratified_folds(df: DataFrame, label: str, n_splits: int = 5, seed: int = 42, id_: str = "ID") -> DataFrame:
    """``fold`` by a seeded hash order within each class; classes differ by one row at most across folds."""
    w = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("-", F.col(id_).cast("string"), F.lit(str(seed)))), id_)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % n_splits).cast("int"))


def correlation_filter(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Columns left when of each pair with a Spearman correlation above ``threshold`` the one that varies less is dropped.

    Ranks are joined once per column; the correlations are one aggregate whose result is a small matrix.
    """
    ranked = df.select(*columns)
    for c in columns:
        ranked = with_average_rank(ranked, c, f"_r_{c}")
    row = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], *[F.var_samp(c).alias(f"v_{c}") for c in columns]).first()
    dropped: set[str] = set()
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if i < j and not {a, b} & dropped and abs(row[f"{i}_{j}"] or 0.0) > threshold:
                dropped.add(a if (row[f"v_{a}"] or 0) < (row[f"v_{b}"] or 0) else b)
    return [c for c in columns if c not in dropped]


def relative_coordinates(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``x_rel`` and ``y_rel`` in units of the extent (at least 1)."""
    m = F.broadcast(df.agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]))  # one row
    rel = lambda c: (F.col(c) - F.col(f"_lo{c}")) / F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(1.0))
    return df.crossJoin(m).select(*df.columns, rel(x).alias("x_rel"), rel(y).alias("y_rel"))


def one_hot(df: DataFrame, column: str, categories: list, weight: float = 1.0, prefix: str | None = None) -> DataFrame:
    """A column for each of the given categories: ``weight`` where it holds, else 0."""
    return df.withColumns({f"{prefix or column}_{k}": F.when(F.col(column) == k, weight).otherwise(0.0) for k in categories})


def class_weights(df: DataFrame, label: str, floor: float = 1.0, cap: float = 5.0) -> DataFrame:
    """Inverse-frequency weight of each class, clipped."""
    if cap < floor:
        raise ValueError("cap must be at least floor")
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    t = F.broadcast(n.agg(F.sum("n").alias("_t"), F.count("*").alias("_k")))  # one row
    return n.crossJoin(t).select(label, "n", F.greatest(F.lit(floor), F.least(F.lit(cap), F.col("_t") / (F.col("_k") * F.col("n")))).alias("weight"))
