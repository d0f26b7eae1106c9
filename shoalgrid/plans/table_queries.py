"""Queries over points, features, scores and records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.operators import distance as ds
from shoalgrid.operators import features as ft
from shoalgrid.operators import metrics as mt
from shoalgrid.operators import outlines as ol
from shoalgrid.operators import records as rc
from shoalgrid.operators import regions as rg
from shoalgrid.operators import sampling as sp
from shoalgrid.operators import terrain as t
from shoalgrid.operators import texture as tx
from shoalgrid.operators import zonal as zn
from shoalgrid.operators.grid import Shape
from shoalgrid.plans import views
from shoalgrid.plans.terrain_queries import AREA, BASE, SLOPE, around, bpi_sql, horn, offsets, ring3, rounded, std_sql, vrm_sql
from shoalgrid.plans.views import BOTH_SQL, GRID_SQL, POINTS_SQL, SIZE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}
TABLES = f"WITH {BOTH_SQL}, {SIZE_SQL}, {POINTS_SQL}"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _points(spark: SparkSession, sf_dir: str):
    cells = views.both_grids(spark, sf_dir)
    s = views.shape(cells)
    return cells, s, views.points(spark, sf_dir, s.rows)


def located(points: DataFrame, s) -> DataFrame:
    r, c = sp.pixel(F.col("x"), F.col("y"), sp.Affine(), s)
    return points.withColumn("r", r).withColumn("c", c)


@query(f"{TABLES}, k AS (SELECT *, CAST(floor(-y) AS INT) AS pr, CAST(floor(x) AS INT) AS pc FROM p) SELECT id, round(z, 6) AS z, round(g.k, 6) AS k, CASE WHEN pr NOT BETWEEN 0 AND nr - 1 OR pc NOT BETWEEN 0 AND nc - 1 THEN 'out_of_bounds' WHEN g.k IS NULL THEN 'nodata' ELSE '' END AS flag FROM k CROSS JOIN n LEFT JOIN g ON g.r = pr AND g.c = pc")
def sample_flags(spark, sf_dir):  # J1 J2 J3 J4 P5
    cells, s, points = _points(spark, sf_dir)
    return rounded(sp.sample(points, cells, s, sp.Affine(), ["k", "z"], flag="flag").select("id", "z", "k", "flag"), "z", "k")


@query(f"{TABLES} SELECT id, round(g.z, 6) AS z FROM p CROSS JOIN n JOIN g ON g.r = greatest(0, least(nr - 1, round_even(-y, 0))) AND g.c = greatest(0, least(nc - 1, round_even(x, 0)))")
def sample_clipped(spark, sf_dir):  # J5 T8
    cells, s, points = _points(spark, sf_dir)
    return rounded(sp.sample(points, cells, s, sp.Affine(), ["z"], rule="round_clip").select("id", "z"), "z")


EXPORT_SQL = (
    f"{BASE}, {views.POINTS_SQL}, {bpi_sql(1, 5, 'b5')}, {bpi_sql(1, 3, 'b3')}, {std_sql('b5', 's5')}, {std_sql('b3', 's3')}, {ring3('reflect')}, {ring3('clamp', name='rc')}, "
    f"vr AS ({vrm_sql(3, 'ring')}), sr AS (SELECT r, c, {AREA} AS ratio FROM rc) "
    f"SELECT p.id, b5.bpi AS terrain_broad_bpi, b3.bpi AS terrain_fine_bpi, s5.std AS terrain_broad_std, s3.std AS terrain_fine_std, round({SLOPE}, 6) AS terrain_slope, round(vr.vrm, 6) AS terrain_vrm, round(sr.ratio, 6) AS terrain_surface_ratio, "
    "round(sqrt(s5.std * s5.std + s3.std * s3.std), 6) AS terrain_bpi_magnitude, s5.std * s3.std AS terrain_broad_x_fine_std, round(vr.vrm + (sr.ratio - 1), 6) AS terrain_rough_total FROM p LEFT JOIN b5 ON b5.r = floor(-p.y) AND b5.c = floor(p.x) "
    f"LEFT JOIN b3 ON b3.r = b5.r AND b3.c = b5.c LEFT JOIN s5 ON s5.r = b5.r AND s5.c = b5.c LEFT JOIN s3 ON s3.r = b5.r AND s3.c = b5.c LEFT JOIN {horn('ring')} ON q.r = b5.r AND q.c = b5.c "
    "LEFT JOIN vr ON vr.r = b5.r AND vr.c = b5.c LEFT JOIN sr ON sr.r = b5.r AND sr.c = b5.c"
)


def export_features(points: DataFrame, cells: DataFrame, s, t_: sp.Affine = sp.Affine(), prefix: str = "terrain_", broad: tuple[int, int] = (1, 5), fine: tuple[int, int] = (1, 3), vrm: int = 3, texture: int | None = None, eco: bool = False, scales: tuple[int, ...] = (), value: str = "z") -> DataFrame:  # noqa: B008
    """Derivatives of the raster at the points, and their interactions: one join for all layers."""
    work = t.habitat_layers(cells, s, broad, fine, value).withColumnsRenamed({"broad": "broad_std", "fine": "fine_std"})
    work = t.surface_ratio(t.ruggedness(work, s, vrm, value), s, value)
    layers = ["broad_bpi", "fine_bpi", "broad_std", "fine_std", "slope", "vrm", "surface_ratio"]
    if eco:
        work = t.complexity(t.max_curvature(t.northness_eastness(work, s, value), s, value), s, value)
        layers += ["northness", "eastness", "max_curvature", "complexity"]
    for k in scales:
        work = t.relative_deviation(t.multiscale_mean(work, s, [k], value), s, k, value, f"rdmv_{k}")
        layers += [f"{value}_{k}", f"rdmv_{k}"]
    out = sp.habitat_interactions(sp.sample(points, work, s, t_, layers, prefix=prefix), prefix)
    if texture:
        grey = tx.glcm(located(points, s), cells, s, texture, value=value).select("id", F.col("contrast").alias(f"{prefix}contrast"), F.col("homogeneity").alias(f"{prefix}homogeneity"))
        out = out.join(grey, "id", "left")
    return out


@query(EXPORT_SQL)
def point_features(spark, sf_dir):  # export of features: J4 E1 E2 E3 O-F2 O-F3 O-F5 O-F7
    cells = views.depth_grid(spark, sf_dir)
    s = views.shape(cells)
    out = export_features(views.points(spark, sf_dir, s.rows), cells, s)
    layers = ["broad_bpi", "fine_bpi", "broad_std", "fine_std", "slope", "vrm", "surface_ratio", "bpi_magnitude", "broad_x_fine_std", "rough_total"]
    return rounded(out.select("id", *[f"terrain_{k}" for k in layers]), *[f"terrain_{k}" for k in ("slope", "vrm", "surface_ratio", "bpi_magnitude", "rough_total")])


FRAME_SQL = f"{TABLES}, f AS (SELECT p.id, p.x, p.y, p.class, g.z AS bathymetry, g.k AS backscatter FROM p LEFT JOIN g ON g.r = floor(-p.y) AND g.c = floor(p.x))"


def frame(spark, sf_dir) -> DataFrame:
    cells, s, points = _points(spark, sf_dir)
    return sp.sample(points, cells, s, sp.Affine(), ["z", "k"]).select("id", "x", "y", "class", F.col("z").alias("bathymetry"), F.col("k").alias("backscatter"))


@query(f"""{FRAME_SQL}, m AS (SELECT median(bathymetry) AS mb, median(backscatter) AS mk, avg(bathymetry) AS ab, avg(backscatter) AS ak, stddev_samp(bathymetry) AS sb, stddev_samp(backscatter) AS sk FROM f),
i AS (SELECT id, coalesce(bathymetry, mb) AS b, coalesce(backscatter, mk) AS k, ab, ak, sb, sk FROM f, m),
q AS (SELECT *, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS rk, count(*) OVER () AS t FROM i)
SELECT id, round(b * k, 5) AS bathymetry_x_backscatter, round(k / (abs(b) + 1), 6) AS acoustic_hardness_proxy, round(b / 7 + k / 9, 5) AS relief_index, round((b - ab) / sb, 6) AS bathymetry_z, round((k - ak) / sk, 6) AS backscatter_z, round((rb + rk) / (2.0 * t), 6) AS bathymetry_backscatter_rank FROM q""")
def engineered(spark, sf_dir):  # E4 E5 E6 A5 A8 R2
    raw = frame(spark, sf_dir)
    stats = ft.fit_statistics(raw, ["bathymetry", "backscatter"])
    spread = {f"{c}_std_3": F.coalesce(c, F.lit(stats.median[c])) / d for c, d in (("bathymetry", 7), ("backscatter", 9))}  # stands for the focal deviation
    out = ft.engineer(raw.withColumns(spread), stats)
    out = out.select("id", "bathymetry_x_backscatter", "acoustic_hardness_proxy", "relief_index", "bathymetry_z", "backscatter_z", "bathymetry_backscatter_rank")
    return rounded(rounded(out, "acoustic_hardness_proxy", "bathymetry_z", "backscatter_z", "bathymetry_backscatter_rank"), "bathymetry_x_backscatter", "relief_index", digits=5)


@query(f"""{BASE}, {bpi_sql(1, 3, 'b')}, {ring3('reflect')}, e AS (SELECT g.r, g.c, g.z, b.bpi, {SLOPE} AS slope, CASE WHEN g.c % 7 = 0 THEN 'SGAM' ELSE 'NVB' END AS class FROM g JOIN b USING (r, c) JOIN {horn('ring')} USING (r, c)),
h AS (SELECT quantile_cont(z, 0.25) AS q1, quantile_cont(z, 0.5) AS q2, quantile_cont(z, 0.75) AS q3, quantile_cont(bpi, 0.25) AS pb, quantile_cont(slope, 0.25) AS ps, min(z) FILTER (class = 'SGAM') AS lo, max(z) FILTER (class = 'SGAM') AS hi FROM e)
SELECT r, c, 1 + CAST(z > q1 AS INT) + CAST(z > q2 AS INT) + CAST(z > q3 AS INT) AS terrain_depth_zone, CAST(bpi < pb AND slope < ps AND z BETWEEN lo AND hi AS INT) AS terrain_sgam_niche FROM e, h""")
def eco_zones(spark, sf_dir):  # M28 A6 A7 J11 P7
    cells = views.depth_grid(spark, sf_dir)
    s = views.shape(cells)
    work = t.slope(t.position_index(cells, s, 1, 3, out="terrain_fine_bpi"), s, out="terrain_slope")
    work = work.withColumn("class", F.when(F.col("c") % 7 == 0, "SGAM").otherwise("NVB")).withColumnRenamed("z", "bathymetry")
    return ft.EcoModel.fit(work, "class").transform(work).select("r", "c", "terrain_depth_zone", "terrain_sgam_niche")


def _bins(c: str) -> str:
    return " + ".join(f"CAST({c} > e{c}{k} AS INT)" for k in (1, 2, 3))


@query(f"""{TABLES}, e AS (SELECT {', '.join(f'quantile_cont({c}, {k / 4}) AS e{c}{k}' for c in 'xy' for k in (1, 2, 3))} FROM p)
SELECT id, CAST(({_bins('x')}) * 4 + {_bins('y')} AS INT) AS block FROM p, e""")
def quantile_blocks(spark, sf_dir):  # R4 R5
    _, _, points = _points(spark, sf_dir)
    return ft.spatial_blocks(points, 4).select("id", "block")


@query(f"{TABLES} SELECT class, n, round(greatest(0.9, least(1.05, t / (k * n))), 6) AS weight FROM (SELECT class, count(*) AS n FROM p GROUP BY class), (SELECT count(*)::DOUBLE AS t, count(DISTINCT class) AS k FROM p)")
def capped_class_weights(spark, sf_dir):  # A15 A16
    _, _, points = _points(spark, sf_dir)
    return rounded(ft.class_weights(points, "class", 0.9, 1.05), "weight")


@query(f"{TABLES} SELECT id, round((x - min(x) OVER ()) / greatest(max(x) OVER () - min(x) OVER (), 1), 6) AS x_rel, round((y - min(y) OVER ()) / greatest(max(y) OVER () - min(y) OVER (), 1), 6) AS y_rel, {', '.join(f"CASE WHEN class = '{k}' THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS class_{k}" for k in SEGMENTS)} FROM p")
def relative_positions(spark, sf_dir):  # E12 E13 U1
    _, _, points = _points(spark, sf_dir)
    return rounded(ft.one_hot(ft.relative_coordinates(points), "class", list(SEGMENTS), 20.0).select("id", "x_rel", "y_rel", *[f"class_{k}" for k in SEGMENTS]), "x_rel", "y_rel")


#: Truth and a derived prediction: the segment of the customer, and of the one named by a rule on the key.
TOLD_SQL = "told AS (SELECT a.c_custkey AS id, a.c_mktsegment AS truth, CASE WHEN a.c_custkey % 3 = 0 THEN b.c_mktsegment ELSE a.c_mktsegment END AS pred, a.c_custkey % 5 AS fold FROM customer a JOIN (SELECT c_custkey, c_mktsegment FROM customer) b ON b.c_custkey = a.c_custkey // 7 + 1)"
PER_SQL = "per AS (SELECT {by} class, sum(s) AS support, sum(q) AS n_predicted, sum(h) AS hits FROM (SELECT fold, truth AS class, 1 AS s, 0 AS q, CAST(truth = pred AS INT) AS h FROM told UNION ALL SELECT fold, pred, 0, 1, 0 FROM told) GROUP BY {by} class), f AS (SELECT *, CASE WHEN n_predicted > 0 THEN hits / n_predicted ELSE 0 END AS precision_, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall_, 2 * hits / (support + n_predicted) AS f1 FROM per)"


def told(spark, sf_dir) -> DataFrame:
    a = views.read(spark, sf_dir, "customer")
    b = a.select((F.col("c_custkey")).alias("_k"), F.col("c_mktsegment").alias("_seg"))
    j = a.join(b, F.floor(F.col("c_custkey") / 7) + 1 == F.col("_k"))
    return j.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("truth"), F.when(F.col("c_custkey") % 3 == 0, F.col("_seg")).otherwise(F.col("c_mktsegment")).alias("pred"), (F.col("c_custkey") % 5).alias("fold"))


@query(f"WITH {TOLD_SQL}, {PER_SQL.format(by='')} SELECT class, CAST(support AS BIGINT) AS support, CAST(n_predicted AS BIGINT) AS n_predicted, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_scores(spark, sf_dir):  # A10 A11
    return rounded(mt.per_class(told(spark, sf_dir), "truth", "pred").drop("hits"), "precision", "recall", "f1")


@query(f"WITH {TOLD_SQL}, {PER_SQL.format(by='fold,')} SELECT fold, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(f1), 6) AS macro_f1, round(sum(hits) / sum(support), 6) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM f GROUP BY fold")
def fold_scores(spark, sf_dir):  # A9 A11 A12
    return rounded(mt.summary(told(spark, sf_dir), "truth", "pred", ["fold"]), "weighted_f1", "macro_f1", "accuracy")


@query(f"WITH {TOLD_SQL}, {PER_SQL.format(by='fold,')}, pf AS (SELECT fold, sum(f1 * support) / sum(support) AS w FROM f GROUP BY fold), pooled AS (SELECT sum(f1 * s) / sum(s) AS w FROM (SELECT class, sum(support) AS s, 2 * sum(hits) / (sum(support) + sum(n_predicted)) AS f1 FROM f GROUP BY class)) SELECT round(avg(pf.w), 6) AS mean_f1, round(stddev_pop(pf.w), 6) AS std_f1, count(*) AS folds, round(max(pooled.w), 6) AS pooled_f1 FROM pf, pooled")
def cv_summary(spark, sf_dir):  # A12 A13
    return rounded(mt.fold_summary(told(spark, sf_dir), "truth", "pred"), "mean_f1", "std_f1", "pooled_f1")


@query(f"WITH {TOLD_SQL}, {PER_SQL.format(by='fold,')} SELECT class, round(avg(recall_), 6) AS mean_recall, round(stddev_samp(recall_), 6) AS std_recall FROM f WHERE support > 0 GROUP BY class")
def recall_spread(spark, sf_dir):  # A14
    return rounded(mt.recall_spread(told(spark, sf_dir), "truth", "pred"), "mean_recall", "std_recall")


CLASSES = ("ALG", "NVB", "SGZ")
PROB_SQL = "pr AS (SELECT c_custkey AS id, (c_custkey * 7 % 11)::DOUBLE AS a, (c_custkey * 5 % 13)::DOUBLE AS b, (c_custkey * 3 % 17)::DOUBLE AS c, CASE c_custkey % 3 WHEN 0 THEN 'ALG' WHEN 1 THEN 'NVB' ELSE 'SGZ' END AS truth FROM customer), no AS (SELECT id, truth, a / t AS a, b / t AS b, c / t AS c FROM (SELECT *, CASE WHEN a + b + c = 0 THEN 1 ELSE a + b + c END AS t FROM pr))"


def probabilities(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    raw = views.read(spark, sf_dir, "customer").select(k.alias("id"), *[(k * m % d).cast("double").alias(f"prob_{c}") for c, m, d in zip(CLASSES, (7, 5, 3), (11, 13, 17))],
        F.when(k % 3 == 0, "ALG").when(k % 3 == 1, "NVB").otherwise("SGZ").alias("truth"))
    return mt.normalised(raw, [f"prob_{c}" for c in CLASSES])


@query(f"WITH {PROB_SQL} SELECT id, CASE WHEN a >= b AND a >= c THEN 'ALG' WHEN b >= c THEN 'NVB' ELSE 'SGZ' END AS predicted_class, round(greatest(a, b, c), 6) AS confidence FROM no")
def predicted_labels(spark, sf_dir):  # E16 E17 E18
    return rounded(mt.argmax(probabilities(spark, sf_dir), {c: f"prob_{c}" for c in CLASSES}).select("id", "predicted_class", "confidence"), "confidence")


@query(f"""WITH {PROB_SQL}, w AS (SELECT unnest(range(0, 5)) AS step), m AS (SELECT step, truth, step / 4.0 * a + (1 - step / 4.0) * c AS a, step / 4.0 * b + (1 - step / 4.0) * a AS b, step / 4.0 * c + (1 - step / 4.0) * b AS c FROM no, w),
told AS (SELECT step AS fold, truth, CASE WHEN a >= b AND a >= c THEN 'ALG' WHEN b >= c THEN 'NVB' ELSE 'SGZ' END AS pred FROM m), {PER_SQL.format(by='fold,')} SELECT fold / 4.0 AS weight, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f GROUP BY fold""")
def blend_grid(spark, sf_dir):  # E19 T-10
    p = probabilities(spark, sf_dir).select("id", "truth", *[F.col(f"prob_{c}").alias(f"l_{c}") for c in CLASSES], *[F.col(f"prob_{d}").alias(f"r_{c}") for c, d in zip(CLASSES, ("SGZ", "ALG", "NVB"))])
    return rounded(mt.blend_search(p, "l", "r", list(CLASSES), "truth", 4), "weighted_f1")


SEEDS = {42: 0.79, 123: 0.81, 456: 0.76, 789: 0.78, 2026: 0.80}
VOTES_SQL = "v AS (SELECT c_custkey AS id, s.seed, s.cv, CASE (c_custkey * s.seed) % 7 % 3 WHEN 0 THEN 'ALG' WHEN 1 THEN 'NVB' ELSE 'SGZ' END AS class FROM customer, (VALUES " + ", ".join(f"({s}, {c})" for s, c in SEEDS.items()) + ") s(seed, cv))"


@query(f"WITH {VOTES_SQL}, k AS (SELECT id, class, count(*) AS votes, max(cv) AS cv FROM v GROUP BY id, class) SELECT id, class, votes, 5 AS total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, cv DESC) AS rn FROM k) WHERE rn = 1")
def seed_vote(spark, sf_dir):  # A22 D21 S15
    k = F.col("c_custkey")
    m = k * F.col("seed") % 7 % 3
    v = views.read(spark, sf_dir, "customer").select(k.alias("id"), "c_custkey", F.explode(F.array(*map(F.lit, SEEDS))).alias("seed")).select("id", "seed", F.when(m == 0, "ALG").when(m == 1, "NVB").otherwise("SGZ").alias("class"))
    return mt.majority_vote(v, SEEDS, "id")


ZONED_SQL = f"WITH {BOTH_SQL}, {SIZE_SQL}, zo AS (SELECT *, (r // 10) * 10 + c // 10 AS zone FROM g)"


def zoned(spark, sf_dir, placed: bool = False) -> DataFrame:
    return views.both_grids(spark, sf_dir, placed).withColumn("zone", F.floor(F.col("r") / 10) * 10 + F.floor(F.col("c") / 10))


def _skew(v: str) -> str:
    return f"(avg({v} ** 3) - 3 * avg({v}) * avg({v} ** 2) + 2 * avg({v}) ** 3) / stddev_pop({v}) ** 3"


@query(f"{ZONED_SQL} SELECT zone, count(*) AS n_cells, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_std, round({_skew('z')}, 4) AS z_skew, round(avg(k), 6) AS k_mean, round(stddev_pop(k), 6) AS k_std, round({_skew('k')}, 4) AS k_skew FROM zo GROUP BY zone")
def zone_statistics(spark, sf_dir):  # A17 A18
    return rounded(rounded(zn.zonal_stats(zoned(spark, sf_dir), "zone", ["z", "k"]), "z_mean", "z_std", "k_mean", "k_std"), "z_skew", "k_skew", digits=4)


@query(f"{ZONED_SQL}, m AS (SELECT zone, avg(z) AS a FROM zo GROUP BY zone) SELECT zone, round(a, 6) AS zone_mean, CAST(row_number() OVER (ORDER BY a, zone) - 1 AS INT) AS rank FROM m")
def zone_order(spark, sf_dir):  # R11
    return rounded(zn.relabel_by_mean(zoned(spark, sf_dir, placed=True), "zone", "z", order=["_file", "_row"]), "zone_mean")


@query("WITH k AS (SELECT c_nationkey AS zone, c_mktsegment AS class, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY zone) AS t, row_number() OVER (PARTITION BY zone ORDER BY n DESC, class) AS rn FROM k) SELECT zone, class AS dominant, round(n / t, 6) AS share, CAST(t AS BIGINT) AS n_rows FROM t WHERE rn = 1")
def dominant_classes(spark, sf_dir):  # A19 J14
    rows = views.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("class"))
    return rounded(zn.dominant_class(rows, "zone", "class"), "share")


EDGES = [-20.0, -12.0, -8.0, -5.0, 0.0]


@query(f"{FRAME_SQL}, d AS (SELECT CAST(bathymetry >= -12 AS INT) + CAST(bathymetry >= -8 AS INT) + CAST(bathymetry >= -5 AS INT) AS zone, class FROM f WHERE bathymetry IS NOT NULL), k AS (SELECT zone, class, count(*) AS n FROM d GROUP BY 1, 2) SELECT zone, class, n, round(n / sum(n) OVER (PARTITION BY zone), 6) AS share FROM k")
def depth_zone_purity(spark, sf_dir):  # A20 J11
    rows = frame(spark, sf_dir).where("bathymetry is not null").withColumn("zone", zn.depth_zone(F.col("bathymetry"), EDGES))
    return rounded(zn.purity(rows, "zone", "class"), "share")


NEAR_SQL = "near AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a, p b {where}), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM near)"


@query(f"{TABLES}, {NEAR_SQL.format(where='')} SELECT id, other, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def nearest_points(spark, sf_dir):  # J12 J13
    _, _, points = _points(spark, sf_dir)
    return rounded(zn.nearest(points, points, 5, 4.0), "d")


@query(f"""{TABLES}, {NEAR_SQL.format(where='')}, {PROB_SQL}, m AS (SELECT ranked.id, avg(no.a) AS ma, avg(no.b) AS mb, avg(no.c) AS mc FROM ranked JOIN no ON no.id = ranked.other WHERE rank <= 5 GROUP BY 1),
s AS (SELECT id, greatest(0.8 * a + 0.2 * ma, 1e-9) AS a, greatest(0.8 * b + 0.2 * mb, 1e-9) AS b, greatest(0.8 * c + 0.2 * mc, 1e-9) AS c FROM no JOIN m USING (id))
SELECT id, round(a / (a + b + c), 6) AS "prob_ALG", round(b / (a + b + c), 6) AS "prob_NVB", round(c / (a + b + c), 6) AS "prob_SGZ" FROM s""")
def smoothed_probabilities(spark, sf_dir):  # M15
    _, _, points = _points(spark, sf_dir)
    cols = [f"prob_{c}" for c in CLASSES]
    rows = points.select("id", "x", "y").join(probabilities(spark, sf_dir).select("id", *cols), "id")
    return rounded(zn.smooth_probabilities(rows, cols, 5, 4.0).select("id", *cols), *cols)


@query(f"""{TABLES}, {NEAR_SQL.format(where="WHERE a.c_acctbal < 0 AND b.c_acctbal >= 0")}, w AS (SELECT ranked.id, p.class, sum(CASE WHEN ex THEN CAST(d = 0 AS INT) ELSE 1 / d END) AS w FROM (SELECT *, bool_or(d = 0) OVER (PARTITION BY id) AS ex FROM ranked WHERE rank <= 5) ranked JOIN p ON p.id = ranked.other GROUP BY 1, 2)
SELECT id, class AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, class) AS rn FROM w) WHERE rn = 1""")
def nearest_vote(spark, sf_dir):  # J13
    _, _, points = _points(spark, sf_dir)
    return zn.vote_nearest(points.where("c_acctbal < 0"), points.where("c_acctbal >= 0"), "class", 5, 4.0)


@query(f"{TABLES}, {NEAR_SQL.format(where='WHERE a.id <> b.id')}, z AS (SELECT id, c_acctbal - (SELECT avg(c_acctbal) FROM p) AS z FROM p), l AS (SELECT ranked.id, avg(z.z) AS lag FROM ranked JOIN z ON z.id = ranked.other WHERE rank <= 8 GROUP BY 1) SELECT round(sum(z * lag) / sum(z * z), 6) AS morans_i FROM z JOIN l USING (id)")
def morans_i(spark, sf_dir):  # A24
    _, _, points = _points(spark, sf_dir)
    return rounded(zn.morans_i(points, "c_acctbal", 8, 4.0), "morans_i")


@query(f"{TABLES}, i AS (SELECT r, c FROM g WHERE abs(z + 10) < 0.5), k AS (SELECT id, floor(-y) AS pr, floor(x) AS pc FROM p, n WHERE floor(-y) < nr AND floor(x) < nc) SELECT id, round(min(sqrt((pr - r) ** 2 + (pc - c) ** 2)), 6) AS distance FROM k, i GROUP BY id")
def isobath_distances(spark, sf_dir):  # O-F29 P14
    cells, s, points = _points(spark, sf_dir)
    here = located(points, s).where((F.col("r") < s.rows) & (F.col("c") < s.cols))
    whole = ds.distance_transform(cells, s, F.abs(F.col("z") + 10) < 0.5)
    return rounded(here.join(whole, ["r", "c"]).select("id", "distance"), "distance")


@query(f"WITH {GRID_SQL}, {SIZE_SQL}, i AS (SELECT r, c FROM g WHERE abs(z + 10) < 0.1) SELECT g.r, g.c, round(5 * sqrt(min((g.r - i.r) ** 2 + (g.c - i.c) ** 2)), 6) AS distance FROM g, i GROUP BY g.r, g.c")
def isobath_raster(spark, sf_dir):  # O-F29
    cells = views.depth_grid(spark, sf_dir)
    s = views.shape(cells)
    return rounded(ds.distance_transform(cells, Shape(s.rows, s.cols, 5.0), F.abs(F.col("z") + 10) < 0.1), "distance")


@query(f"""{TABLES}, k AS (SELECT id, CAST(floor(-y) AS INT) AS pr, CAST(floor(x) AS INT) AS pc FROM p, n WHERE floor(-y) < nr AND floor(x) < nc),
v AS (SELECT id, r, c, k AS v FROM (SELECT id, pr, pc FROM k) kk JOIN g ON r BETWEEN pr - 3 AND pr + 3 AND c BETWEEN pc - 3 AND pc + 3),
m AS (SELECT id, median(v) AS med, min(v) AS lo, max(v) AS hi FROM v GROUP BY id),
q AS (SELECT id, r, c, CASE WHEN hi = lo THEN 0 ELSE CAST(floor((coalesce(v, med) - lo) / (hi - lo) * 31) AS INT) END AS q FROM v JOIN m USING (id) WHERE med IS NOT NULL),
d AS (SELECT a.id, o.ang, a.q AS i, b.q AS j FROM q a CROSS JOIN (VALUES (0, 0, 1), (45, -1, 1), (90, 1, 0), (135, 1, 1)) o(ang, dr, dc) JOIN q b ON b.id = a.id AND b.r = a.r + o.dr AND b.c = a.c + o.dc),
y AS (SELECT id, ang, i, j FROM d UNION ALL SELECT id, ang, j, i FROM d), n2 AS (SELECT id, ang, i, j, count(*)::DOUBLE AS n FROM y GROUP BY ALL),
a AS (SELECT id, ang, sum(n) AS t, sum(n * (i - j) ** 2) / sum(n) AS con, sum(n * abs(i - j)) / sum(n) AS dis, sum(n / (1 + (i - j) ** 2)) / sum(n) AS hom, sqrt(sum(n * n)) / sum(n) AS ene, sum(n * i * i) / sum(n) - (sum(n * i) / sum(n)) ** 2 AS var, sum(n * i * j) / sum(n) - (sum(n * i) / sum(n)) ** 2 AS cov FROM n2 GROUP BY 1, 2)
SELECT id, round(avg(con), 5) AS contrast, round(avg(dis), 6) AS dissimilarity, round(avg(hom), 6) AS homogeneity, round(avg(ene), 6) AS energy, round(avg(CASE WHEN var < 1e-15 THEN 1 ELSE cov / var END), 5) AS correlation FROM a GROUP BY id""")
def grey_texture(spark, sf_dir):  # O-F14 O-F28
    cells, s, points = _points(spark, sf_dir)
    return rounded(rounded(tx.glcm(located(points, s), cells, s, 3, value="k"), "dissimilarity", "homogeneity", "energy"), "contrast", "correlation", digits=5)


@query(f"""{TABLES}, k AS (SELECT id, CAST(floor(-y) AS INT) AS pr, CAST(floor(x) AS INT) AS pc FROM p, n WHERE floor(-y) < nr AND floor(x) < nc)
SELECT id, count(g.k) AS n, round(max(g.k) - min(g.k), 6) AS range, round(quantile_cont(g.k, 0.75) - quantile_cont(g.k, 0.25), 6) AS iqr, round((avg(g.k) - median(g.k)) / (stddev_pop(g.k) + 1e-8), 5) AS skew_proxy
FROM (SELECT id, pr, pc FROM k) kk JOIN g ON r BETWEEN pr - 2 AND pr + 2 AND c BETWEEN pc - 2 AND pc + 2 GROUP BY id""")
def patch_statistics(spark, sf_dir):  # O-F27 O-F30
    cells, s, points = _points(spark, sf_dir)
    return rounded(rounded(tx.patch_stats(located(points, s), cells, s, 2, "k"), "range", "iqr"), "skew_proxy", digits=5)


@query("""WITH m AS (SELECT s_suppkey AS ord, s_suppkey * 7 % 23 AS x, s_suppkey * 5 % 19 AS y, s_nationkey AS class FROM supplier),
gr AS (SELECT *, dense_rank() OVER (ORDER BY x) - 1 AS gx, dense_rank() OVER (ORDER BY y) - 1 AS gy FROM m),
ci AS (SELECT class, row_number() OVER (ORDER BY min(ord)) - 1 AS cls FROM m GROUP BY class),
b AS (SELECT max(gx) AS w, max(gy) AS h FROM gr), o AS (SELECT y.v AS dy, x.v AS dx FROM (SELECT unnest(range(-1, 2)) AS v) y, (SELECT unnest(range(-1, 2)) AS v) x),
pt AS (SELECT gy + dy AS gy, gx + dx AS gx, cls, ord FROM gr JOIN ci USING (class), o)
SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST(arg_min(cls, ord) AS SMALLINT) AS cls FROM pt, b WHERE gy BETWEEN 0 AND h AND gx BETWEEN 0 AND w GROUP BY pt.gy, pt.gx""")
def painted_masks(spark, sf_dir):  # M19 R1 A28 D19
    k = F.col("s_suppkey")
    pts = views.read(spark, sf_dir, "supplier").select(k.alias("ord"), (k * 7 % 23).alias("x"), (k * 5 % 19).alias("y"), F.col("s_nationkey").alias("class"))
    return rc.paint_masks(pts, "class", "ord", 3)


@query("""WITH s AS (SELECT c_custkey + CASE WHEN c_custkey % 50 = 3 THEN 1 ELSE 0 END AS id, CASE WHEN c_custkey % 97 = 5 THEN 'NONE' ELSE c_mktsegment END AS class FROM customer)
SELECT 'duplicate' AS problem, CAST(id AS VARCHAR) AS value FROM s GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'missing', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT id FROM s)
UNION ALL SELECT DISTINCT 'unexpected', CAST(id AS VARCHAR) FROM s WHERE id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT 'class', class FROM s WHERE class = 'NONE'""")
def submission_check(spark, sf_dir):  # P10 J10 U2
    c = views.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    sub = c.select((k + F.when(k % 50 == 3, 1).otherwise(0)).alias("ID"), F.when(k % 97 == 5, "NONE").otherwise(F.col("c_mktsegment")).alias("class"))
    return rc.submission_problems(sub, c.select(k.alias("ID")), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def runs(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return views.read(spark, sf_dir, "supplier").select(k.alias("ord"), F.col("s_name").alias("run_id"), (k % 7).cast("string").alias("config_ref"), (k % 3).alias("seed"), F.when(k % 2 == 0, "baseline").otherwise("candidate").alias("run_type"), (F.col("s_acctbal") / 10000).alias("metric_weighted_f1"))


RUNS_SQL = "u AS (SELECT s_suppkey AS ord, s_name AS run_id, CAST(s_suppkey % 7 AS VARCHAR) AS config_ref, s_suppkey % 3 AS seed, CASE WHEN s_suppkey % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run_type, s_acctbal / 10000 AS f FROM supplier)"


@query(f"""WITH {RUNS_SQL}, o AS (SELECT a.ord, min(b.ord) AS other FROM u a LEFT JOIN u b ON a.config_ref = b.config_ref AND a.seed = b.seed AND a.run_type = b.run_type AND a.ord <> b.ord GROUP BY a.ord)
SELECT u.run_id, u.ord, o.other, round(abs(u.f - v.f), 6) AS drift, CASE WHEN o.other IS NULL THEN 'no_lineage' ELSE 'evaluated' END AS status, abs(u.f - v.f) <= 0.01 + 1e-12 AS within FROM u JOIN o USING (ord) LEFT JOIN u v ON v.ord = o.other""")
def run_lineage(spark, sf_dir):  # J16 M29
    return rounded(rc.lineage(runs(spark, sf_dir)), "drift")


@query(f"WITH {RUNS_SQL} SELECT run_id, round(f, 6) AS f1 FROM u WHERE run_type = 'baseline' ORDER BY ord DESC LIMIT 1")
def latest_baseline(spark, sf_dir):  # J17 T-4
    return rc.latest_baseline(runs(spark, sf_dir)).select("run_id", F.round("metric_weighted_f1", 6).alias("f1"))


@query(f"""WITH {RUNS_SQL}, b AS (SELECT a.ord, max(e.ord) AS o FROM u a JOIN u e ON e.config_ref = a.config_ref AND e.run_type = 'baseline' AND e.ord < a.ord WHERE a.run_type <> 'baseline' GROUP BY a.ord)
SELECT a.run_id, a.ord, e.run_id AS baseline, e.ord AS baseline_ord, round(a.f - e.f, 6) AS rise FROM u a LEFT JOIN b ON b.ord = a.ord LEFT JOIN u e ON e.ord = b.o WHERE a.run_type <> 'baseline'""")
def earlier_baselines(spark, sf_dir):  # J17
    return rounded(rc.earlier_baselines(runs(spark, sf_dir), ["config_ref"]), "rise")


@query(f"""{BASE}, zo AS (SELECT *, (r // 10) * 10 + c // 10 AS zone FROM g), {ring3('clamp')},
s AS (SELECT r, c, {AREA} AS area FROM ring),
e AS (SELECT zo.*, area, NOT (r > 0 AND r < nr - 1 AND c > 0 AND c < nc - 1 AND r % 10 BETWEEN 1 AND 8 AND c % 10 BETWEEN 1 AND 8) AS edge FROM zo JOIN s USING (r, c), n),
f AS (SELECT zone, count(*) AS n_cells, sum(area) AS sa, covar_pop(c, c) FILTER (edge) AS xx, covar_pop(-r, -r) FILTER (edge) AS yy, covar_pop(c, -r) FILTER (edge) AS xy, covar_pop(c, z) FILTER (edge) AS xz, covar_pop(-r, z) FILTER (edge) AS yz FROM e GROUP BY zone),
p AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM f)
SELECT CAST(zone AS BIGINT) AS zone, n_cells, round(sa / (n_cells * sqrt(1 + a * a + b * b)), 6) AS rugosity, round(degrees(atan(sqrt(a * a + b * b))), 5) AS plane_slope,
  round(CASE WHEN atan2(-a, -b) < 0 THEN degrees(atan2(-a, -b)) + 360 ELSE degrees(atan2(-a, -b)) END, 4) AS plane_aspect FROM p""")
def plane_rugosity(spark, sf_dir):  # L7
    cells = zoned(spark, sf_dir).drop("k")
    out = rg.plane_rugosity(cells, views.shape(cells), "zone")
    return rounded(rounded(rounded(out, "rugosity"), "plane_slope", digits=5), "plane_aspect", digits=4)


REGIONS_SQL = f"""WITH RECURSIVE {GRID_SQL}, {SIZE_SQL}, d AS (SELECT r * nc + c AS id, r, c, z < -9 AS deep FROM g, n),
h AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON b.r = a.r AND b.c = a.c + 1 AND b.deep = a.deep UNION ALL SELECT a.id, b.id FROM d a JOIN d b ON b.c = a.c AND b.r = a.r + 1 AND b.deep = a.deep),
k AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
w(id, region) USING KEY (id) AS (SELECT id, id FROM d UNION SELECT k.a, min(w.region) FROM w JOIN k ON k.b = w.id JOIN recurring.w AS old ON old.id = k.a WHERE w.region < old.region GROUP BY k.a)"""


@query(f"{REGIONS_SQL} SELECT r, c, CAST(region AS BIGINT) AS region FROM d JOIN w USING (id)")
def connected_regions(spark, sf_dir):  # M27
    cells = views.depth_grid(spark, sf_dir).withColumn("deep", F.col("z") < -9)
    return rg.connected(cells, views.shape(cells), "deep").select("r", "c", "region")


@query(f"""{REGIONS_SQL},
m AS (SELECT r, c, region FROM d JOIN w USING (id)),
q AS (SELECT region, r + dr AS y, c + dc AS x, count(*) AS n, sum(dr) AS sr, sum(dc) AS sc FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc) GROUP BY ALL),
e AS (SELECT region, count(*) FILTER (n = 1) AS q1, count(*) FILTER (n = 3) AS q3, count(*) FILTER (n = 2 AND sr = 1 AND sc = 1) AS qd FROM q GROUP BY region),
s AS (SELECT m.region, count(*) AS cells, count(f.r) + count(b.r) AS beside FROM m LEFT JOIN m f ON f.r = m.r AND f.c = m.c + 1 AND f.region = m.region LEFT JOIN m b ON b.r = m.r + 1 AND b.c = m.c AND b.region = m.region GROUP BY m.region)
SELECT CAST(region AS BIGINT) AS fid, CAST(cells AS DOUBLE) AS area, CAST(2 - (q1 - q3 + 2 * qd) // 4 AS BIGINT) AS n_rings, CAST(q1 + q3 + 2 * qd AS BIGINT) AS n_vertices, CAST(4 * cells - 2 * beside AS DOUBLE) AS length FROM e JOIN s USING (region)""")
def region_outlines(spark, sf_dir):  # M27 K16
    cells = views.depth_grid(spark, sf_dir).withColumn("deep", F.col("z") < -9)
    return ol.outlines(cells, views.shape(cells), "deep").drop("rings")
