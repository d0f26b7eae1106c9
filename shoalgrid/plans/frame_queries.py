"""Queries over joins, splits, spreads and choices of frames, each beside its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shoalgrid.operators import features as ft
from shoalgrid.operators import frames as fr
from shoalgrid.operators import grid as g
from shoalgrid.operators import learning as ln
from shoalgrid.operators import metrics as mt
from shoalgrid.operators import regions as rg
from shoalgrid.operators import sampling as sp
from shoalgrid.operators import terrain as t
from shoalgrid.operators import tiles as tl
from shoalgrid.operators import zonal as zn
from shoalgrid.plans import views
from shoalgrid.plans.table_queries import CLASSES, FRAME_SQL, PER_SQL, PROB_SQL, RUNS_SQL, TABLES, TOLD_SQL, ZONED_SQL, _bins, _points, frame, probabilities, runs, told, zoned
from shoalgrid.plans.terrain_queries import BASE, around, offsets, ring3, rounded, vrm_sql
from shoalgrid.plans.views import BOTH_SQL, SIZE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT c_custkey AS \"ID\", c_mktsegment AS class, n_name AS nation, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def merged_features(spark, sf_dir):  # E15 J7 J8 T-2 U6: by key, repeated columns once
    c = views.read(spark, sf_dir, "customer")
    left = c.select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("class"))
    right = c.join(views.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    right = right.select(F.col("c_custkey").alias("ID"), F.lit("other").alias("class"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"))
    return fr.merge_features(left, right)


@query("SELECT c_custkey AS \"ID\", CASE WHEN c_custkey IN (SELECT s_suppkey * 3 FROM supplier) THEN 'val' ELSE 'train' END AS part FROM customer")
def split_parts(spark, sf_dir):  # J9 U4
    rows = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"))
    ids = views.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("location_id"))
    held, rest = fr.split_by_ids(rows, ids)
    return held.withColumn("part", F.lit("val")).unionByName(rest.withColumn("part", F.lit("train")))


@query("""WITH o AS (SELECT c_custkey AS id, c_mktsegment AS class, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(c_custkey, '-42')), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT id, class, k <= floor(n * 0.2 + 0.5) AS held, CAST((k - 1) % 5 AS INT) AS fold FROM o""")
def stratified_parts(spark, sf_dir):  # R8 R9
    rows = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class"))
    return ft.stratified_folds(fr.stratified_split(rows, "class", id_="id"), "class", id_="id")


@query("SELECT c_custkey AS id FROM customer ORDER BY md5(concat(c_custkey, '-7')), c_custkey LIMIT 100")
def sampled_rows(spark, sf_dir):  # T-7: the limit is the operator
    return fr.sample_rows(views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 100, 7, "id")


@query(f"{BASE} SELECT r, c, round(z, 6) AS z FROM g WHERE r % 20 = 0 AND c % 20 = 0")
def strided_cells(spark, sf_dir):  # T-8
    return rounded(fr.stride(views.depth_grid(spark, sf_dir), 20).select("r", "c", "z"), "z")


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey AS zone FROM customer WHERE c_nationkey <> 7 AND c_nationkey < 20), w AS (SELECT DISTINCT s_nationkey AS zone FROM supplier),
b AS (SELECT w.zone AS for_zone, p.id FROM w JOIN p ON abs(p.zone - w.zone) <= 1), k AS (SELECT for_zone, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(for_zone AS BIGINT) AS for_zone, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT * FROM b WHERE for_zone IN (SELECT for_zone FROM k WHERE n >= 20)
UNION ALL SELECT w.zone, p.id FROM w, p WHERE w.zone NOT IN (SELECT for_zone FROM k WHERE n >= 20)) GROUP BY 1""")
def zone_bands(spark, sf_dir):  # J15 M23: what serves each zone
    pts = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("zone")).where("zone <> 7 and zone < 20")
    wanted = views.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("zone"))
    return fr.in_band(pts, wanted).groupBy("for_zone").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""{BASE}, d AS (SELECT *, CAST(z >= -15 AS INT) + CAST(z >= -9 AS INT) + CAST(z >= -4 AS INT) AS depth_zone FROM g)
SELECT r, c, depth_zone, round(CASE depth_zone WHEN 0 THEN (z + 30) / (15 + 1e-8) WHEN 1 THEN (z + 15) / (6 + 1e-8) WHEN 2 THEN (z + 9) / (5 + 1e-8) ELSE (z + 4) / (4 + 1e-8) END, 6) AS depth_zone_frac FROM d""")
def zone_fractions(spark, sf_dir):  # E21
    out = fr.zone_fraction(views.depth_grid(spark, sf_dir), "z", [-30.0, -15.0, -9.0, -4.0, 0.0])
    return rounded(out.select("r", "c", "depth_zone", "depth_zone_frac"), "depth_zone_frac")


FINE_SQL = "SELECT r, c, avg(v) AS m, sqrt(greatest(avg(v * v) - avg(v) ** 2, 0)) AS s FROM {nb} GROUP BY r, c"


@query(f"""WITH {BOTH_SQL}, {SIZE_SQL}, {around(offsets(-1, 1), 'symmetric', name='z3')}, {around(offsets(-4, 4), 'symmetric', name='z9')}, {around(offsets(-1, 1), 'symmetric', 'k', name='k3')},
a AS ({FINE_SQL.format(nb='z3')}), b AS ({FINE_SQL.format(nb='z9')}), e AS ({FINE_SQL.format(nb='k3')})
SELECT g.r, g.c, round(g.z * g.k, 5) AS bathy_x_back, round((g.z - a.m) * g.k, 4) AS slope_x_back, round(b.s / (a.s + 1e-6), 5) AS bathy_roughness_ratio, round(a.s + e.s, 5) AS relief_index, round((g.z - b.m) / (abs(g.z - a.m) + 1), 6) AS tpi_ratio
FROM g JOIN a USING (r, c) JOIN b USING (r, c) JOIN e USING (r, c) WHERE g.z IS NOT NULL AND g.k IS NOT NULL""")
def texture_features(spark, sf_dir):  # E10 E11 P2
    cells = views.both_grids(spark, sf_dir)
    s = views.shape(cells)
    work = cells
    for n in (3, 9):
        work = t.box_moments(work, s, n).withColumn(f"tpi_{n}", F.col("z") - F.col("mean")).withColumnsRenamed({"std": f"z_std_{n}"}).drop("mean")
    work = t.box_moments(work, s, 3, "k").withColumnsRenamed({"std": "k_std_3"}).drop("mean")
    out = fr.scale_ratio(fr.texture_interactions(fr.valid_cells(work, ["z", "k"]), "z", "k", "tpi_3", "z_std_3", "z_std_9", "k_std_3"), "tpi_3", "tpi_9")
    out = rounded(out.select("r", "c", "bathy_x_back", "slope_x_back", "bathy_roughness_ratio", "relief_index", "tpi_ratio"), "tpi_ratio")
    return rounded(rounded(out, "bathy_x_back", "bathy_roughness_ratio", "relief_index", digits=5), "slope_x_back", digits=4)


@query(f"WITH {BOTH_SQL} SELECT r, c, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 6) AS z, round((k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()), 6) AS k, CAST(0 AS DOUBLE) AS flat FROM g")
def scaled_layers(spark, sf_dir):  # E20
    return rounded(fr.min_max(views.both_grids(spark, sf_dir).withColumn("flat", F.lit(3.0)), ["z", "k", "flat"]), "z", "k")


@query("SELECT CAST(row_number() OVER (ORDER BY class) - 1 AS INT) AS ord, class FROM (SELECT DISTINCT c_mktsegment AS class FROM customer)")
def class_vocabulary(spark, sf_dir):  # A26
    return fr.vocabulary(views.read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "class"), "class")


@query(f"{ZONED_SQL}, n2 AS (SELECT (r // 7) * 100 + c // 9 AS zone, count(*) AS n FROM g GROUP BY 1) SELECT count(*) AS zones, round(avg(n), 6) AS mean_cells, min(n) AS least, max(n) AS largest FROM n2")
def zone_size_spread(spark, sf_dir):  # A27
    cells = views.depth_grid(spark, sf_dir).withColumn("zone", F.floor(F.col("r") / 7) * 100 + F.floor(F.col("c") / 9))
    return rounded(fr.zone_sizes(cells, "zone"), "mean_cells")


@query(f"{ZONED_SQL}, n2 AS (SELECT (r // 7) * 100 + c // 9 AS zone, count(*) AS n FROM g GROUP BY 1) SELECT CAST(zone AS BIGINT) AS zone, n FROM n2 WHERE n * 4.0 > 100")
def large_zone_list(spark, sf_dir):  # P15
    cells = views.depth_grid(spark, sf_dir).withColumn("zone", F.floor(F.col("r") / 7) * 100 + F.floor(F.col("c") / 9))
    return zn.large_zones(cells, "zone", 2.0, 100.0)


@query("SELECT zone, id, bal FROM (SELECT c_nationkey AS zone, c_custkey AS id, c_acctbal AS bal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1")
def first_by_zone(spark, sf_dir):  # U5
    rows = views.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return fr.first_of_each(rows, "zone", "id")


@query(f"WITH {RUNS_SQL} SELECT config_ref, count(*) AS n, round(avg(f), 6) AS f_mean, round(stddev_pop(f), 6) AS f_std, round(min(f), 6) AS f_min, round(max(f), 6) AS f_max FROM u GROUP BY 1")
def seed_spread(spark, sf_dir):  # A23
    out = fr.spread(runs(spark, sf_dir).withColumnRenamed("metric_weighted_f1", "f"), "config_ref", ["f"])
    return rounded(out, "f_mean", "f_std", "f_min", "f_max")


@query(f"WITH {RUNS_SQL} SELECT run_id, round(f, 6) AS f FROM u ORDER BY f DESC, ord LIMIT 1")
def best_candidate(spark, sf_dir):  # T-1 T-9
    return fr.best_first(runs(spark, sf_dir), "metric_weighted_f1", "ord").select("run_id", F.round("metric_weighted_f1", 6).alias("f"))


RANK_SQL = "r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 <> 4 THEN s_suppkey * 37 % 23 END AS v FROM supplier)"


@query(f"""WITH {RANK_SQL} SELECT id, CAST(CASE WHEN v IS NULL THEN ((SELECT count(v) + 1 + count(*) FROM r)) / 2.0 ELSE rank() OVER (ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 END - 0.25 AS INT) AS rank FROM r""")
def importance_ranks(spark, sf_dir):  # R3 K15
    k = F.col("s_suppkey")
    rows = views.read(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 9 != 4, k * 37 % 23).alias("v"))
    return fr.descending_rank(rows, "v").select("id", "rank")


@query(f"WITH {RANK_SQL} SELECT id, v FROM r ORDER BY v DESC NULLS LAST, id LIMIT 10")
def top_importances(spark, sf_dir):  # R12 T-6: the limit is the operator
    k = F.col("s_suppkey")
    return fr.top_rows(views.read(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 9 != 4, k * 37 % 23).alias("v")), "v", 10, "id")


COLUMNS = ("c_acctbal", "u", "w")
CORR_SQL = """WITH f AS (SELECT c_acctbal, c_acctbal + c_custkey % 13 * 10 AS u, c_custkey * 71 % 101 AS w FROM customer),
k AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS ra, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS ru, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS rw FROM f),
m AS (SELECT corr(ra, ru) AS au, corr(ra, rw) AS aw, corr(ru, rw) AS uw FROM k)"""


def _correlated(spark, sf_dir):
    k = F.col("c_custkey")
    return views.read(spark, sf_dir, "customer").select("c_acctbal", (F.col("c_acctbal") + k % 13 * 10).alias("u"), (k * 71 % 101).alias("w"))


@query(f"{CORR_SQL} SELECT 'c_acctbal' AS a, 'u' AS b, round(au, 6) AS rho FROM m UNION ALL SELECT 'c_acctbal', 'w', round(aw, 6) FROM m UNION ALL SELECT 'u', 'w', round(uw, 6) FROM m")
def rank_correlations(spark, sf_dir):  # A21
    return rounded(fr.spearman(_correlated(spark, sf_dir), list(COLUMNS)), "rho")


@query(f"{CORR_SQL} SELECT CASE WHEN (SELECT var_samp(c_acctbal) FROM f) < (SELECT var_samp(u) FROM f) THEN 'u' ELSE 'c_acctbal' END AS kept FROM m WHERE au > 0.95 UNION ALL SELECT 'w' FROM m")
def kept_columns(spark, sf_dir):  # P13: of a pair that is alike, the one that varies less goes
    kept = ft.correlation_filter(_correlated(spark, sf_dir), list(COLUMNS), 0.95)
    return spark.createDataFrame([(c,) for c in kept], "kept string")


@query(f"WITH {RUNS_SQL}, b AS (SELECT a.run_id, a.f AS fa, c.f AS fb FROM u a JOIN u c ON c.ord = a.ord + 1) SELECT run_id, fa - fb > 0.005 AS degraded, fb - fa >= 0.02 AND (fb - fa) / 2 >= 0 AS promoted FROM b")
def gates(spark, sf_dir):  # P11 P12
    r = runs(spark, sf_dir)
    nxt = r.select((F.col("ord") - 1).alias("ord"), F.col("metric_weighted_f1").alias("fb"))
    both = r.join(nxt, "ord").withColumnRenamed("metric_weighted_f1", "fa")
    return both.select("run_id", mt.degraded(F.col("fa"), F.col("fb")).alias("degraded"), mt.promote(F.col("fa"), F.col("fb"), F.col("fa") / 2, F.col("fb") / 2).alias("promoted"))


@query(f"""WITH {PROB_SQL}, m AS (SELECT id, truth, 0.7 * a + 0.3 * b AS a, 0.7 * b + 0.3 * c AS b, 0.7 * c + 0.3 * a AS c FROM no)
SELECT id, round(a, 6) AS "prob_ALG", CASE WHEN a >= b AND a >= c THEN 'ALG' WHEN b >= c THEN 'NVB' ELSE 'SGZ' END AS predicted_class FROM m""")
def soft_vote(spark, sf_dir):  # E18 P16
    p = probabilities(spark, sf_dir)
    parts = p.select("id", *[F.col(f"prob_{c}").alias(f"l_{c}") for c in CLASSES], *[F.col(f"prob_{d}").alias(f"r_{c}") for c, d in zip(CLASSES, ("NVB", "SGZ", "ALG"))])
    out = mt.argmax(mt.blend(parts, [("l", 0.7), ("r", 0.3)], list(CLASSES)), {c: f"prob_{c}" for c in CLASSES})
    return rounded(out.select("id", "prob_ALG", "predicted_class"), "prob_ALG")


@query(f"{FRAME_SQL}, s AS (SELECT c_nationkey AS zone, avg(c_acctbal) AS bal FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), j AS (SELECT p.id, s.bal FROM p LEFT JOIN s ON s.zone = p.c_nationkey) SELECT id, round(coalesce(bal, (SELECT median(bal) FROM j)), 4) AS bal FROM j")
def zone_lookup(spark, sf_dir):  # J6
    _, _, pts = _points(spark, sf_dir)
    stats = views.read(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey")).agg(F.avg("c_acctbal").alias("bal"))
    return rounded(sp.lookup_with_median(pts.select("id", "c_nationkey"), stats, "c_nationkey", ["bal"]).select("id", "bal"), "bal", digits=4)


@query(f"{TABLES} SELECT id, round((SELECT count(*) FROM p) / ((SELECT count(DISTINCT class) FROM p) * n), 6) AS weight FROM p JOIN (SELECT class, count(*) AS n FROM p GROUP BY 1) USING (class)")
def balanced_weights(spark, sf_dir):  # A16
    _, _, pts = _points(spark, sf_dir)
    return rounded(ln.balanced(pts, "class").select("id", F.col("_w").alias("weight")), "weight")


@query("SELECT unnest(['c_nationkey', 'c_acctbal', 'bathymetry', 'backscatter']) AS name, 'model' AS kind UNION ALL SELECT unnest(['terrain_mean_3', 'terrain_mean_9', 'terrain_std_3', 'terrain_std_9']), 'scale'")
def column_names(spark, sf_dir):  # E7 E8
    f = frame(spark, sf_dir).join(_points(spark, sf_dir)[2].select("id", "c_nationkey", "c_acctbal"), "id")
    names = [(c, "model") for c in ft.model_columns(f, exclude_coords=True)] + [(c, "scale") for c in t.multiscale_columns(["mean", "std"], [3, 9])]
    return spark.createDataFrame(names, "name string, kind string")


@query(f"{FRAME_SQL} SELECT id, round(abs(bathymetry) * backscatter, 5) AS depth_x_back, round(x * backscatter, 4) AS slope_x_back, round(backscatter / (abs(bathymetry) + 1), 6) AS acoustic_hard, round(y * backscatter, 4) AS vrm_x_back, round(x * y, 4) AS slope_x_vrm, 0.0::DOUBLE AS absent FROM f")
def acoustic_products(spark, sf_dir):  # E9 E14
    out = fr.ensure_columns(sp.acoustic_interactions(frame(spark, sf_dir), "bathymetry", "backscatter", "x", "y"), ["absent"])
    out = out.select("id", "depth_x_back", "slope_x_back", "acoustic_hard", "vrm_x_back", "slope_x_vrm", "absent")
    return rounded(rounded(rounded(out, "acoustic_hard"), "depth_x_back", digits=5), "slope_x_back", "vrm_x_back", "slope_x_vrm", digits=4)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS v FROM orders")
def masked_values(spark, sf_dir):  # P1
    raw = F.when(F.col("o_orderkey") % 17 == 0, F.lit(-9999.0)).when(F.col("o_orderkey") % 34 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    return views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), g.from_nodata(raw, -9999.0).alias("v"))


GAUSS = "exp(-(dr * dr + dc * dc) / 2.0)"


@query(f"{BASE}, {around(offsets(-4, 4), 'symmetric')} SELECT r, c, round(sum(v * {GAUSS}) / sum({GAUSS}), 6) AS smooth FROM nb GROUP BY r, c")
def gaussian_smooth(spark, sf_dir):  # O-F15 O-F23: cut off at four deviations
    cells = views.depth_grid(spark, sf_dir)
    return rounded(tl.gaussian(cells, views.shape(cells), 1.0), "smooth")


@query(f"{BASE}, {around(offsets(-1, 1), 'symmetric')} SELECT g.r, g.c, round(CASE WHEN hi = lo THEN 0 ELSE (g.z - m) / (hi - lo) END, 6) AS mean_diff_range FROM g JOIN (SELECT r, c, avg(v) AS m, min(v) AS lo, max(v) AS hi FROM nb GROUP BY r, c) USING (r, c)")
def range_deviation(spark, sf_dir):  # L8
    cells = views.depth_grid(spark, sf_dir)
    return rounded(t.range_deviation(cells, views.shape(cells), 3).select("r", "c", "mean_diff_range"), "mean_diff_range")


@query(f"""{BASE}, {ring3('reflect')}, v3 AS ({vrm_sql(3, 'ring')}), v5 AS ({vrm_sql(5, 'ring')}), {around(offsets(-1, 1), 'symmetric', name='n3')}, {around(offsets(-2, 2), 'symmetric', name='n5')}
SELECT g.r, g.c, round(v3.vrm, 6) AS vrm_3, round(v5.vrm, 6) AS vrm_5, round(a.m, 6) AS mean_3, round(b.m, 6) AS mean_5 FROM g JOIN v3 USING (r, c) JOIN v5 USING (r, c) JOIN (SELECT r, c, avg(v) AS m FROM n3 GROUP BY 1, 2) a USING (r, c) JOIN (SELECT r, c, avg(v) AS m FROM n5 GROUP BY 1, 2) b USING (r, c)""")
def multiple_scales(spark, sf_dir):  # L11
    cells = views.depth_grid(spark, sf_dir)
    out = t.multiple_scales(cells, views.shape(cells), [3, 5], ["vrm", "mean"])
    return rounded(out.drop("z"), "vrm_3", "vrm_5", "mean_3", "mean_5")


def _folds() -> str:
    """The seeded permutation of the 16 blocks, as a table: blocks that all occur, as they do for an even spread of points."""
    order = np.random.default_rng(42).permutation(np.arange(16))
    return "(VALUES " + ", ".join(f"({int(b)}, {k % 5})" for k, b in enumerate(order)) + ") fo(block, fold)"


@query(f"""{TABLES}, e AS (SELECT {', '.join(f'quantile_cont({c}, {k / 4}) AS e{c}{k}' for c in 'xy' for k in (1, 2, 3))} FROM p)
SELECT CAST(fold AS INT) AS fold, count(*) AS n FROM (SELECT ({_bins('x')}) * 4 + {_bins('y')} AS block FROM p, e) JOIN {_folds()} USING (block) GROUP BY 1""")
def spatial_fold_sizes(spark, sf_dir):  # R6 R7
    _, _, pts = _points(spark, sf_dir)
    return ft.spatial_folds(pts).groupBy("fold").agg(F.count("*").alias("n"))


@query(f"WITH {TOLD_SQL}, {PER_SQL.format(by='')} SELECT class, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY class) AS INT) AS line FROM f")
def class_report(spark, sf_dir):  # T-3 K8: the lines of a report, by class
    report = mt.class_lines(told(spark, sf_dir), "truth", "pred")
    return rounded(report, "f1")


@query(f"{ZONED_SQL} SELECT count(*) AS annotated FROM zo WHERE k IS NOT NULL")
def annotated_cells(spark, sf_dir):  # P17
    return fr.valid_cells(zoned(spark, sf_dir), ["k"]).agg(F.count("*").alias("annotated"))


def _rounds_ctes(rounds: int, step: int, compactness: float) -> str:
    ctes = f"""WITH RECURSIVE {views.GRID_SQL}, m AS (SELECT min(z) AS lo, max(z) AS hi, max(c) // {step} + 1 AS across FROM g),
x AS (SELECT r, c, r / {step}.0 AS y, c / {step}.0 AS x, (z - lo) / (hi - lo) / {compactness} AS v FROM g, m),
s0 AS (SELECT r, c, y, x, v, CAST((r // {step}) * across + c // {step} AS BIGINT) AS segment FROM x, m)"""
    for k in range(rounds):
        ctes += f""",
c{k} AS (SELECT segment, avg(y) AS cy, avg(x) AS cx, avg(v) AS cv FROM s{k} GROUP BY segment),
n{k} AS (SELECT s.r, s.c, arg_min(k.segment, (s.y - cy) ** 2 + (s.x - cx) ** 2 + (s.v - cv) ** 2) AS best FROM s{k} AS s JOIN c{k} AS k ON abs(s.y - cy) <= 1 AND abs(s.x - cx) <= 1 GROUP BY ALL),
s{k + 1} AS (SELECT s.r, s.c, y, x, v, coalesce(best, segment) AS segment FROM s{k} AS s LEFT JOIN n{k} USING (r, c))"""
    return ctes


@query(f"{_rounds_ctes(2, 16, 0.1)}\nSELECT r, c, segment FROM s2")
def superpixel_segments(spark, sf_dir):  # M21
    cells = views.depth_grid(spark, sf_dir)
    return tl.superpixels(cells, views.shape(cells), ["z"], 16, 0.1, 2)


def _merged_sql(rounds: int, least: int) -> str:
    """``q{rounds}(id, region)`` after that many rounds, more than are needed, over ``d(id, r, c, v)``."""
    smallest = "{0}({1}, {2}) USING KEY ({1}) AS (SELECT {1}, {1} FROM {3} UNION SELECT {4}.a, min({0}.{2}) FROM {0} JOIN {4} ON {4}.b = {0}.{1} JOIN recurring.{0} AS old ON old.{1} = {4}.a WHERE {0}.{2} < old.{2} GROUP BY {4}.a)"
    ctes = f"""h AS (SELECT a.id AS a, b.id AS b, a.v = b.v AS same FROM d a JOIN d b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT a.id, b.id, a.v = b.v FROM d a JOIN d b ON b.c = a.c AND b.r = a.r + 1),
k AS (SELECT a, b, same FROM h UNION ALL SELECT b, a, same FROM h), ks AS (SELECT a, b FROM k WHERE same), {smallest.format('w', 'id', 'region', 'd', 'ks')}, q0 AS (SELECT id, region FROM w)"""
    for i in range(rounds):
        ctes += f""",
z{i} AS (SELECT region, count(*) AS n FROM q{i} GROUP BY region),
b{i} AS (SELECT x.region AS a, y.region AS b, count(*) AS n FROM k JOIN q{i} x ON x.id = k.a JOIN q{i} y ON y.id = k.b WHERE x.region <> y.region GROUP BY ALL),
l{i} AS (SELECT a, b.b FROM b{i} AS b JOIN z{i} ON region = a AND z{i}.n < {least} QUALIFY row_number() OVER (PARTITION BY a ORDER BY b.n DESC, b.b) = 1),
u{i} AS (SELECT a, b FROM l{i} UNION SELECT b, a FROM l{i}),
{smallest.format(f'j{i}', 'region', 'target', f'z{i}', f'u{i}')},
q{i + 1} AS (SELECT id, target AS region FROM q{i} JOIN j{i} USING (region))"""
    return ctes


@query(f"""{_rounds_ctes(2, 16, 0.1)}, {SIZE_SQL}, d AS (SELECT r * nc + c AS id, r, c, segment AS v FROM s2, n), {_merged_sql(6, 12)}
SELECT r, c, segment, CAST(region AS BIGINT) AS region FROM s2, n JOIN q6 ON id = r * nc + c""")
def whole_segments(spark, sf_dir):  # M21: every segment in one piece, small pieces taken up by the neighbour with the longest border
    cells = superpixel_segments(spark, sf_dir)
    return rg.merged(cells, views.shape(cells), "segment", 12)


#: Outlines made of nations: a bent quadrilateral with a square hole, around a place that the key gives.
SIDE, OUTLINE, HOLE = 9, [(-1, -1), (1, -0.75), (0.75, 1), (-0.5, 1.25), (-1, -1)], [(-0.25, -0.25), (0.25, -0.25), (0.25, 0.25), (-0.25, 0.25), (-0.25, -0.25)]


def _side_sql(corners: list) -> str:
    return " UNION ALL ".join(f"SELECT n_nationkey AS fid, mx + {SIDE} * {a} AS sx, my + {SIDE} * {b} AS sy, mx + {SIDE} * {c} AS tx, my + {SIDE} * {d} AS ty FROM m" for (a, b), (c, d) in zip(corners, corners[1:]))


@query(f"""WITH m AS (SELECT n_nationkey, n_nationkey * 29 % 110 AS mx, -(n_nationkey * 17 % 150) AS my FROM nation),
p AS (SELECT c_custkey AS id, c_custkey * 37 % 110 + 0.5 AS x, -(c_custkey * 53 % 155) - 0.5 AS y FROM customer),
s AS ({_side_sql(OUTLINE)} UNION ALL {_side_sql(HOLE)}),
h AS (SELECT id, fid FROM p JOIN s ON (sy > y) <> (ty > y) AND x < (tx - sx) * (y - sy) / (ty - sy) + sx GROUP BY id, fid HAVING count(*) % 2 = 1)
SELECT p.id, h.fid FROM p LEFT JOIN h USING (id)""")
def points_in_polygons(spark, sf_dir):  # J14
    key = F.col("n_nationkey")
    mx, my = key * 29 % 110, -(key * 17 % 150)
    ring = lambda corners: F.array(*[F.struct((mx + F.lit(SIDE * a)).cast("double").alias("x"), (my + F.lit(SIDE * b)).cast("double").alias("y")) for a, b in corners])
    polygons = views.read(spark, sf_dir, "nation").select(key.alias("fid"), F.array(ring(OUTLINE), ring(HOLE)).alias("rings"))
    return zn.within(views.points(spark, sf_dir, 150), polygons, 8.0)
