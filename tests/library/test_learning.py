"""Models, kriging, neighbours, features and records on small frames."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoalgrid.operators import features as ft
from shoalgrid.operators import kriging, learning, metrics, records, zonal


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(240):
        x, y = rng.uniform(0, 100, 2)
        a = "ALG" if x < 50 else "NVB"
        rows.append((k, float(x), float(y), float(x + rng.normal(0, 5)) if k % 11 else None, float(rng.normal()), a))
    return spark.createDataFrame(rows, "ID long, x double, y double, depth double, noise double, class string").cache()


@pytest.mark.parametrize("kind", ["random_forest", "logistic", "boosted", "forest_mlp"])
def test_models_learn_the_rule(frame, kind):
    spec = learning.Spec(kind, {"trees": 20, "rounds": 20, "hidden": (8,)})
    m = learning.train(frame, "class", ["depth", "noise"], spec)
    told = m.predict(frame.drop("noise"))
    assert metrics.summary(told, "class", "predicted_class").first()["weighted_f1"] > 0.85
    assert told.where(F.abs(F.col("prob_ALG") + F.col("prob_NVB") - 1) > 1e-6).count() == 0
    with pytest.raises(ValueError):
        learning.train(frame, "class", ["depth"], learning.Spec("other"))


def test_cross_validation_and_importance(frame):
    folds = ft.spatial_folds(frame, 3)
    spec = learning.Spec("logistic", {"rounds": 20})
    told = learning.cross_validate(folds, "class", columns=["depth", "noise"], spec=spec)
    assert told.count() == 240 and metrics.fold_summary(told, "class", "predicted_class").first()["pooled_f1"] > 0.85
    m = learning.train(frame, "class", ["depth", "noise"], spec)
    first = learning.permutation_importance(m, frame, "class", 1).orderBy("rank").first()
    assert first["feature_name"] == "depth" and first["selected"]


def test_zones_groups_and_oversampling(frame):
    z = learning.kmeans_zones(frame, ["x", "y"], 4, seeds=2)
    assert z.select("zone").distinct().count() == 4
    g = learning.spatial_groups(frame, 6, 3)
    assert g.groupBy("group").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    few = frame.where("class = 'ALG' or ID % 5 = 0")
    n = {r["class"]: r["count"] for r in learning.oversample(few, "class", ["x", "y"]).groupBy("class").count().collect()}
    assert n["ALG"] == n["NVB"]


def test_zones_of_a_raster_with_one_very_common_value(spark):
    first = spark.range(100).select(F.col("id").cast("double").alias("v")).orderBy(F.xxhash64("v")).first()["v"]  # the first in the hash order
    others = [v for v in (0.0, 33.0, 66.0, 99.0) if abs(v - first) > 10][:3]
    df = spark.range(53_000).select(F.element_at(F.array(*map(F.lit, [*others, first])), F.least(F.floor(F.col("id") / 1000), F.lit(3)).cast("int") + 1).alias("v"))
    z = learning.kmeans_zones(df, ["v"], 4, seeds=3)
    assert z.groupBy("v").agg(F.countDistinct("zone").alias("n")).where("n = 1").count() == 4 and z.select("zone").distinct().count() == 4


@pytest.mark.parametrize("block", [16, 1024])
def test_neighbours_of_a_class_match_brute_force(spark, block):
    v = np.random.default_rng(4).normal(size=(70, 3)).round(1)
    c = ["a" if i % 3 else "b" for i in range(70)]
    df = spark.createDataFrame([(c[i], i, [float(z) for z in v[i]]) for i in range(70)], "c string, _k long, _v array<double>")
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy("c").orderBy("_k")).cast("long") - 1)
    got = {(r["c"], r["_k"], r["_r"]): r["_o"] for r in learning.class_neighbours(df, "c", 5, block).collect()}
    want = {}
    for name in "ab":
        x = v[[k for k in range(70) if c[k] == name]]
        for i in range(len(x)):
            order = sorted((((x[i, 0] - y[0]) ** 2 + (x[i, 1] - y[1]) ** 2 + (x[i, 2] - y[2]) ** 2), j) for j, y in enumerate(x) if j != i)
            want |= {(name, i, r + 1): j for r, (_, j) in enumerate(order[:5])}
    assert got == want


def test_oversampled_rows_stay_inside_their_cluster(spark):
    rows = [(k, float(k % 10 * 1000 + k // 10 % 8), 1.0, "small") for k in range(80)] + [(1000 + k, 0.0, 0.0, "large") for k in range(300)] + [(5000, 3.0, 4.0, "one")]
    out = learning.oversample(spark.createDataFrame(rows, "ID long, x double, y double, c string"), "c", ["x", "y"]).collect()
    assert {c: sum(r["c"] == c for r in out) for c in ("small", "large", "one")} == {"small": 300, "large": 300, "one": 300}
    assert all(r["x"] % 1000 <= 7 for r in out if r["c"] == "small")  # ten clusters 1000 apart, eight rows each


def test_kriging_reproduces_and_interpolates(spark):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 10, (2, 80))
    v = np.sin(x / 3) + y / 10
    assert np.allclose(kriging.solve(x, y, v, x[:5], y[:5]), v[:5], atol=0.05)
    tx, ty = rng.uniform(2, 8, (2, 30))
    assert np.abs(kriging.solve(x, y, v, tx, ty) - (np.sin(tx / 3) + ty / 10)).mean() < 0.1
    assert kriging.solve(x, y, np.ones(80), tx, ty).tolist() == [1.0] * 30
    pts = spark.createDataFrame([(k, float(a), float(b), float(c), "A" if a < 5 else "B", int(a > 5)) for k, (a, b, c) in enumerate(zip(x, y, v))], "id long, x double, y double, v double, class string, zone int")
    got = kriging.ordinary(pts, pts, "v", "zone", batch=16).join(pts, "id").select(F.avg(F.abs(F.col("estimate") - F.col("v")))).first()[0]
    assert got < 0.1
    p = kriging.indicator(pts, pts, "class", ["A", "B"])
    assert p.where(F.abs(F.col("prob_A") + F.col("prob_B") - 1) > 1e-9).count() == 0
    right = p.join(pts, "id").where((F.col("prob_A") > 0.5) == (F.col("class") == "A")).count()
    assert right > 70


def test_classes_of_few_points_get_their_share(spark):
    rows = [(k, float(k % 7), float(k // 7), "A" if k % 7 < 3 else "B", k % 2) for k in range(60)] + [(60 + k, k + 0.5, 2.5, "C", 0) for k in range(4)]
    pts = spark.createDataFrame(rows, "id long, x double, y double, class string, zone int")
    got = {r["id"]: r for r in kriging.indicator(pts, pts.where("id < 60"), "class", ["A", "B", "C"], "zone").collect()}
    plain = {r["id"]: r for r in kriging.indicator(pts, pts.where("id < 60"), "class", ["A", "B", "C"], "zone", fewest=0).collect()}
    n = sum(z == 0 for *_, z in rows)
    kriged = {r["id"]: r["estimate"] for r in kriging.ordinary(pts.withColumn("c", (F.col("class") == "C").cast("double")), pts.where("id < 60"), "c", "zone").collect()}
    for k in range(60):
        share = 4 / n if k % 2 == 0 else 0.0
        p, q = got[k], plain[k]
        rest = q["prob_A"] + q["prob_B"]
        if q["prob_C"] > 1e-6:  # kriged C over its scaled value is what all three summed up to
            others = rest * min(max(kriged[k], 0.0), 1.0) / q["prob_C"]
            assert p["prob_C"] == pytest.approx(share / (share + others), abs=1e-6)
        assert p["prob_A"] / (p["prob_A"] + p["prob_B"]) == pytest.approx(q["prob_A"] / rest, abs=1e-9)
    assert {r["prob_C"] for r in got.values() if r["id"] % 2} == {0.0}


def test_kriging_in_bands_and_where_points_are_few(spark):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 10, (2, 90))
    zone = np.where(x < 4, 0, np.where(x < 9.5, 1, 4))
    pts = spark.createDataFrame([(k, float(a), float(b), float(a + b), "A" if a < 5 else "B", int(z)) for k, (a, b, z) in enumerate(zip(x, y, zone))], "id long, x double, y double, v double, class string, zone int")
    p = kriging.stratified_indicator(pts, pts, "class", ["A", "B"], "zone")
    assert p.count() == 90 and p.where(F.abs(F.col("prob_A") + F.col("prob_B") - 1) > 1e-9).count() == 0
    assert p.join(pts, "id").where((F.col("prob_A") > 0.5) == (F.col("class") == "A")).count() > 80
    few = int((zone == 4).sum())
    assert 0 < few < 10
    targets = spark.createDataFrame([(0, 2.0, 5.0, 0), (1, 7.0, 5.0, 1), (2, 9.8, 5.0, 4), (3, 2.0, 5.0, None), (4, None, None, 4)], "id long, x double, y double, zone int")
    got = {r["id"]: r["estimate"] for r in kriging.surface(pts, targets, "v", "zone", 2.0).collect()}
    near = lambda a, b: float(np.mean((x + y)[np.argsort(np.hypot(x - a, y - b))[:5]]))
    assert abs(got[0] - 7) < 0.5 and abs(got[1] - 12) < 0.5
    assert got[2] == pytest.approx(near(9.8, 5)) and got[3] == pytest.approx(near(2, 5)) and got[4] == pytest.approx(float(np.median(x + y)))


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 50, (60, 2)), np.vstack([rng.uniform(0, 50, (90, 2)), rng.uniform(900, 950, (2, 2))])
    left = spark.createDataFrame([(k, float(p[0]), float(p[1])) for k, p in enumerate(a)], "id long, x double, y double")
    right = spark.createDataFrame([(k, float(p[0]), float(p[1])) for k, p in enumerate(b)], "id long, x double, y double")
    got = {}
    for r in zonal.nearest(left, right, 3, 2.0).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    d = np.hypot(*(a[:, None, :] - b[None, :, :]).transpose(2, 0, 1))
    assert got == {k: np.argsort(d[k], kind="stable")[:3].tolist() for k in range(60)}


def test_nearest_reaches_distant_targets(spark):
    left = spark.createDataFrame([(k, float(k * 7), 0.0) for k in range(40)], "id int, x double, y double")
    one = spark.createDataFrame([(1, 0.0, 100.0)], "id int, x double, y double")
    got = {r["id"]: r["d"] for r in zonal.nearest(left, one, 1, 4.0).collect()}
    assert got == {k: pytest.approx(((k * 7) ** 2 + 100**2) ** 0.5) for k in range(40)}


def test_eco_model_round_trip(spark):
    df = spark.createDataFrame([(-float(k), float(k % 7), float(k % 5), "SGAM" if k < 8 else "NVB") for k in range(40)], "bathymetry double, terrain_fine_bpi double, terrain_slope double, class string")
    m = ft.EcoModel.fit(df, "class")
    assert m.transform(df).select("terrain_depth_zone").distinct().count() == 4
    assert ft.EcoModel.from_dict(m.to_dict()) == m and m.sgam_depth_min == -7
    with pytest.raises(ValueError):
        ft.EcoModel.from_dict({})


def test_engineering_flags_and_missing(spark):
    df = spark.createDataFrame([(10.0, 3.0), (None, 4.0), (15.0, float("nan")), (8.0, float("inf"))], "bathymetry double, backscatter double")
    out = ft.engineer(df)
    assert out.where("bathymetry is null or backscatter is null or isnan(backscatter)").count() == 0
    assert "bathymetry_z" not in ft.engineer(df, flags=ft.Flags(include_spatial_z_scores=False)).columns
    assert ft.correlation_filter(df.selectExpr("bathymetry a", "bathymetry * 2 b", "backscatter c").na.fill(0), ["a", "b", "c"]) == ["b", "c"]


def test_votes_masks_submissions_and_gates(spark, tmp_path):
    seeds = {42: 0.79, 123: 0.81, 456: 0.76, 789: 0.78, 2026: 0.80}
    v = spark.createDataFrame([(1, s, c) for s, c in zip(seeds, ["NVB", "NVB", "ALG", "NVB", "ALG"])] + [(2, s, c) for s, c in zip(seeds, ["A", "B", "A", "B", "C"])], "ID long, seed int, class string")
    got = {r["ID"]: (r["class"], r["votes"], r["total"]) for r in metrics.majority_vote(v, seeds).collect()}
    assert got == {1: ("NVB", 3, 5), 2: ("B", 2, 5)}
    pts = spark.createDataFrame([(0, 0.0, 0.0, "A"), (1, 1.0, 0.0, "B"), (2, 9.0, 5.0, "A")], "o long, x double, y double, class string")
    mask = {(r["gy"], r["gx"]): r["cls"] for r in records.paint_masks(pts, "class", "o", 3).collect()}
    assert mask[0, 1] == 0 and mask[0, 2] == 1
    with pytest.raises(ValueError):
        records.paint_masks(pts, "class", "o", 4)
    due = spark.createDataFrame([(1,), (2,)], "ID long")
    good = spark.createDataFrame([(1, "ALG"), (2, "NVB")], "ID long, class string")
    records.write_submission(good, due, ["ALG", "NVB"], f"{tmp_path}/s")
    assert spark.read.csv(f"{tmp_path}/s", header=True).columns == ["ID", "class"]
    with pytest.raises(ValueError):
        records.write_submission(good.union(good), due, ["ALG", "NVB"], f"{tmp_path}/t")
    assert metrics.degraded(0.8, 0.79) and not metrics.degraded(0.8, 0.796)
    assert metrics.promote(0.5, 0.53, 0.4, 0.4) and not metrics.promote(0.5, 0.51, 0.4, 0.5)
