"""The life of a run by its commands, the benchmark and the stack; configuration, saved models, registry order."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid import cli
from shoalgrid.operators import frames as fr
from shoalgrid.operators import learning as ln
from shoalgrid.operators import records as rc
from shoalgrid.runs import config as cf
from shoalgrid.runs import lifecycle, segmentation
from shoalgrid.sources import rasters, tables

META = "# Points\n\nA made table.\n\ntitle: Points\nsource: made\nlicense: CC0\n"
CONFIG = "model_type: rf\nbrought_prefixes: [terrain_, own_]\ncv: {n_splits: 3, fold_scheme: spatial_blocked}\nfeature_flags: {include_eco_features: false}\nmodel_params: {trees: 8, depth: 4}\n"


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    r, c = np.mgrid[0:40, 0:40]
    z = (-30 + r * 0.5 + c * 0.1).astype("float32")
    for name, a in (("bathy", z), ("back", z * 0.5 + 10)):
        (at / f"{name}.tif").write_bytes(rasters.encode_tiff(a.astype("float32"), rasters.Meta(1.0, 0.0, -1.0, 40.0, -9999, 40, 40)))
    rng = np.random.default_rng(3)
    rows = [(k + 1, *(rng.uniform(1, 39, 2).round(2))) for k in range(90)]
    kind = lambda y: "SGAM" if y > 26 else "ALG" if y > 13 else "NVB"
    (at / "train.csv").write_text("ID,x,y,terrain_q,class\n" + "".join(f"{i},{x},{y},{x * 0.1:.3f},{kind(y)}\n" for i, x, y in rows))
    (at / "test.csv").write_text("ID,x,y,terrain_q\n" + "".join(f"{i + 500},{x},{y},{x * 0.1:.3f}\n" for i, x, y in rows[:20]))
    (at / "sample.csv").write_text("ID,class\n" + "".join(f"{i + 500},ALG\n" for i, _, _ in rows[:20]))
    (at / "METADATA.MD").write_text(META)
    (at / "run.yaml").write_text(CONFIG)
    (at / "seg.yaml").write_text(f"input: {{train_csv: '{at}/train.csv', test_csv: '{at}/test.csv'}}\noutput: {{base_dir: '{at}/seg'}}\nsplit: {{val_fraction: 0.3, random_state: 1}}\nweights: {{cap: 4.0}}\nmodel_params: {{trees: 8}}\n")
    return at


def test_a_run_from_training_to_submission(spark, data, capsys):
    home = f"{data}/home"
    rasters_ = ["--bathymetry-tif", f"{data}/bathy.tif", "--backscatter-tif", f"{data}/back.tif"]
    go = lambda *a: cli.main([*a], spark)
    train = ["train", "--train-csv", f"{data}/train.csv", *rasters_, "--config", f"{data}/run.yaml", "--home", home]
    assert go(*train) == 0 and go(*train, "--run-type", "candidate", "--seed", "7", "--quiet") == 0
    base, run = [x for x in capsys.readouterr().out.split() if x.startswith(("baseline-", "candidate-"))]
    runs = tables.read_runs(spark, f"{home}/registry").orderBy("ord").collect()
    assert [(r["run_id"], r["ord"]) for r in runs] == [(base, 1), (run, 2)] and runs[0]["metric_weighted_f1"] > 0.5
    assert json.loads(Path(f"{home}/runs/{run}/class_vocab.json").read_text()) == ["ALG", "NVB", "SGAM"]
    code = go("evaluate", "--run-id", run, "--home", home)
    told = json.loads(Path(f"{home}/reports/metrics/{run}_metrics.json").read_text())
    assert told["comparison"]["baseline_run_id"] == base and code == (1 if told["comparison"]["degraded"] else 0)
    assert Path(f"{home}/reports/reproducibility/{run}_reproducibility.md").exists()
    assert [x.split(",")[0] for x in Path(f"{home}/reports/metrics/{run}_per_class.csv").read_text().split()] == ["class", "ALG", "NVB", "SGAM"]
    assert go("evaluate", "--run-id", run, "--fold-scheme", "stratified_random", "--home", home) == 1
    assert go("predict", "--run-id", "none", "--test-csv", f"{data}/test.csv", *rasters_, "--home", home) == 1
    assert go("predict", "--run-id", base, "--test-csv", f"{data}/test.csv", *rasters_, "--home", home) == 0
    path = f"{home}/predictions/{base}_test_predictions"
    assert spark.read.csv(path, header=True).count() == 20
    submit = ["make-submission", "--sample-submission", f"{data}/sample.csv", "--output", f"{data}/sub", "--home", home, "--predictions"]
    assert go(*submit, path) == 0 and go(*submit, f"{data}/test.csv") == 1
    assert go("train", "--train-csv", f"{data}/train.csv", "--bathymetry-tif", "/elsewhere/b.tif", "--backscatter-tif", f"{data}/back.tif", "--config", f"{data}/run.yaml", "--home", home) == 1


def test_benchmark_and_stack(spark, data):
    at = segmentation.benchmark(spark, f"{data}/seg.yaml")
    told = json.loads(Path(f"{at}/candidate_metrics.json").read_text())
    assert [r["candidate_type"] for r in told["candidates"]] == list(segmentation.CANDIDATES)
    assert all(r["status"] == "success" for r in told["candidates"]), told
    best = max(told["candidates"], key=lambda r: r["weighted_f1"])
    assert told["candidates"][[r["candidate_type"] for r in told["candidates"]].index(told["recommended_candidate"])]["weighted_f1"] == best["weighted_f1"]
    got = segmentation.hybrid_stack(spark, "none", at.rsplit("/", 1)[1], f"{data}/train.csv", f"{data}/test.csv", f"{data}/seg", f"{data}/home2", params={"trees": 8})
    out = spark.read.csv(got["predictions"], header=True, inferSchema=True)
    assert out.count() == 20 and out.columns == ["ID", "class"]
    decision = json.loads(Path(f"{data}/home2/runs/{got['run_id']}/promotion_decision.json").read_text())
    assert decision["gate_passed"] == got["gate_passed"]
    if not got["gate_passed"]:
        kept = spark.read.csv(f"{at}/test_location_predictions", header=True, inferSchema=True)
        assert {(r["ID"], r["class"]) for r in out.collect()} == {(r["location_id"], r["predicted_class"]) for r in kept.collect()}
    with pytest.raises(ValueError):
        segmentation.checked_metrics({"candidates": [{"status": "x"}]})
    assert cli.main(["segmentation-build-masks", "--train-csv", f"{data}/train.csv", "--output-dir", f"{data}/masks"], spark) == 0
    assert json.loads(Path(f"{data}/masks/mask_metadata.json").read_text())["window_size"] == 5


def test_classify_command(spark, data):
    head = "Class,Zone,a,b,c,d,e,f,g,h\n"
    (data / "d.csv").write_text(head + "1,Low,,-25,,,,,,\n2,Rest,-25,,,,,,,\n")
    (data / "n.csv").write_text(head + "1,Never,9999,,,,,,,\n")
    b = f"{data}/bathy.tif"
    go = lambda d: cli.main(["classify", "--broad-std", b, "--fine-std", b, "--slope", b, "--bathy", b, "--classdict", d, "--output", f"{data}/class.tif"], spark)
    assert go(f"{data}/n.csv") == 4 and go(f"{data}/train.csv") == 3 and go(f"{data}/d.csv") == 0
    got = rasters.decode_tiff(Path(f"{data}/class.tif").read_bytes())[0]
    assert set(np.unique(got)) == {1, 2}


def test_configuration_and_data_files():
    c = cf.parse_config(CONFIG)
    assert c.spec("baseline", 3).kind == "random_forest" and c.spec("baseline", 3).params["trees"] == 8 and c.n_splits == 3
    assert cf.parse_config("").spec("candidate", 1).kind == "boosted"
    for bad in ("model_type: odd", "- a list", "cv: {fold_scheme: other}", "feature_flags: {unknown: true}"):
        with pytest.raises(ValueError):
            cf.parse_config(bad)
    assert cf.allowed_data("/d/a.csv", "/d") and cf.allowed_data("/d/MBES/a.tif", "/d")
    for bad in ("/d/a.exe", "/d/other/a.csv", "/e/a.csv", "/d/../e/a.csv", "/d/MBES/x/a.tif"):
        with pytest.raises(ValueError):
            cf.allowed_data(bad, "/d")
    assert len(cf.config_hash("x")) == 12


def test_saved_models_predict_the_same(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k % 10), float(k % 7), "ab"[k % 10 > 4]) for k in range(80)], "ID long, u double, v double, class string")
    for kind in ("random_forest", "boosted", "forest_mlp"):
        m = ln.train(df, "class", ["u", "v"], ln.Spec(kind, {"trees": 4, "rounds": 3, "hidden": (3,)}))
        m.save(f"{tmp_path}/{kind}")
        again = ln.Fitted.load(spark, f"{tmp_path}/{kind}")
        one, two = (sorted((r["ID"], r["predicted_class"], round(r["confidence"], 9)) for r in x.predict(df).collect()) for x in (m, again))
        assert one == two


def test_networks_heed_class_weights(spark):
    df = spark.createDataFrame([(k, 1.0, "a" if k < 10 else "b") for k in range(100)], "ID long, u double, class string")
    told = ln.train(df, "class", ["u"], ln.Spec("mlp", {"hidden": (2,), "rounds": 40, "held": 0.0})).predict(df).first()
    assert told["prob_a"] == pytest.approx(0.5, abs=0.02)  # without weights it would be 0.1


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(0, 100, 1, 7).where("id % 3 <> 0").withColumnRenamed("id", "k")
    assert sorted(r["ID"] for r in tables.numbered(df, "ID").collect()) == list(range(1, 67))
    assert tables.numbered(df.limit(0), "ID").count() == 0


def test_registry_order_is_that_of_registration(spark, tmp_path):
    assert tables.read_runs(spark, f"{tmp_path}/none").count() == 0
    for k in range(4):
        tables.append_run(spark, f"{tmp_path}/runs", {"run_id": f"r{3 - k}", "run_type": "baseline", "metric_weighted_f1": 0.5})
    runs = tables.read_runs(spark, f"{tmp_path}/runs")
    assert [r["run_id"] for r in runs.orderBy("ord").collect()] == ["r3", "r2", "r1", "r0"]
    assert rc.latest_baseline(runs).first()["run_id"] == "r0" and rc.latest_baseline(runs, before=2).first()["run_id"] == "r3"


def test_shuffled_columns_keep_their_values(spark):
    df = spark.createDataFrame([(k, k if k % 9 else None, k * 2) for k in range(200)], "ID long, v long, w long")
    got = ln.shuffled(df, "v", 3, block=40).orderBy("ID").collect()
    key = lambda x: (x is None, x)
    assert sorted((r["v"] for r in got), key=key) == sorted((k if k % 9 else None for k in range(200)), key=key)
    assert sum(r["v"] == (r["ID"] if r["ID"] % 9 else None) for r in got) < 20 and all(r["w"] == 2 * r["ID"] for r in got)


def test_dense_indices_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    xs = rng.choice([0.5, 1.25, 7, 1000, 1000.5, -3], 60).tolist() + rng.normal(size=100).tolist()
    df = spark.createDataFrame([(k, x, -x) for k, x in enumerate(xs)], "id long, x double, y double")
    rank = {v: k for k, v in enumerate(sorted(set(xs)))}
    for r in rc.grid_indices(df).collect():
        assert r["gx"] == rank[r["x"]] and r["gy"] == len(rank) - 1 - rank[r["x"]]


def test_bands_fall_back_to_all_points(spark):
    pts = spark.createDataFrame([(k, k % 4) for k in range(40)] + [(99, 9)], "id long, zone long")
    zones = spark.createDataFrame([(1,), (9,), (None,)], "zone long")
    n = {r["for_zone"]: r["count"] for r in fr.in_band(pts, zones, least=20).groupBy("for_zone").count().collect()}
    assert n == {1: 30, 9: 41}
