"""Commands end to end, with their exit codes; the registry as a stream."""

import numpy as np

from shoalgrid import cli
from shoalgrid.sources import rasters, tables
from shoalgrid.streaming import registry

HEAD = "Class,Zone,BroadBPI_Lower,BroadBPI_Upper,FineBPI_Lower,FineBPI_Upper,Slope_Lower,Slope_Upper,Depth_Lower,Depth_Upper\n"


def test_commands(spark, tmp_path):
    z = np.random.default_rng(1).normal(-20, 4, (14, 12)).astype("float32")
    src = tmp_path / "b.tif"
    src.write_bytes(rasters.encode_tiff(z, rasters.Meta(1.0, 0.0, -1.0, 14.0, -9999, 14, 12)))
    (tmp_path / "d.csv").write_text(HEAD + "1,Low,,-100,,,,,,\n2,Rest,-100,,,,,,,\n")
    (tmp_path / "n.csv").write_text(HEAD + "1,Never,9999,,,,,,,\n")
    (tmp_path / "p.csv").write_text("ID,x,y\n1,2.5,3.5\n2,99,99\n")
    go = lambda *a: cli.main(list(a), spark)
    base = ["--bathy", str(src), "--out", str(tmp_path / "o.tif")]
    assert go("slope", *base) == 0 and rasters.decode_tiff((tmp_path / "o.tif").read_bytes())[0].shape == z.shape
    assert go("bpi", *base, "--inner", "3", "--outer", "2") == 1 and go("bpi", "--inner", "1") == 1
    assert go("vrm", "--bathy", str(tmp_path / "no.tif"), "--out", "x.tif") == 2
    model = ["run-model", "--bathy", str(src), "--out", str(tmp_path / "m"), "--dictionary"]
    assert go(*model, str(tmp_path / "d.csv"), "--keep") == 0
    got = rasters.decode_tiff((tmp_path / "m_class.tif").read_bytes())[0]
    assert set(np.unique(got)) == {1, 2} and (tmp_path / "m_broad_bpi.tif").exists()
    assert go(*model, str(tmp_path / "p.csv")) == 3 and go(*model, str(tmp_path / "n.csv")) == 4
    out = ["export-features", "--bathy", str(src), "--out", str(tmp_path / "f"), "--points", str(tmp_path / "p.csv")]
    assert go(*out) == 0 and go(*out, "--x-col", "lon") == 3
    rows = spark.read.csv(str(tmp_path / "f"), header=True, inferSchema=True).orderBy("ID").collect()
    assert rows[0]["terrain_slope"] is not None and rows[1]["terrain_slope"] is None


def test_registry_stream(spark, tmp_path):
    for k in range(3):
        tables.append_run(spark, f"{tmp_path}/runs", {"run_id": f"r{k}", "run_type": "baseline", "metric_weighted_f1": 0.5 + k / 10})
    q = registry.best_by_type(registry.stream_runs(spark, f"{tmp_path}/runs")).writeStream.outputMode("complete").format("memory").queryName("best_runs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["best_run"], r["runs"]) for r in spark.sql("select * from best_runs").collect()] == [("r2", 3)]
