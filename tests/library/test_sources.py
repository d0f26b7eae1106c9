"""Dictionaries, TIFF files, registries and metadata."""

import io
import struct
import zipfile

import numpy as np
import pytest

from shoalgrid.sources import dictionaries as d
from shoalgrid.sources import geopackage, rasters, tables

HEAD = "Class,Zone,BroadBPI_Lower,BroadBPI_Upper,FineBPI_Lower,FineBPI_Upper,Slope_Lower,Slope_Upper,Depth_Lower,Depth_Upper\n"


def test_csv_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿" + HEAD + "1,Reef Crest,,-100,,-100,,,,\n2.0,Ridges,,-100,-100,100,,,,30,extra\n")
    got = d.read_dictionary(spark, str(tmp_path / "d.csv"))
    assert [e.code for e in got] == [1, 2] and got[0].broad_upper == -100 and got[0].broad_lower is None and got[1].depth_upper == 30
    for text in (HEAD, "a,b\n1,2\n", HEAD + "1,A,0,1\n", HEAD + "x,A,,,,,,,,\n"):
        with pytest.raises(d.DictionaryError):
            d.parse_csv(text.encode())
    with pytest.raises(TypeError):
        d.read_dictionary(spark, "x.txt")


def test_xml_dictionary():
    rec = lambda c: f"<ClassRec ID='1'><Class>{c}</Class><Zone>A</Zone><SSB_LowerBounds>-5</SSB_LowerBounds><LSB_UpperBounds> 7 </LSB_UpperBounds><Depth_LowerBounds/></ClassRec>"
    got = d.parse_xml(f"<ClassDict><Classifications>{rec(1)}{rec(2)}</Classifications></ClassDict>".encode())
    assert [(e.code, e.broad_lower, e.fine_upper, e.depth_lower) for e in got] == [(1, -5, 7, None), (2, -5, 7, None)]
    with pytest.raises(d.DictionaryError):
        d.parse_xml(b"<ClassDict><ClassRec><Zone>A</Zone></ClassRec></ClassDict>")


def test_xlsx_dictionary():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>3</v></c><c r="B2" t="s"><v>1</v></c><c r="D2"><v>-100</v></c><c r="J2"><v>9</v></c></row></sheetData></worksheet>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Class</t></si><si><t>Crest</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (e,) = d.parse_xlsx(b.getvalue())
    assert (e.code, e.name, e.broad_lower, e.broad_upper, e.depth_upper) == (3, "Crest", None, -100, 9)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("dtype", ["float32", "int32", "uint8"])
def test_tiff_round_trip(compress, dtype):
    a = (np.random.default_rng(0).normal(0, 40, (70, 90)) ** 2).astype(dtype)
    meta = rasters.Meta(0.5, 100.0, -0.5, 200.0, -9999 if dtype != "uint8" else 0, 70, 90)
    got, m = rasters.decode_tiff(rasters.encode_tiff(a, meta, compress))
    assert np.array_equal(a, got) and m == meta and m.cell == 0.5


def test_lzw_round_trip():
    for raw in (b"", b"a", b"ab" * 5000, bytes(np.random.default_rng(1).integers(0, 256, 30000, dtype=np.uint8))):
        assert rasters.lzw_decode(rasters.lzw_encode(raw)) == raw


def test_tiff_files_as_cells(spark, tmp_path):
    a = np.arange(12, dtype="float32").reshape(3, 4)
    a[1, 1] = -9999
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(a, rasters.Meta(nodata=-9999, rows=3, cols=4)))
    df = rasters.read_tiff(spark, str(tmp_path))
    got = {(r["r"], r["c"]): r["z"] for r in df.collect()}
    assert len(got) == 12 and got[1, 1] is None and got[2, 3] == 11
    meta = rasters.read_meta(spark, str(tmp_path / "a.tif"))
    back, _ = rasters.decode_tiff(rasters.to_tiff(df, "z", meta))
    assert np.array_equal(back, a)
    rasters.write_cells(df.drop("file"), f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").count() == 12


def test_registry_and_points(spark, tmp_path):
    for k in range(2):
        tables.append_run(spark, f"{tmp_path}/runs", {"run_id": f"r{k}", "run_type": "baseline", "seed": 1, "metric_weighted_f1": 0.5 + k, "metric_per_class_f1": {"ALG": 0.1}})
    runs = tables.read_runs(spark, f"{tmp_path}/runs")
    assert runs.count() == 2 and tables.find_run(runs, "r1").first()["metric_per_class_f1"] == {"ALG": 0.1}
    (tmp_path / "p.csv").write_text("lon,lat,note\n1,2,a\n3,4,b\n")
    p = tables.read_points(spark, str(tmp_path / "p.csv"), x="lon", y="lat")
    assert p.columns == ["x", "y", "note", "ID"] and p.agg({"x": "sum"}).first()[0] == 4
    with pytest.raises(ValueError):
        tables.read_points(spark, str(tmp_path / "p.csv"))
    (tmp_path / "q.csv").write_text("location_id,predicted_class,confidence,prob_A\n1,A,0.5,1.5\n")
    with pytest.raises(ValueError):
        tables.read_predictions(spark, str(tmp_path / "q.csv"))


def test_metadata():
    assert tables.parse_metadata("Title: T\nDescription: D\nSource: S\nLicense: L\nTitle: other")["title"] == "T"
    got = tables.parse_metadata("# Survey\n\n## Source\n- ship\n\n## License\nopen\n")
    assert got["title"] == got["description"] == "Survey" and got["source"] == "ship" and got["license"] == "open"
    with pytest.raises(ValueError):
        tables.parse_metadata("Title: T")


def test_geopackage_round_trip_and_points(spark, tmp_path):
    from shoalgrid.operators import zonal

    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    rows = [(1, [square(0.0, 0.0, 10.0), square(4.0, 4.0, 2.0)], "reef"), (2, [square(8.0, 8.0, 5.0)], None), (3, None, "no place"), (4, [], "empty")]
    held = spark.createDataFrame(rows, f"fid long, rings {geopackage.RINGS}, label string")
    (tmp_path / "a.gpkg").write_bytes(geopackage.to_geopackage(held, "my zones", ["label"]))
    got = {r["fid"]: r for r in geopackage.read_layer(spark, str(tmp_path / "a.gpkg"), "my zones").collect()}
    assert [[tuple(p) for p in ring] for ring in got[1]["rings"]] == rows[0][1] and got[1]["attributes"] == {"label": "reef"}
    assert got[2]["attributes"] == {} and got[3]["rings"] is None and got[4]["rings"] == [] and got[1]["layer"] == "my zones"
    with pytest.raises(Exception, match="no layer"):
        geopackage.read_layer(spark, str(tmp_path / "a.gpkg"), "other").collect()
    with pytest.raises(ValueError):
        geopackage.to_geopackage(held, "x", [], most=3)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 9.0), (4, 12.0, 12.0), (5, 50.0, 1.0), (6, None, 1.0)], "id long, x double, y double")
    polygons = geopackage.read_layer(spark, str(tmp_path / "a.gpkg"))
    for bucket in (1.0, 7.0, 100.0):
        found = sorted(tuple(r) for r in zonal.within(points, polygons, bucket).na.fill(-1).collect())
        assert found == [(1, 1), (2, -1), (3, 1), (3, 2), (4, 2), (5, -1), (6, -1)]
    multi = struct.pack("<BII", 1, 6, 2) + 2 * geopackage.encode_geometry([square(1.0, 1.0, 2.0)])[8:]
    assert len(geopackage.parse_geometry(b"GP" + struct.pack("<BBi", 0, 1, -1) + multi)) == 2


def test_cached_tables_and_zones(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(r, c, 1 if r < 12 else 2) for r in range(14) for c in range(10)], "r int, c int, zone int")

    first = tables.cached(spark, f"{tmp_path}/features", build)
    again = tables.cached(spark, f"{tmp_path}/features", build)
    assert built == [1] and first.count() == again.count() == 140
    tables.write_zones(again, "zone", f"{tmp_path}/zones")
    assert {(r["zone"], r["area"]) for r in spark.read.parquet(f"{tmp_path}/zones").collect()} == {(1, 120.0)}
