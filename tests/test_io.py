"""Sources and sinks: multi-path pruned reads, folder keys, dynamic
partition overwrite, GeoJSON FeatureCollections."""

from pyspark.sql import functions as F

from regioscope.sources import io as IO


def test_many_files_pruned_with_folder_key(spark, tmp_path):
    for snap, rows in (("0519", ["01,a,1.0", "09,b,2.0"]), ("0620", ["09,c,3.0"])):
        d = tmp_path / f"snap={snap}"
        d.mkdir()
        (d / "part.csv").write_text("cve,name,v\n" + "\n".join(rows) + "\n")
    paths = [str(tmp_path / "snap=0519"), str(tmp_path / "snap=0620")]
    df = IO.read_csv(spark, paths, "cve string, name string, v double", columns=["cve", "v"],
                     with_path=True)
    df = IO.with_period_from_path(df, component=-2)
    got = sorted((r["cve"], str(r["period"]), r["v"]) for r in df.collect())
    assert got == [("01", "2019-05-01", 1.0), ("09", "2019-05-01", 2.0), ("09", "2020-06-01", 3.0)]
    assert "name" not in df.columns


def test_dynamic_partition_overwrite_keeps_other_periods(spark, tmp_path):
    out = str(tmp_path / "out")
    a = spark.createDataFrame([("2019", 1), ("2020", 2)], "period string, n int")
    IO.write_parquet(a, out, partition_by=["period"])
    b = spark.createDataFrame([("2020", 5)], "period string, n int")
    IO.write_parquet(b, out, partition_by=["period"])
    got = sorted((r["period"], r["n"]) for r in IO.read_parquet(spark, out).collect())
    assert got == [("2019", 1), ("2020", 5)]


def test_feature_collection(spark, tmp_path):
    p = tmp_path / "layer.geojson"
    p.write_text('{"type": "FeatureCollection", "features": ['
                 '{"type": "Feature", "properties": {"CVE": "09", "NOM": "Centro"},'
                 ' "geometry": {"type": "Polygon", "coordinates": '
                 '[[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    df = IO.read_polygons(spark, str(p), ["CVE", "NOM"], collection=True)
    r = df.select("CVE", F.size(F.col("rings")[0]).alias("k")).first()
    assert r["CVE"] == "09" and r["k"] == 4
