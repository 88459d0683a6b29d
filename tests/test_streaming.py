"""Incremental snapshot ingestion: reruns pick up only new files."""

from regioscope.streaming import snapshots as ST


def test_rerun_counts_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "0519_a.csv").write_text("k,v\nx,1.0\nx,3.0\ny,\n")
    schema = "k string, v double"
    ST.ingest_snapshots(spark, str(src), schema, ["k"], "v", out, ck)
    (src / "0620_b.csv").write_text("k,v\nx,5.0\n")
    ST.ingest_snapshots(spark, str(src), schema, ["k"], "v", out, ck)   # only the new file
    ST.ingest_snapshots(spark, str(src), schema, ["k"], "v", out, ck)   # nothing new
    got = sorted((str(r["period"]), r["k"], r["mean_value"], r["n"])
                 for r in ST.rollup(spark, out, ["k"]).collect())
    assert got == [("2019-05-01", "x", 2.0, 2), ("2019-05-01", "y", None, 1),
                   ("2020-06-01", "x", 5.0, 1)]


def test_files_of_one_month_add_up(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for name, value in (("0519_a.csv", 5.0), ("0519_b.csv", 3.0)):
        (src / name).write_text(f"k,v\nx,{value}\n")
        ST.ingest_snapshots(spark, str(src), "k string, v double", ["k"], "v", out, ck)
    row, = ST.rollup(spark, out, ["k"]).collect()
    assert (str(row["period"]), row["mean_value"], row["n"]) == ("2019-05-01", 4.0, 2)


def test_a_retried_batch_counts_once(spark, tmp_path):
    """Losing the commit of a batch makes the stream run it again."""
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), tmp_path / "ck"
    src.mkdir()
    (src / "0519_a.csv").write_text("k,v\nx,5.0\n")
    args = (["k"], "v", out, str(ck))
    ST.ingest_snapshots(spark, str(src), "k string, v double", *args)
    for f in (ck / "commits").iterdir():
        f.unlink()
    ST.ingest_snapshots(spark, str(src), "k string, v double", *args)
    row, = ST.rollup(spark, out, ["k"]).collect()
    assert (row["mean_value"], row["n"]) == (5.0, 1)
