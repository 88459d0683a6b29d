"""Aggregation, window, sampling and join operators on literal fixtures."""

from pyspark.sql import functions as F

from regioscope.operators import aggregates as A
from regioscope.operators import joins as J
from regioscope.operators import sampling as S
from regioscope.operators import windows as W


def test_top_n_keeps_ties(spark):
    rows = [(i, float(100 - i)) for i in range(29)] + [(29, 10.0), (30, 10.0), (31, 5.0)]
    df = spark.createDataFrame(rows, "k int, w double")
    got = W.top_n_with_ties(df, 30, "w")
    assert got.count() == 31


def test_base_index_and_share(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0), ("b", 2, 2.0),
                                (None, 1, 5.0), (None, 2, 10.0)], "k string, t int, x double")
    r = {(x["k"], x["t"]): x["index"] for x in W.base_index(df, "x", ["k"], "t").collect()}
    assert r[("a", 2)] == 150.0 and r[("b", 2)] == 50.0 and r[(None, 2)] == 200.0
    s = {(x["k"], x["t"]): x["percentage"] for x in W.share_within(df, "x", ["k"]).collect()}
    assert s[("a", 1)] == 0.4


def test_sample_exact_and_partition_independent(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 3).cast("int"))
    a = S.sample_first_k(df, 777, ["id"], seed=7)
    b = S.sample_first_k(df.repartition(13), 777, ["id"], seed=7)
    ids_a = {r[0] for r in a.select("id").collect()}
    assert len(ids_a) == 777
    assert ids_a == {r[0] for r in b.select("id").collect()}
    # brute force: the 777 smallest hashes
    import hashlib
    hs = sorted(range(5000), key=lambda i: hashlib.md5(f"{i}|7".encode()).hexdigest())
    assert ids_a == set(hs[:777])
    per_g = S.sample_first_k(df, 100, ["id"], seed=7, by=["g"])
    assert sorted(r[1] for r in per_g.groupBy("g").count().collect()) == [100, 100, 100]


def test_downsample_balances(spark):
    df = spark.range(0, 3000).withColumn("y", (F.col("id") % 4 == 0).cast("double"))
    bal = S.downsample(df, "y", ["id"], seed=1)
    c = {r["y"]: r["count"] for r in bal.groupBy("y").count().collect()}
    assert c[1.0] == 750 and c[0.0] == 750


def test_hash_split_is_a_partition(spark):
    df = spark.range(0, 4000)
    tr, te = S.hash_split(df, [0.75, 0.25], ["id"], seed=123)
    a, b = {r[0] for r in tr.collect()}, {r[0] for r in te.collect()}
    assert not a & b and len(a | b) == 4000 and 2800 < len(a) < 3200


def test_null_safe_and_natural_join(spark):
    l = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "id int, k string, v string")
    r = spark.createDataFrame([(None, 10), ("b", 20)], "k string, w int")
    out = {x["id"]: x["w"] for x in J.natural_join(l, r).collect()}
    assert out == {1: 10, 2: 20}
    plain = {x["id"]: x["w"] for x in J.join_keys(l, r, ["k"], "left").collect()}
    assert plain == {1: None, 2: 20}


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 2.0, 4.0), (1.0, 3.0, 6.5)], "c double, a double, b double")
    r = {(x["var1"], x["var2"]): x["corr"] for x in A.correlation_long(df, ["c", "a", "b"]).collect()}
    assert r[("c", "a")] is None and abs(r[("a", "a")] - 1) < 1e-12 and r[("a", "b")] > 0.99


def test_profile_quartiles_type7(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    p = A.profile(df, ["x"]).first()
    assert p["q1"] == 1.75 and p["median"] == 2.5 and p["q3"] == 3.25 and p["n_missing"] == 1


def test_salted_join_equals_plain_join(spark):
    big = spark.range(0, 3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 7))
                                      .alias("k"), "id")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k long, v string")
    b = sorted(tuple(r) for r in big.join(small, "k").collect())
    for hot in (None, 500):            # all keys salted / only key 0 is hot
        a = sorted(tuple(r) for r in J.salted_join(big, small, "k", salt_buckets=5,
                                                   hot_rows=hot).collect())
        assert a == b
    left = J.salted_join(big, small.where("k > 0"), "k", "left", salt_buckets=5, hot_rows=500)
    assert left.count() == 3000


def test_spatial_join_salted_path(spark):
    from regioscope.functions import geo as G
    from regioscope.operators import spatial as SP
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0},
             {"x": 0.0, "y": 2.0}, {"x": 0.0, "y": 0.0}]]
    polys = spark.createDataFrame([(1, ring)], "poly_id int, rings " + G.RINGS_TYPE.simpleString())
    pts = spark.range(0, 200).select("id", (F.col("id") % 30 / 10.0).alias("lon"),
                                     F.lit(1.0).alias("lat"))
    a = SP.spatial_join(pts, polys, cell=0.5, max_broadcast_rows=1, hot_cell_rows=5)
    b = SP.spatial_join(pts, polys, cell=0.5)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_base_index_null_first_value(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0)], "k string, t int, x double")
    r = {x["t"]: x["index"] for x in W.base_index(df, "x", ["k"], "t").collect()}
    assert r == {1: None, 2: None}


def test_rca_thresholds(spark):
    from regioscope.operators import complexity as C
    rows = [("r1", "p1", 10.0), ("r1", "p2", 30.0), ("r2", "p1", 30.0), ("r2", "p2", 1.0)]
    df = spark.createDataFrame(rows, "country string, product string, value double")
    kept = C.rca(df, min_product_total=35.0).select("product").distinct().collect()
    assert [r[0] for r in kept] == ["p1"]


def test_correlation_with_a_missing_value_is_missing(spark):
    rows = [(float(i), 2.0 * i, 1.0) for i in range(9)] + [(9.0, None, 1.0)]
    c = {(r["var1"], r["var2"]): r["corr"] for r in A.correlation_long(
        spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    assert c["x", "y"] is None and c["x", "z"] is None and abs(c["x", "x"] - 1) < 1e-12


def test_profile_quartiles_are_exact(spark):
    import numpy as np
    xs = [float(x) for x in np.random.default_rng(0).integers(0, 30, 501)]
    df = spark.createDataFrame([(x, None) for x in xs] + [(None, None)], "x double, y double")
    rows = {r["column"]: r for r in A.profile(df, ["x", "y"]).collect()}
    assert [rows["x"][q] for q in ("q1", "median", "q3")] == [float(v) for v in np.quantile(xs, [.25, .5, .75])]
    assert rows["x"]["n_missing"] == 1 and rows["y"]["n_missing"] == 502 and rows["y"]["q1"] is None


def test_sample_rejects_a_repeated_boundary_key(spark):
    import pytest
    from regioscope.operators import sampling as S
    df = spark.range(20).select(F.lit("same").alias("k"))
    with pytest.raises(ValueError):
        S.sample_first_k(df, 7, ["k"]).count()


def test_rca_counts_negative_cells_in_the_margins(spark):
    from regioscope.operators import complexity as C
    df = spark.createDataFrame([("a", "p", 3.0), ("a", "q", -1.0), ("b", "p", 2.0), ("b", "q", 4.0), ("b", "r", None)],
                               "country string, product string, value double")
    got = {(r["region"], r["product"]): r["rca"] for r in C.rca(df).collect()}
    assert set(got) == {("a", "p"), ("a", "q"), ("b", "p"), ("b", "q")}
    assert abs(got["a", "p"] - (3 / 2) / (5 / 8)) < 1e-12
    assert ("a", "q") not in {(r["region"], r["product"]) for r in C.rca(df, drop_nonpositive=True).collect()}


def test_distance_to_a_missing_point_is_missing(spark):
    from regioscope.functions import geo as G
    df = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "lon double, lat double")
    got = [r[0] for r in df.select(G.haversine_m("lon", "lat", F.lit(2.0), F.lit(1.0))).collect()]
    assert got == [None, 0.0]


def test_salted_left_join_of_mostly_missing_keys(spark):
    rows = [(None, i) for i in range(500)] + [(1, i) for i in range(300)] + [(2, 0), (3, 0)]
    big = spark.createDataFrame(rows, "k long, v long")
    other = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "k long, t string")
    for hot in (10, 100_000, None):
        got = sorted(map(tuple, J.salted_join(big, other, "k", "left", hot_rows=hot).collect()), key=str)
        want = sorted(map(tuple, big.join(other, "k", "left").collect()), key=str)
        assert got == want
    assert J.salted_join(big, other, "k", hot_rows=10).count() == 301


def test_broadcast_is_bounded_by_bytes_too(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "s string")
    assert J.is_small(df) and not J.is_small(df, max_bytes=10_000) and not J.is_small(df, max_rows=49)


def test_global_rank_is_the_sorted_place(spark):
    from regioscope.operators import windows as W
    rows = [(i, float(i * 7 % 13)) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r["k"]: r["rank"] for r in W.global_rank(df, [F.desc_nulls_last("v"), F.asc("k")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    assert W.global_rank(df.limit(0), [F.asc("k")]).collect() == []


def test_downsample_with_repeated_keys_is_exact(spark):
    """Every key three times, two of them equal: the boundary key is cut,
    whichever number of rows is asked, and always in the same place."""
    import hashlib
    from regioscope.operators import sampling as S
    rows = [(k, c, 0.0) for k in range(40) for c in ("x", "x", "z")]
    for few in (3, 4, 5):
        df = spark.createDataFrame(rows + [(100 + i, "m", 1.0) for i in range(few)], "id long, c string, y double")
        got = S.downsample(df, "y", ["id"], seed=1)
        assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0.0: few, 1.0: few}
        again = S.downsample(df.repartition(7), "y", ["id"], seed=1)
        assert sorted(got.collect()) == sorted(again.collect())
        keys = sorted(range(40), key=lambda i: hashlib.md5(f"{i}|1".encode()).hexdigest())
        assert sorted(r["id"] for r in got.where("y = 0").collect()) == sorted((keys[0],) * 3 + (keys[1],) * (few - 3))


def test_sample_takes_a_repeated_boundary_key_that_fits(spark):
    from regioscope.operators import sampling as S
    df = spark.range(10).select((F.col("id") % 5).alias("k"))
    got = [r["k"] for r in S.sample_first_k(df, 4, ["k"]).collect()]
    assert len(got) == 4 and len(set(got)) == 2
