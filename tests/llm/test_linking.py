import random

import brute
from pyspark.sql import functions as F

from regioscope.llm.linking import bucket_links, connected_components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000 + i, 1001 + i) for i in range(70)]  # a long path
    links += [(2000, 2000 + rng.randrange(1, 200)) for _ in range(100)]  # a star
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {n: c for n, c in brute.components(
        {x for p in links for x in p}, links).items() if n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bucket_links_connect_what_all_pairs_would(spark):
    """Members link where their ids differ by 1 or 10: a bucket's leader
    links with few of them."""
    rng = random.Random(2)
    members = sorted({(rng.randrange(12), rng.randrange(400)) for _ in range(600)} | {(99, i) for i in range(0, 400, 3)})
    asked = []

    def confirm(pairs):
        asked.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs.where((F.col("b") - F.col("a")).isin(1, 9, 10))

    found = bucket_links(spark.createDataFrame(members, "bucket long, id long"), confirm)
    ids = {i for _, i in members}
    want = [(a, b) for x, a in members for y, b in members if x == y and b - a in (1, 9, 10)]
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert set(got) <= set(want)
    assert brute.components(ids, got) == brute.components(ids, want)
    assert not asked[0] & asked[1]
