"""Same answer under 1, 4 and 64 shuffle partitions (survey §5.4)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cohort_top30", "o4_sample_n", "m12_downsample",
                                  "x4_proximity_products", "c4_discrimination",
                                  "j7_points_in_polygons"])
def test_partition_count_does_not_change_results(spark, name):
    seen = set()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = E.queries()[name](spark, SF)
            seen.add(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1
