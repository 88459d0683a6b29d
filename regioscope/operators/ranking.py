"""Exact ranking statistics over distributed positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.functions.rsem import safe_div
from regioscope.operators.composite import value_positions


def auroc(df: DataFrame, by: str, score: str = "score", label: str = "y") -> DataFrame:
    """``(by, n, positives, auroc)``: the area under the ROC curve of every
    group, exactly.

    It is the rank-sum statistic: with mid-ranks for ties,
    ``(R+ - P (P + 1) / 2) / (P N)``.  Equal scores of a group are one row
    before anything is sorted, and ranks come from range partitions with
    offsets, so neither a hot group nor a hot score is one task's work.  A
    group of one class has NULL; rows without a score or label do not count.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    is_one = (F.col(label) > 0.5).cast("long")
    pos = value_positions(rows.select(by, F.col(score).cast("double").alias("_s"), is_one.alias("_y")), by, "_s",
                          extra=[F.sum("_y").alias("_p")])
    mid = F.col("before") + (F.col("n") + 1) / 2
    g = pos.groupBy(by).agg(F.sum("n").alias("n"), F.sum("_p").alias("positives"),
                            F.sum(F.col("_p") * mid).alias("_r"))
    p, m = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return g.select(by, "n", "positives", safe_div(F.col("_r") - p * (p + 1) / 2, p * m).alias("auroc"))
