"""Links and connected groups of rows, as joins and partial aggregates.

Nothing here gathers a group in one task or on the driver, and no step
forms all pairs of a bucket: members are first compared with one leader per
bucket, and only members that are still in different groups meet again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.llm.scratch import discard, materialize

#: Buckets (16 bytes each) up to which their list is broadcast.
SMALL_BUCKETS = 500_000


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every row that some link (a, b) names; the
    component is the smallest id that links lead to.

    Each round a row takes the smallest label next to it, hands that label
    to the row it pointed to so far, and then follows its pointer once more;
    the number of rounds grows with the logarithm of the longest path.
    """
    pairs = links.select("a", "b").where("a != b")
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("near"))
                         .select(F.col("a").alias("id"), F.least("a", "near").alias("component")),
                         "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:  # labels only fall: no change in the sum, no change at all
            discard(both)
            return labels
        total = now
        near = (both.join(labels, both.b == labels.id).groupBy("a")
                .agg(F.min("component").alias("near")))
        told = labels.join(near, labels.id == near.a).select("id", "component", "near")
        said = (told.select("id", F.least("component", "near").alias("c"))
                .union(told.select(F.col("component").alias("id"), F.col("near").alias("c"))))
        step = said.groupBy("id").agg(F.min("c").alias("c"))
        on = step.select(F.col("id").alias("c"), F.col("c").alias("component"))
        before, labels = labels, materialize(step.join(on, "c").select("id", "component"), "labels")
        discard(before)


def bucket_links(members: DataFrame, confirm: Callable[[DataFrame], DataFrame],
                 near: Callable[[Column, Column], Column] | None = None,
                 signatures: DataFrame | None = None) -> DataFrame:
    """Confirmed links (a, b), a < b, that connect the rows sharing buckets
    as all confirmed links would.

    ``members`` has (bucket, id), each once; ``confirm`` takes distinct pairs
    (a, b) and returns those that hold.  Every pair of a bucket is compared,
    but for those that earlier links have put into one group already.  With
    ``signatures`` (id, sig), pairs whose values fail ``near`` are left out
    before ``confirm``, and before they are written.
    """
    crowded = materialize(members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("id").alias("lead"), F.max("id").alias("last")).where("n > 1"), "crowded")
    large = crowded.where("n > 2").select("bucket", "n")  # two members are their bucket's only pair
    if large.limit(SMALL_BUCKETS + 1).count() <= SMALL_BUCKETS:
        large = F.broadcast(large)
    members = materialize(members.join(large, "bucket"), "members")  # of the large ones
    # the member that meets most others leads, as most others are near it
    weight = members.groupBy("id").agg(F.sum("n").alias("w"))
    leads = members.join(weight, "id").groupBy("bucket").agg(
        F.min(F.struct(-F.col("w"), "id"))["id"].alias("lead"))
    led = members.join(leads, "bucket").where("lead != id")
    pairs = (crowded.where("n = 2").select(F.col("lead").alias("a"), F.col("last").alias("b"))
             .union(led.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")))).distinct()

    def likely(pairs: DataFrame) -> DataFrame:
        if signatures is None:
            return pairs
        x = signatures.select(F.col("id").alias("a"), F.col("sig").alias("x"))
        y = signatures.select(F.col("id").alias("b"), F.col("sig").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(near(F.col("x"), F.col("y"))).select("a", "b")

    tried = materialize(pairs, "tried")
    first = materialize(confirm(materialize(likely(tried), "likely")), "confirmed")
    groups = connected_components(first).withColumnRenamed("id", "node")
    placed = (members.join(groups, members.id == groups.node, "left")
              .select("bucket", "id", F.coalesce("component", "id").alias("grp")))
    if signatures is not None:
        placed = placed.join(signatures, "id").select("bucket", "id", "grp", "sig")
    placed = materialize(placed, "placed")
    discard(members, crowded)
    sizes = placed.groupBy("bucket", "grp").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("bucket").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"),
                                         F.count("*").alias("groups"))
             .where("groups > 1").select("bucket", "main"))
    open_ = materialize(placed.join(mixed, "bucket"), "open")
    # a pair belongs to the smallest bucket that it shares: it is made once
    own = open_.groupBy("id").agg(F.collect_set("bucket").alias("all"))
    open_all = open_.join(own, "id")
    few = open_all.where("grp != main").withColumnsRenamed(
        {"id": "x", "grp": "gx", "sig": "sx", "all": "ax"}).drop("main")
    open_all = open_all.drop("main")
    apart = F.col("grp") != F.col("gx")
    if signatures is not None:
        apart &= near(F.col("sig"), F.col("sx"))
    apart &= F.array_min(F.array_intersect("all", "ax")) == F.col("bucket")
    rest = (few.join(open_all, "bucket").where(apart)
            .select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    second = materialize(confirm(materialize(rest, "rest")), "confirmed")
    discard(placed, tried, open_)
    return first.union(second)
