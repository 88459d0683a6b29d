"""Economic complexity on a long ``(region, product, value)`` table.

* ``rca``           Balassa index from marginal totals (no global window)
* ``proximity``     co-occurrence / max ubiquity, computed block-wise
* ``relatedness``   density of related products around each region
* ``fitness``       fitness / complexity fixed point (checkpointed)
* ``complexity_index``  ECI / PCI by reflections with deflation
* ``spanning_tree`` maximum spanning tree by Boruvka rounds
* ``project_network``   tree plus strongest extra edges
* ``degree``, ``betweenness``  node centrality

Scale notes.  Region and product vectors (one row per region / product) are
dimension-sized; the cell table M is at most regions x products.  Vectors
are broadcast only behind a check of rows and bytes.  Proximity forms only
pairs that occur together, and a region with very many products is cut into
pairs of blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioscope.functions.rsem import safe_div
from regioscope.operators.joins import broadcast_if_small, broadcast_or_salted
from regioscope.session import cut_lineage, scratch_tables

# -- RCA ------------------------------------------------------------------------


def rca(df: DataFrame, region: str = "country", product: str = "product",
        value: str = "value", cutoff: float = 1.0, min_region_total: float | None = None,
        min_product_total: float | None = None, drop_nonpositive: bool = False) -> DataFrame:
    """Balassa RCA: ``(x_cp / x_c.) / (x_.p / x_..)`` and ``m = rca >= cutoff``.

    Cells are pre-aggregated; missing values are dropped.  Negative and zero
    cells count in the margins (value added can be negative);
    ``drop_nonpositive`` leaves them out.  ``min_region_total`` / ``min_product_total``
    keep only regions / products whose total value reaches the threshold
    (the ``threshold=...:900`` of a complexity service) before any index is
    computed.  Output ``(region, product, value, rca, m)``.
    """
    cells = (df.where(F.col(value).isNotNull())
             .groupBy(F.col(region).alias("region"), F.col(product).alias("product"))
             .agg(F.sum(value).alias("value")))
    if drop_nonpositive:
        cells = cells.where(F.col("value") > 0)
    for key, bound in (("region", min_region_total), ("product", min_product_total)):
        if bound is not None:
            keep = cells.groupBy(key).agg(F.sum("value").alias("_t")) \
                .where(F.col("_t") >= bound).select(key)
            cells = cells.join(keep, key, "left_semi")
    # read four times below (two margins, the total, the cells): written once
    cells = cut_lineage(cells)
    rt = cells.groupBy("region").agg(F.sum("value").alias("_rt"))
    pt = cells.groupBy("product").agg(F.sum("value").alias("_pt"))
    total = cells.select(F.sum("value")).scalar()
    out = (cells.join(broadcast_if_small(rt), "region")
           .join(broadcast_if_small(pt), "product")
           .withColumn("rca", safe_div(safe_div(F.col("value"), F.col("_rt")),
                                       safe_div(F.col("_pt"), total)))
           .withColumn("m", (F.col("rca") >= cutoff).cast("int"))
           .drop("_rt", "_pt"))
    return out.select("region", "product", "value", "rca", "m")


def incidence(rca_df: DataFrame) -> DataFrame:
    """The 1-cells of M: ``(region, product)``."""
    return rca_df.where(F.col("m") == 1).select("region", "product")


# -- proximity ------------------------------------------------------------------


def proximity(m: DataFrame, on: str = "product", block_size: int = 1024) -> DataFrame:
    """Proximity between products (``on='product'``) or regions.

    phi(a, b) = |S_a & S_b| / max(|S_a|, |S_b|) where S_x is the set of
    the other side's ids present with x.  Output ``(a, b, phi)`` with
    ``a < b`` and phi > 0 (zero pairs stay implicit).

    Only items that occur together meet: M is joined with itself on the
    other side's id, and the pairs are counted with a partial aggregate.
    An id with more than ``block_size`` items is cut into blocks, and each
    unordered pair of its blocks is a join key of its own, so no key has
    more than ``block_size**2`` pairs whatever the skew.
    """
    other = "region" if on == "product" else "product"
    m = cut_lineage(m.select(F.col(on).alias("item"), F.col(other).alias("with")).distinct())
    k = m.groupBy("item").agg(F.count(F.lit(1)).alias("k"))
    blocks = m.groupBy("with").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("nb"))
    d = m.join(broadcast_if_small(blocks), "with") \
        .withColumn("blk", F.pmod(F.xxhash64("item"), F.col("nb")).cast("int"))
    # the left side meets blocks >= its own, the right side blocks <= its own
    left = d.select("with", F.col("item").alias("x"), F.col("blk").alias("bi"),
                    F.explode(F.sequence(F.col("blk"), F.col("nb") - 1)).alias("bj"))
    right = d.select("with", F.col("item").alias("y"), F.col("blk").alias("bj"),
                     F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("bi"))
    pairs = left.join(right, ["with", "bi", "bj"]).where((F.col("bi") < F.col("bj")) | (F.col("x") < F.col("y")))
    co = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")) \
        .agg(F.count(F.lit(1)).alias("co"))
    ka, kb = (k.select(F.col("item").alias(c), F.col("k").alias(f"k{c}")) for c in "ab")
    return (co.join(broadcast_if_small(ka), "a").join(broadcast_if_small(kb), "b")
            .select("a", "b", (F.col("co") / F.greatest("ka", "kb")).alias("phi")))


def symmetric(phi: DataFrame) -> DataFrame:
    """Both orientations of an upper-triangle pair table."""
    return phi.unionByName(phi.select(F.col("b").alias("a"), F.col("a").alias("b"), "phi"))


# -- relatedness ----------------------------------------------------------------


def relatedness(m: DataFrame, phi: DataFrame, include_self: bool = False,
                cells: DataFrame | None = None) -> DataFrame:
    """Density of region c around product p:
    ``sum_p' M[c,p'] phi[p',p] / sum_p' phi[p',p]``.

    Output ``(region, product, density)`` for every pair with a positive
    numerator, or for the pairs ``(region, product)`` of ``cells``: then 0
    where no neighbour is present, NULL where the product has no neighbour.
    phi is dimension-sized (products^2) and is broadcast only
    behind a size check; otherwise the join is a shuffle join in which the
    hot products of M are salted.
    """
    sym = symmetric(cut_lineage(phi))
    if include_self:
        items = m.select(F.col("product").alias("a")).distinct()
        sym = sym.unionByName(items.select("a", F.col("a").alias("b"), F.lit(1.0).alias("phi")))
    den = sym.groupBy(F.col("b").alias("product")).agg(F.sum("phi").alias("_den"))
    # phi is broadcast when a count bounds it; otherwise hot products of M
    # (present in very many regions) are salted
    num = (broadcast_or_salted(m.select("region", "product"),
                               sym.select(F.col("a").alias("product"), "b", "phi"), "product")
           .groupBy("region", F.col("b").alias("product"))
           .agg(F.sum("phi").alias("_num")))
    if cells is not None:
        asked = cells.select("region", "product").distinct()
        found = asked.join(num, ["region", "product"], "left").join(broadcast_if_small(den), "product", "left")
        return found.select("region", "product", F.when(F.col("_den").isNotNull(), safe_div(
            F.coalesce("_num", F.lit(0.0)), F.col("_den"))).alias("density"))
    return (num.join(broadcast_if_small(den), "product")
            .select("region", "product", safe_div(F.col("_num"), F.col("_den")).alias("density")))


# -- fitness ----------------------------------------------------------------------


def _bcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _copartitioned(m: DataFrame):
    """M written twice, grouped by region and by product: a round's partial
    aggregate on that key has few rows left to shuffle.  The score vectors
    are broadcast when they are measured to be small."""
    # no fixed count: AQE may coalesce small partitions; hash layout stays
    return (cut_lineage(m.repartition("region")),
            cut_lineage(m.repartition("product")))


def fitness(m: DataFrame, iterations: int = 20, checkpoint_every: int = 5,
            hint_broadcast: bool = False, max_broadcast_rows: int = 2_000_000):
    """Fitness of regions and complexity of products (Tacchella et al.).

    ``F_n(c) = sum_p M Q_{n-1}(p)``, ``Q_n(p) = 1 / sum_c M / F_{n-1}(c)``,
    both divided by their mean every round; start from ones.  Returns
    ``(regions, products)`` as ``(name, value)`` DataFrames.

    Dividing by the mean only rescales, and both maps are homogeneous of
    degree one, so the rescaling is applied when the vectors are
    checkpointed (every ``checkpoint_every`` rounds and at the end): in
    between, ``F`` and ``Q`` are two linear plan chains with no scalar
    jobs.  The vectors have one row per region / product.  By default the
    rounds use plain joins and AQE broadcasts a vector only after measuring
    its materialised size; ``hint_broadcast`` adds explicit hints behind a
    row count instead.
    """
    m_r, m_p = _copartitioned(m.select("region", "product"))
    regions = m_r.select(F.col("region").alias("name")).distinct()
    products = m_p.select(F.col("product").alias("name")).distinct()
    small = hint_broadcast and regions.count() + products.count() <= max_broadcast_rows
    fv = cut_lineage(regions.withColumn("value", F.lit(1.0)))
    qv = cut_lineage(products.withColumn("value", F.lit(1.0)))
    for i in range(iterations):
        # M hash-partitioned by region: the group-by needs no exchange
        f_new = (m_r.join(_bcast(qv.withColumnRenamed("name", "product"), small), "product")
                 .groupBy("region").agg(F.sum("value").alias("value"))
                 .withColumnRenamed("region", "name"))
        q_new = (m_p.join(_bcast(fv.withColumnRenamed("name", "region"), small), "region")
                 .groupBy("product").agg((1.0 / F.sum(1.0 / F.col("value"))).alias("value"))
                 .withColumnRenamed("product", "name"))
        fv, qv = f_new, q_new
        if (i + 1) % checkpoint_every == 0 or i == iterations - 1:
            fv, qv = cut_lineage(fv), cut_lineage(qv)
            # rescaled vectors written once, so later rounds do not re-run
            # the mean subqueries in every job
            fv = cut_lineage(fv.withColumn("value", F.col("value") / fv.select(F.avg("value")).scalar()))
            qv = cut_lineage(qv.withColumn("value", F.col("value") / qv.select(F.avg("value")).scalar()))
    return fv, qv


# -- ECI / PCI ----------------------------------------------------------------------


def complexity_index(m: DataFrame, iterations: int = 20, checkpoint_every: int = 5,
                     hint_broadcast: bool = False, max_broadcast_rows: int = 2_000_000):
    """ECI (regions) and PCI (products) by the method of reflections.

    Each step maps region scores to products and back,
    ``x <- D_c^-1 M D_p^-1 M' x``.  The trivial (constant) eigen-direction
    is removed with the diversity-weighted mean; that projection commutes
    with the step (the weights are the step's stationary distribution), so
    it is applied at each checkpoint rather than every step, together with
    a rescale to unit sd.  The iteration thus converges to the second
    eigenvector instead of collapsing.  Final scores are z-scores; the sign
    makes ECI correlate positively with diversity, and PCI is the
    product-side image of ECI.  Returns ``(eci, pci)`` as ``(name, value)``.
    Joins in the rounds are plain (AQE broadcasts measured-small sides)
    unless ``hint_broadcast``.
    """
    kc = m.groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("kc"))
    kp = m.groupBy("product").agg(F.count(F.lit(1)).cast("double").alias("kp"))
    kc, kp = cut_lineage(kc), cut_lineage(kp)
    small = hint_broadcast and kc.count() + kp.count() <= max_broadcast_rows
    mk = m.join(_bcast(kc, small), "region").join(_bcast(kp, small), "product")
    mk_c, mk_p = _copartitioned(mk)

    def deflate(xd: DataFrame) -> DataFrame:
        xd = cut_lineage(xd.join(_bcast(kc, small), "region"))
        wmean = xd.select(F.sum(F.col("kc") * F.col("x")) / F.sum("kc")).scalar()
        xd = xd.withColumn("x", F.col("x") - wmean)
        # written once: later rounds must not re-run the scalar subqueries
        return cut_lineage(xd.withColumn("x", safe_div(F.col("x"),
                                                       xd.select(F.stddev_samp("x")).scalar()))
                           .select("region", "x"))

    x = deflate(kc.select("region", F.col("kc").alias("x")))
    for i in range(iterations):
        y = (mk_p.join(_bcast(x, small), "region")
             .groupBy("product").agg((F.sum("x") / F.first("kp")).alias("y")))
        x = (mk_c.join(_bcast(y, small), "product")
             .groupBy("region").agg((F.sum("y") / F.first("kc")).alias("x")))
        if (i + 1) % checkpoint_every == 0 or i == iterations - 1:
            x = deflate(x)
    x = cut_lineage(x)
    z = x.withColumn("x", safe_div(F.col("x") - x.select(F.avg("x")).scalar(),
                                   x.select(F.stddev_samp("x")).scalar()))
    cor = safe_div(F.covar_samp("x", "kc"), F.stddev_samp("x") * F.stddev_samp("kc"))
    sign = z.join(kc, "region").select(
        F.when(cor < 0, F.lit(-1.0)).otherwise(F.lit(1.0))).scalar()
    eci = cut_lineage(z.select(F.col("region").alias("name"), (F.col("x") * sign).alias("value")))
    y = (mk_p.join(_bcast(eci.withColumnRenamed("name", "region"), small), "region")
         .groupBy("product").agg((F.sum("value") / F.first("kp")).alias("y")))
    y = cut_lineage(y)
    pci = y.select(F.col("product").alias("name"),
                   safe_div(F.col("y") - y.select(F.avg("y")).scalar(),
                            y.select(F.stddev_samp("y")).scalar()).alias("value"))
    return eci, pci


# -- networks --------------------------------------------------------------------


def _edge_order(w, a, b):
    """Total order on edges: heavier first, ties to the larger endpoints."""
    return F.struct(w.alias("w"), a.alias("a"), b.alias("b"))


def spanning_tree(edges: DataFrame, max_rounds: int = 64, hint_broadcast: bool = False,
                  max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Maximum spanning forest of an undirected weighted graph
    ``(a, b, phi)`` by Boruvka rounds.

    Each round every component picks its heaviest outgoing edge (ties by a
    fixed total order, so no cycles form), the picked edges join the
    forest, and components merge by pointer jumping until no pointer
    moves (at most ceil(log2 c) + 1 jumps for c components).  Edges carry the
    components of their ends, and those that a round leaves inside one
    component are dropped, so every round reads and writes fewer: an edge
    that lost is never looked at again.  The number of rounds is logarithmic
    in the number of nodes.
    """
    e = edges.select("a", "b", F.col("phi").cast("double").alias("w")).where(F.col("a") != F.col("b"))
    e = cut_lineage(e.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")))
    small, tree = None, None
    for rounds in range(max_rounds + 1):
        if rounds == max_rounds:
            raise RuntimeError(f"spanning tree not finished after {max_rounds} rounds")
        cand = e.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "a", "b", "w") \
            .unionByName(e.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "a", "b", "w"))
        best = cand.groupBy("c").agg(F.max_by(F.struct("o", "a", "b", "w"),
                                              _edge_order(F.col("w"), F.col("a"), F.col("b")))
                                     .alias("e"))
        best = cut_lineage(best.select("c", "e.o", "e.a", "e.b", "e.w"))
        n_comp = best.count()
        if n_comp == 0:
            break
        if small is None:  # the first round has the most components
            small = hint_broadcast and n_comp <= max_broadcast_rows
        picked = best.select("a", "b", "w").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        tree = cut_lineage(tree.distinct())
        # parent pointers; mutual pairs resolve to the smaller id as root
        par = best.select("c", F.col("o").alias("p"))
        back = par.select(F.col("c").alias("p"), F.col("p").alias("c"))
        par = (par.join(back.withColumn("_mutual", F.lit(True)), ["c", "p"], "left")
               .select("c", F.when(F.col("_mutual") & (F.col("c") < F.col("p")), F.col("c"))
                       .otherwise(F.col("p")).alias("p")))
        par = cut_lineage(par)
        for _ in range(math.ceil(math.log2(max(2, n_comp))) + 1):
            pb = _bcast(par.select(F.col("c").alias("p"), F.col("p").alias("pp")), small)
            nxt = cut_lineage(par.join(pb, "p", "left")
                              .select("c", F.coalesce("pp", "p").alias("p")))
            moved = nxt.join(par.withColumnRenamed("p", "p0"), "c") \
                .where(F.col("p") != F.col("p0")).limit(1).count()
            par = nxt
            if moved == 0:
                break
        # every component with an edge left is in the table of pointers
        e = cut_lineage(
            e.join(_bcast(par.select(F.col("c").alias("ca"), F.col("p").alias("ra")), small), "ca")
            .join(_bcast(par.select(F.col("c").alias("cb"), F.col("p").alias("rb")), small), "cb")
            .where("ra != rb").select("a", "b", "w", F.col("ra").alias("ca"), F.col("rb").alias("cb")))
    if tree is None:
        return edges.select("a", "b", F.col("phi").cast("double").alias("weight")).limit(0)
    return tree.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                       F.col("w").alias("weight"))


def _step_threshold(rest: DataFrame, room: float, tolerance: float) -> float:
    """The first multiple of ``tolerance`` that at most ``room`` of the edges
    ``rest`` exceed: one aggregate of at most max weight / tolerance bins."""
    w, i = F.col("weight"), F.floor(F.col("weight") / tolerance)
    above = F.when(w > (i + 1) * tolerance, i + 1).when(w > i * tolerance, i).otherwise(i - 1)  # the last step it exceeds
    bins = rest.groupBy(above.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("i >= 0")
    left, at = 0, 0
    for r in bins.orderBy(F.desc("i")).toLocalIterator():
        left += r["n"]
        if left > room:
            at = r["i"] + 1
            break
    return at * tolerance


def project_network(phi: DataFrame, avg_links: float = 4.0, tolerance: float | None = None,
                    nodes: DataFrame | None = None) -> DataFrame:
    """Spanning tree plus the strongest remaining edges.  Output
    ``(a, b, weight, in_tree)``.

    Without ``tolerance`` edges are added until the mean degree reaches
    ``avg_links`` (ties at the cut kept).  With it, a threshold rises from 0 in
    steps of ``tolerance`` until the edges above it, and the tree, give a mean
    degree of at most ``avg_links`` (the first step that does).  ``nodes``
    (name) lists isolated nodes too, as rows without ``b`` and weight.
    """
    tree = cut_lineage(spanning_tree(phi))
    n_nodes = tree.select("a").union(tree.select("b")).distinct().count()
    n_tree = tree.count()
    want = max(0, math.ceil(avg_links * n_nodes / 2.0) - n_tree)
    rest = phi.select("a", "b", F.col("phi").cast("double").alias("weight")).where("a != b") \
        .join(tree.select("a", "b"), ["a", "b"], "left_anti")
    net = tree.withColumn("in_tree", F.lit(True))
    if tolerance is not None:
        rest = cut_lineage(rest)
        least = _step_threshold(rest, avg_links * n_nodes / 2.0 - n_tree, tolerance)
        net = net.unionByName(rest.where(F.col("weight") > least).withColumn("in_tree", F.lit(False)))
    elif want > 0:
        kth = rest.orderBy(F.col("weight").desc()).limit(want).agg(F.min("weight")).scalar()
        extra = rest.where(F.col("weight") >= kth).withColumn("in_tree", F.lit(False))
        net = net.unionByName(extra)
    if nodes is not None:
        ends = tree.select(F.col("a").alias("name")).union(tree.select("b")).distinct()
        alone = nodes.select("name").distinct().join(ends, "name", "left_anti")
        net = net.unionByName(alone.select(F.col("name").alias("a"), F.lit(None).cast("string").alias("b"),
                                           F.lit(None).cast("double").alias("weight"), F.lit(False).alias("in_tree")))
    return cut_lineage(net)


def degree(net: DataFrame) -> DataFrame:
    """Node degree of an undirected edge table ``(a, b, ...)``."""
    ends = net.select(F.col("a").alias("name")).union(net.select(F.col("b").alias("name")))
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def _relax(write, d: DataFrame, e: DataFrame, max_rounds: int, eps: float, compact: int = 12) -> DataFrame:
    """Distances ``(s, v, dist)`` from the starts ``d``.  A round looks only
    at pairs that the last one shortened (the frontier) and writes only those
    it shortens; the pieces are merged after ``compact`` rounds."""
    pieces, frontier = [d], d
    for rounds in range(max_rounds + 1):
        if rounds == max_rounds:
            raise RuntimeError(f"shortest paths not settled after {max_rounds} rounds")
        cand = (frontier.join(e, frontier.v == e.u)
                .groupBy("s", F.col("x").alias("v")).agg(F.min(F.col("dist") + F.col("len")).alias("dist")))
        known = functools.reduce(DataFrame.unionByName, pieces) \
            .groupBy("s", "v").agg(F.min("dist").alias("known"))
        frontier = write(
            cand.join(known, ["s", "v"], "left")
            .where(F.col("known").isNull() | (F.col("dist") < F.col("known") - eps * F.greatest(F.lit(1.0), "known")))
            .select("s", "v", "dist"))
        if frontier.isEmpty():
            break
        pieces.append(frontier)
        if len(pieces) > compact:
            pieces = [write(functools.reduce(DataFrame.unionByName, pieces)
                            .groupBy("s", "v").agg(F.min("dist").alias("dist")))]
    return write(functools.reduce(DataFrame.unionByName, pieces)
                 .groupBy("s", "v").agg(F.min("dist").alias("dist")))


def _along(write, dag: DataFrame, start: DataFrame, frm: str, to: str, weight, max_rounds: int, compact: int = 12) -> DataFrame:
    """``(s, v, value)``: the sum over all walks of the acyclic ``dag`` from
    ``start`` of the products of their edges' weights.  Round h writes the
    walks of h edges only; it ends when none is left."""
    pieces, walk = [start], start
    for rounds in range(max_rounds + 1):
        if rounds == max_rounds:
            raise RuntimeError(f"walks not ended after {max_rounds} rounds")
        walk = write(dag.join(walk.withColumnRenamed("v", frm), ["s", frm])
                     .groupBy("s", F.col(to).alias("v")).agg(F.sum(F.col("value") * weight).alias("value")))
        if walk.isEmpty():
            break
        pieces.append(walk)
        if len(pieces) > compact:
            pieces = [write(functools.reduce(DataFrame.unionByName, pieces)
                            .groupBy("s", "v").agg(F.sum("value").alias("value")))]
    return write(functools.reduce(DataFrame.unionByName, pieces)
                 .groupBy("s", "v").agg(F.sum("value").alias("value")))


def betweenness(net: DataFrame, weighted: bool = True, weight: str = "weight",
                max_rounds: int = 10_000, eps: float = 1e-9, max_pairs: int = 200_000_000) -> DataFrame:
    """Betweenness centrality (Brandes) of an undirected network, as joins.

    1. Distances ``(s, v, dist)``: a frontier of shortened pairs is relaxed
       over the edges until it is empty.
    2. ``sigma(s, v)``, the number of shortest paths: walks along the edges
       that lie on shortest paths, one edge longer each round.
    3. Dependencies: ``delta(s, u) = sum_x sigma(s,u)/sigma(s,x) (1 + delta(s,x))``
       over successors x, the same walks backwards.
    4. ``betweenness(v) = sum_{s != v} delta(s, v) / 2``.

    Rounds write only what they change.  Sources are taken in batches so that
    a batch has at most about ``max_pairs`` (source, node) rows; only the sums
    per node outlive it.  Every step is a join or group-by keyed on (source,
    node); no task holds the whole graph.  Edge weights are lengths (above 0) when
    ``weighted``; edges without a weight, loops and rows without an end are
    left out, and of parallel edges the shortest counts.
    """
    length = F.col(weight).cast("double") if weighted else F.lit(1.0)
    e1 = net.select(F.col("a").alias("u"), F.col("b").alias("x"), length.alias("len")).where("u != x and len is not null")
    e = cut_lineage(e1.unionByName(e1.select(F.col("x").alias("u"), F.col("u").alias("x"), "len"))
                    .groupBy("u", "x").agg(F.min("len").alias("len")))
    if not e.where("not len > 0").isEmpty():
        raise ValueError("edge weights must be above 0")
    nodes = e.select(F.col("u").alias("v")).distinct()
    n = nodes.count()
    batches = max(1, math.ceil(n * n / max_pairs))
    sums = []
    for b in range(batches):
        with scratch_tables(net.sparkSession) as write:
            mine = nodes.where(F.pmod(F.xxhash64("v"), F.lit(batches)) == b)
            start = write(mine.select(F.col("v").alias("s"), "v", F.lit(0.0).alias("dist")))
            d = _relax(write, start, e, max_rounds, eps)
            # shortest-path edges: u -> x whenever dist(s,u) + len == dist(s,x)
            du = d.select("s", F.col("v").alias("u"), F.col("dist").alias("du"))
            dx = d.select("s", F.col("v").alias("x"), F.col("dist").alias("dx"))
            dag = write(du.join(e, "u").join(dx, ["s", "x"])
                        .where(F.abs(F.col("du") + F.col("len") - F.col("dx")) <= eps * F.greatest(F.lit(1.0), F.col("dx")))
                        .select("s", "u", "x"))
            sigma = _along(write, dag, start.select("s", "v", F.lit(1.0).alias("value")), "u", "x", F.lit(1.0), max_rounds)
            su, sx = (sigma.select("s", F.col("v").alias(c), F.col("value").alias("s" + c)) for c in "ux")
            ratio = write(dag.join(su, ["s", "u"]).join(sx, ["s", "x"])
                          .select("s", "u", "x", (F.col("su") / F.col("sx")).alias("ratio")))
            # every node starts a walk of value 1; its own start is not a dependency
            ones = write(d.select("s", "v", F.lit(1.0).alias("value")))
            delta = _along(write, ratio, ones, "x", "u", F.col("ratio"), max_rounds)
            sums.append(cut_lineage(delta.where("s != v").groupBy("v").agg(F.sum(F.col("value") - 1.0).alias("part"))))
    out = functools.reduce(DataFrame.unionByName, sums).groupBy(F.col("v").alias("name")) \
        .agg((F.sum("part") / 2.0).alias("betweenness"))
    return nodes.select(F.col("v").alias("name")).join(out, "name", "left") \
        .select("name", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
