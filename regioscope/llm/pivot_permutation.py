"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order:
``PREFIX`` of them, and more as the pivots become denser
(``prefix_length``), so that recall does not fall with the table's size.  Inverted lists lead from pivots to vectors; two vectors
are candidates where their prefixes share at least ``SHARED`` pivots.  So
that no list is read twice for one pair and no pair is counted twice, lists
are kept for triples of pivots, and a pair belongs to the triple of its three
smallest shared pivots.  Candidates are verified by their cosine, in double
precision, as products of small matrices inside the tasks; a list longer
than ``BLOCK`` is cut into blocks, and each pair of blocks is a group of its
own.  No pair leaves a task: a group returns for each vector how many links
it found, and edges that connect what the links connect.

Equal vectors form a class, of which one representative is compared.

Pivots come from a sample of at most ``SAMPLE`` times their number, chosen by
a hash; close ones are left out, so that a crowded place does not take them
all.  Their number grows with the cube root of the number of vectors (up to
``MOST_PIVOTS``), which keeps the number of chance candidates a vector has
from growing.  Every row is indexed.

Vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing and are components of their own, as are rows
without an id.  Vectors of different length are not compared.  Rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.llm.linking import connected_components
from regioscope.llm.scratch import materialize

PREFIX, SHARED, BLOCK = 6, 3, 768
SAMPLE, MOST_PIVOTS, PIVOT_COSINE = 8, 4096, 0.8
#: Pivots for each cube root of the number of vectors; pivots up to which ``PREFIX`` will do.
PIVOTS, FEW_PIVOTS = 6, 128


def prefix_length(pivots: int) -> int:
    """Three more for every sixteenfold number of pivots: 10 for 4096.

    With random directions and pairs at cosine 0.951 a fixed prefix of 6 finds 0.98
    of the pairs with 128 pivots and 0.83 with 4096; this length 0.97 to 0.99.
    """
    return min(pivots, PREFIX + max(0, math.ceil(0.75 * math.log2(pivots / FEW_PIVOTS))))


def units(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one length."""
    v = np.asarray(lists.flatten(), np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` sample rows no two of which are close."""
    chosen = np.empty((wanted, sample.shape[1]))
    n = 0
    for v in sample:
        if n == wanted:
            break
        if not n or (chosen[:n] @ v).max() < PIVOT_COSINE:
            chosen[n] = v
            n += 1
    return chosen[:n]


def prefixes(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    width = prefix_length(len(pivots))
    near = -(vectors @ pivots.T)
    part = np.argpartition(near, width - 1, axis=1)[:, :width]
    order = np.argsort(np.take_along_axis(near, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def _postings(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, key, rep, n, prefix): a row per triple of the prefix."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes = np.asarray(part.column(0))
                for dim in np.unique(sizes).tolist():
                    mine = part.filter(pa.array(sizes == dim))
                    first = prefixes(units(mine.column(3), dim), shared.value[dim])
                    width = min(SHARED, first.shape[1])
                    sets = np.sort(first, axis=1)
                    combos = np.array(list(itertools.combinations(range(first.shape[1]), width)))
                    keys = np.zeros((len(first), len(combos)), np.int64)
                    for c in range(width):
                        keys = keys * (MOST_PIVOTS + 1) + sets[:, combos[:, c]] + 1
                    row = pa.array(np.repeat(np.arange(len(first)), len(combos)))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(sets.ravel().astype(np.int32)), sets.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [mine.column(0).take(row), pa.array(keys.ravel()), mine.column(1).take(row),
                         mine.column(2).take(row), lists.cast(pa.list_(pa.int32())).take(row)],
                        ["dim", "key", "rep", "n", "prefix"])

    return reps.select("dim", "rep", "n", "vec").mapInArrow(
        run, "dim int, key long, rep long, n long, prefix array<int>")


def _shares_smaller(sets: np.ndarray, other: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """For pairs of prefixes (rows of the two arrays): is some pivot below
    the triple's largest, and not in the triple, in both?"""
    out = np.zeros(len(sets), bool)
    for a in range(sets.shape[1]):
        x = sets[:, a]
        small = (x < triple[-1]) & ~np.isin(x, triple)
        if small.any():
            out |= small & (other == x[:, None]).any(axis=1)
    return out


def _group(rep, n, sets, vec, side, alone, triple, cosine):
    """(rep, links, label) of the vectors of one group that have links."""
    near = vec @ vec.T >= cosine
    np.fill_diagonal(near, False)
    if not alone:  # only pairs across the two blocks
        near &= side[:, None] != side[None, :]
    if not near.any():
        return None
    i, j = np.nonzero(np.triu(near))
    links = np.zeros(len(rep), np.int64)
    for at in range(0, len(i), 1 << 18):
        a, b = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
        own = ~_shares_smaller(sets[a], sets[b], triple)
        np.add.at(links, a[own], n[b[own]])
        np.add.at(links, b[own], n[a[own]])
    label = rep.copy()
    while True:  # smallest label along the links of this group
        low = np.where(near, label[None, :], label[:, None]).min(axis=1)
        if (low == label).all():
            break
        label = low
    some = near.any(axis=1)
    return rep[some], links[some], label[some]


def _links(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, label) from rows dealt and sorted by group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.RecordBatch | pa.Table):
            batch = table.combine_chunks().to_batches()[0] if isinstance(table, pa.Table) else table
            dim, key, p, q = (np.asarray(batch.column(c)) for c in ("dim", "key", "p", "q"))
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            edges = [0, *cut.tolist(), batch.num_rows]
            rep, n, side = (np.asarray(batch.column(c)) for c in ("rep", "n", "side"))
            found = []
            for s, e in zip(edges, edges[1:]):
                if e - s < 2:
                    continue
                part = batch.slice(s, e - s)
                vec = units(part.column("vec"), int(dim[s]))
                sets = np.asarray(part.column("prefix").flatten()).reshape(e - s, -1)
                width = min(SHARED, sets.shape[1])
                triple = np.array([int(key[s]) // (MOST_PIVOTS + 1) ** (width - 1 - c) % (MOST_PIVOTS + 1) - 1
                                   for c in range(width)])
                one = _group(rep[s:e], n[s:e], sets, vec, side[s:e], p[s] == q[s], triple, cosine)
                if one:
                    found.append(one)
            columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "links", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for c in ("dim", "key", "p", "q"):
                x = np.asarray(batch.column(c))
                same &= x == x[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # where the last group begins
            if last:
                yield finish(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("dim", "key", "p", "q")):
                yield finish(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield finish(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "rep long, links long, label long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    vec = F.col(vec_col)
    usable = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vec, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False))
    rows = materialize(vectors.select(F.col(id_col).alias("id"), F.when(usable, vec).alias("vec"))
                       .withColumns({"h1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")),
                                     "h2": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec"))}), "vectors")
    classes = materialize(rows.where("vec is not null").groupBy("h1", "h2")
                          .agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("n"),
                               F.first("vec").alias("vec")).withColumn("dim", F.size("vec")), "vector-classes")
    pivots = {}
    for dim, count in [tuple(r) for r in classes.groupBy("dim").count().collect()]:  # the lengths in use
        wanted = min(MOST_PIVOTS, max(32, round(PIVOTS * count ** (1 / 3))))
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("h1", F.lit("pivot")), "h2") \
            .limit(SAMPLE * wanted).select("vec").toArrow().column(0).combine_chunks()
        pivots[dim] = choose_pivots(units(sample, dim), wanted)
    postings = materialize(_postings(classes, pivots), "postings")
    lists = postings.groupBy("dim", "key").agg(F.count("*").alias("size")).where("size > 1") \
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = postings.join(lists, ["dim", "key"])
    mine = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("dim", "key", "rep", "n", "prefix", F.col("mine").alias("side"),
                         F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    full = dealt.join(classes.select("rep", "dim", "vec"), ["rep", "dim"])
    parts = max(1, math.ceil(postings.count() / 50_000))
    grouped = full.select("dim", "key", "p", "q", "side", "rep", "n", "prefix", "vec") \
        .repartition(parts, "dim", "key", "p", "q").sortWithinPartitions("dim", "key", "p", "q")
    found = materialize(_links(grouped, cosine), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("label != rep").select(F.col("label").alias("a"), F.col("rep").alias("b"))) \
        .withColumnRenamed("id", "rep")
    facts = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    out = rows.select("id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    own = F.col("id")
    component = F.coalesce("component", "rep", own)
    return out.select(own.alias(id_col),
                      (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"),
                      component.alias("component_id"), own.eqNullSafe(component).alias("kept"))
