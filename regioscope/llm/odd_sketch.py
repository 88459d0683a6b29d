"""Near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes.  Documents
with equal sets form a class; one representative of each class goes on:

1. MinHash samples are cut into bands; equal bands make candidates.
2. The samples are also folded into an odd sketch, a bitmap that holds the
   parity of the samples falling on each bit.  The XOR of two bitmaps holds
   only what the two samples do not share, so its population count
   estimates high similarities far more precisely than equal samples do;
   candidates clearly below the threshold go.
3. What remains is confirmed on the full sets, read again from the texts.

With 40 bands of 4 samples a pair at the threshold 0.75 is missed with a
chance of (1 - 0.75**4)**40, 2e-7.  ``SLACK`` is four standard deviations of
the estimate at the threshold, so a pair there is lost with a chance of 3e-5.

Null and empty texts have the empty set and link with nothing.  Rows that
repeat an id are one document for the links; a row without an id takes the
component of its class, or none.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.llm.bytescan import U, mix, shingles, text_buffers, word_hashes
from regioscope.llm.linking import bucket_links, connected_components
from regioscope.llm.scratch import materialize

BANDS, ROWS = 40, 4
#: MinHash samples: the first make the bands, all of them the odd sketch.
SAMPLES = 1280
#: Bits of an odd sketch.
BITS = 4096
#: Candidates whose estimate lies this far below the threshold go.
SLACK = 0.055

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLIERS = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def document_sets(raw: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    for i, j, words, first in word_hashes(raw, off):
        for row in range(j - i):
            yield np.unique(shingles(words[first[row]:first[row + 1]], k))


def min_samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row for each set; all sets hold something."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (np.concatenate(sets) >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), SAMPLES), np.uint32)
    v = np.empty_like(x)
    for j in range(SAMPLES):
        np.multiply(x, _MULTIPLIERS[j], out=v)
        np.add(v, _SHIFTS[j], out=v)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    h = np.tile(np.arange(BANDS, dtype=U), (len(samples), 1))
    for r in range(ROWS):
        h = mix(h * U(0x2545F4914F6CDD1D) + samples[:, r:BANDS * ROWS:ROWS].astype(U))
    return h


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    n = len(samples)
    spot = mix(samples.astype(U) | (np.arange(SAMPLES, dtype=U) << U(32))) % U(BITS)
    at = np.arange(n)[:, None] * BITS + spot.astype(np.int64)
    odd = (np.bincount(at.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """Population count of the XOR that two sets of this similarity have in
    the mean: 2 * SAMPLES * (1 - similarity) samples differ."""
    return round(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity))))


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands, sketch); the two set columns
    identify the whole set, bands and sketch are empty without shingles."""
    def flush(ids, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(sizes)
        samples = min_samples([sets[i] for i in some]) if len(some) \
            else np.zeros((0, SAMPLES), np.uint32)
        sums = np.zeros((2, len(sets)), U)
        for i in some:
            sums[0, i], sums[1, i] = sets[i].sum(dtype=U), mix(sets[i] ^ U(0xA5A5A5A55A5A5A5A)).sum(dtype=U)

        def lists(values, width):
            ends = np.cumsum([0, *(sizes > 0) * width])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                            pa.array(values.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums),
             lists(band_keys(samples), BANDS), lists(odd_sketches(samples), BITS // 64)],
            ["id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            first, held, sets = 0, 0, []
            for s in document_sets(raw, off, k):
                sets.append(s)
                held += len(s)
                if held > 1 << 19 or len(sets) >= 1000:
                    yield flush(batch.column(0).slice(first, len(sets)), sets)
                    first, held, sets = first + len(sets), 0, []
            if sets:
                yield flush(batch.column(0).slice(first, len(sets)), sets)

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, n_shingles long, set_a long, set_b long, "
                             "bands array<long>, sketch array<long>"))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int,
              id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets share enough: 100 * intersection
    >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = document_sets(*text_buffers(batch.column(2)), k)
            right = document_sets(*text_buffers(batch.column(3)), k)
            keep = []
            for x, y in zip(left, right):
                both = len(x) + len(y)
                shared = both - len(np.union1d(x, y))
                keep.append(shared > 0 and 100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    kind = docs.schema[id_col].dataType.simpleString()
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(asked, "id", "left_semi"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): the connected groups of linked
    documents; the smallest id of each group is kept."""
    if not 50 <= percent <= 100:
        raise ValueError("bands and sketches are built for 50 to 100 percent")
    sig = materialize(signatures(docs, k, id_col, text_col), "signatures")
    classes = materialize(sig.where("n_shingles > 0").groupBy("set_a", "set_b")
                          .agg(F.min("id").alias("rep")), "classes")
    reps = sig.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").where("n_shingles > 0")
    members = reps.select(F.explode("bands").alias("bucket"), "id").distinct()
    limit = most_differing_bits(percent / 100 - SLACK)
    sketch = reps.select("id", F.col("sketch").alias("sig")).dropDuplicates(["id"])

    def near(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda s, t: F.bit_count(s.bitwiseXOR(t))),
                           F.lit(0), lambda total, n: total + n) <= limit

    def confirm(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs, docs, percent, k, id_col, text_col)

    groups = connected_components(bucket_links(members, confirm, near, sketch)).withColumnRenamed("id", "rep")
    classes = classes.join(groups, "rep", "left")
    out = sig.select("id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")) \
        .otherwise(F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
