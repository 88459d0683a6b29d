"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions, each with its own context tree over the
preceding ``DEPTH`` bytes.  A node at depth d has counted the decisions
after its d bytes of context, and its Krichevsky-Trofimov (KT) estimate
gives their probability Pe.  Bottom up the trees are weighted,

    Pw = Pe                        at full depth,
    Pw = 1/2 Pe + 1/2 prod Pw(children)  above,

and the next decision is predicted by mixing the KT estimates of all depths
along its context, each node with weight 1/2 Pe / Pw, what is left going
deeper.  A context that training never met ends the path; the weight left
goes to the node above it.  Texts end with byte 0xFF and begin after bytes
0xFE, neither of which occurs in UTF-8, so the probabilities of all texts
add up to one.

KT probabilities depend on counts alone, so training is counting: grams of
``DEPTH`` + 1 bytes are counted in blocks of documents, summed by gram, and
the trees are weighted group by group (a group has the grams of one two-byte
context, at most 2**24).  Only depths 0 and 1, at most 2**16 nodes, pass
through the driver.  For scoring, each block of documents is sent the
probabilities of the grams, and the counts of the words, that it holds:
nothing that grows with the corpus is broadcast.

Texts are lower-cased (A-Z).  Null texts count as empty; rows without an id
count as having the empty id, and rows that repeat an id are scored one by
one.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.llm.bytescan import _LOWER, U, text_buffers, word_hashes
from regioscope.llm.scratch import discard, materialize

DEPTH = 4
#: Text bytes of a block of documents, and bytes looked at at once.
BLOCK_BYTES, STEP = 24 << 20, 2 << 20
START, END = 0xFE, 0xFF
_GRAM, _WORD = 0, 1


# ---- counts and their probabilities ----------------------------------------

_TABLE = 1 << 14
_LOG_INT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE)))])  # log n!
_LOG_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])  # log G(n+.5)/G(.5)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def _log_half(n: np.ndarray) -> np.ndarray:
    small = n < _TABLE
    large = _stirling(np.where(small, _TABLE, n) + 0.5) - 0.5 * math.log(math.pi)
    return np.where(small, _LOG_HALF[np.where(small, n, 0)], large)


def _log_int(n: np.ndarray) -> np.ndarray:
    small = n < _TABLE
    return np.where(small, _LOG_INT[np.where(small, n, 0)], _stirling(np.where(small, _TABLE, n) + 1.0))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the KT probability of n0 zeros and n1 ones in any order."""
    return _log_half(n0) + _log_half(n1) - _log_int(n0 + n1)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log Pw, weight of the node itself); ``below`` are the logs of the
    children's products, None at full depth."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class _Tree:
    """The nodes of depths 2 to DEPTH below one or more two-byte contexts.

    ``keys`` are grams: the context, nearest byte first, then the byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte = (keys & U(0xFF)).astype(np.int64)
        steps = np.arange(8)
        self.node = (1 << steps) | (byte[:, None] >> (8 - steps))
        self.bit = (byte[:, None] >> (7 - steps)) & 1
        self.nodes, self.levels = {}, {}
        child = below = None
        for depth in range(DEPTH, 1, -1):
            context = keys >> U(8 * (DEPTH - depth + 1))
            full = ((context[:, None] << U(8)) | self.node.astype(U)).ravel()
            ids, where = np.unique(full, return_inverse=True)
            n = np.repeat(counts, 8)
            one = self.bit.ravel() == 1
            n1 = np.bincount(where, np.where(one, n, 0), len(ids)).astype(np.int64)
            n0 = np.bincount(where, np.where(one, 0, n), len(ids)).astype(np.int64)
            if child is not None:  # products of the children, one term for each child
                first = np.unique(child, return_index=True)[1]
                below = np.bincount(where[first], self.levels[depth + 1][2], len(ids))
            log_pw, weight = weigh(n0, n1, below)
            self.nodes[depth] = ids
            self.levels[depth] = (n0, n1, log_pw, weight, where)
            child = where

    def probabilities(self, stop1: np.ndarray, mass1: np.ndarray, rest1: np.ndarray,
                      nearest: np.ndarray) -> np.ndarray:
        """Log of the predicted probability of each gram's byte; the arrays
        describe depth 1 (see ``upper``), ``nearest`` is the nearest byte."""
        at = (nearest[:, None], self.node)
        stop, mass, rest = stop1[at].ravel(), mass1[at].ravel(), rest1[at].ravel()
        open_ = np.ones(len(stop), bool)
        for depth in range(2, DEPTH + 1):
            n0, n1, _, weight, where = self.levels[depth]
            n = (n0 + n1)[where]
            p = ((n1 + 0.5) / (n0 + n1 + 1))[where]
            open_ &= n > 0
            stop = np.where(open_, mass + rest * p, stop)
            w = weight[where]
            mass, rest = mass + rest * w * p, rest * (1 - w)
        one = self.bit.ravel() == 1
        return np.log(np.where(one, stop, 1 - stop)).reshape(-1, 8).sum(axis=1)


def upper(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depths 0 and 1 (arrays by nearest byte and node): what a path that
    stops there predicts, and mass and weight that one going deeper has."""
    log1, w1 = weigh(n0.ravel(), n1.ravel(), below.ravel())
    log1, w1 = log1.reshape(n0.shape), w1.reshape(n0.shape)
    a, b = n0.sum(axis=0), n1.sum(axis=0)
    _, w0 = weigh(a, b, log1.sum(axis=0))
    p0 = (b + 0.5) / (a + b + 1)
    p1 = (n1 + 0.5) / (n0 + n1 + 1)
    mass, rest = (w0 * p0)[None, :], (1 - w0)[None, :]
    stop = np.where(n0 + n1 > 0, mass + rest * p1, p0[None, :])
    return stop, mass + rest * w1 * p1, rest * (1 - w1)


# ---- blocks of documents ------------------------------------------------------

def _steps(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of about STEP bytes; a
    longer row comes in several parts."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > STEP:
            for at in range(int(off[i]), int(off[i + 1]), STEP):
                yield i, i + 1, at, min(at + STEP, int(off[i + 1]))
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= STEP:
            j += 1
        yield i, j, int(off[i]), int(off[j])
        i = j


def grams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each gram, gram) step by step; every byte and every text end
    is the last byte of one gram."""
    for i, j, lo, hi in _steps(off):
        head = max(lo - DEPTH, int(off[i])) if lo > off[i] else lo  # context in the part before
        ends = off[i + 1:j + 1]
        closed = hi == off[j]
        size = hi - head + (j - i) * (DEPTH + 1)
        data = np.full(size, START, np.uint8)
        row = np.repeat(np.arange(i, j), np.diff(np.concatenate([[head], np.minimum(ends, hi)])) + DEPTH + 1)
        begin = np.concatenate([[0], np.cumsum(np.diff(np.concatenate([[head], np.minimum(ends, hi)])) + DEPTH + 1)])
        body = np.ones(size, bool)
        body[(begin[:-1, None] + np.arange(DEPTH)).ravel()] = False
        body[begin[1:] - 1] = False
        data[body] = _LOWER[raw[head:hi]]
        data[begin[1:] - 1] = END
        if not closed:
            data[-1] = START
        x = data.astype(U)
        key = x[DEPTH:].copy()
        for d in range(DEPTH):
            key |= x[DEPTH - 1 - d:len(x) - 1 - d] << U(8 * (DEPTH - d))
        wanted = body.copy()
        wanted[begin[1:] - 1] = True
        if not closed:
            wanted[-1] = False
        if head < lo:
            wanted[DEPTH:DEPTH + lo - head] = False
        wanted = wanted[DEPTH:]
        yield row[DEPTH:][wanted], key[wanted]


def _count(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight[:0]


def _tally(parts: Iterator[tuple[np.ndarray, np.ndarray]], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all rows and how often each occurs in training rows."""
    keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for row, key in parts:
        mask = train[row]
        seen, n = np.unique(key[mask], return_counts=True)
        other = np.unique(key[~mask])
        keys += [seen, other]
        counts += [n, np.zeros(len(other), np.int64)]
        if sum(map(len, keys)) > 1 << 22:  # a bound on what is held
            found = _count(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [found[0]], [found[1]]
    return _count(np.concatenate(keys), np.concatenate(counts))


def _word_parts(raw, off):
    for i, j, h, first in word_hashes(raw, off):
        yield np.repeat(np.arange(i, j), np.diff(first)), h


def _features(table: pa.Table) -> pa.Table:
    """All grams and words of a block with their training counts."""
    table = table.combine_chunks()
    text = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
    raw, off = text_buffers(text)
    train = ~np.asarray(table.column("held_out"))
    kinds = [_tally(grams(raw, off), train), _tally(_word_parts(raw, off), train)]
    return pa.table({"block": pa.array(np.repeat(table.column("block")[0].as_py(), sum(len(k) for k, _ in kinds)), pa.int32()),
                     "kind": pa.array(np.repeat([_GRAM, _WORD], [len(k) for k, _ in kinds]), pa.int32()),
                     "key": pa.array(np.concatenate([k for k, _ in kinds]).view(np.int64)),
                     "n": pa.array(np.concatenate([n for _, n in kinds]))})


def _nodes(table: pa.Table) -> pa.Table:
    """Sums of one two-byte context for depth 1: counts and log Pw by node."""
    keys, n = np.asarray(table.column("key")).view(U), np.asarray(table.column("n"))
    tree = _Tree(keys, n)
    n0, n1, log_pw, _, _ = tree.levels[2]
    ids = tree.nodes[2]
    return pa.table({"byte": pa.array(((ids >> U(16)) & U(0xFF)).astype(np.int32)),
                     "node": pa.array((ids & U(0xFF)).astype(np.int32)),
                     "n0": pa.array(n0), "n1": pa.array(n1), "log_pw": pa.array(log_pw)})


def _scores(docs: pa.Table, facts: pa.Table, total: int, distinct: int, ends: int) -> pa.Table:
    """Scores of a block's documents from the facts that the block was sent."""
    docs = docs.combine_chunks()
    text = docs.column("text").chunk(0) if docs.num_rows else pa.array([], pa.string())
    raw, off = text_buffers(text)
    rows = docs.num_rows
    train = ~np.asarray(docs.column("held_out"))
    kind = np.asarray(facts.column("kind"))
    key, value = np.asarray(facts.column("key")).view(U), np.asarray(facts.column("value"))

    def sorted_kind(k):
        mine = key[kind == k]
        order = np.argsort(mine)
        return mine[order], value[kind == k][order]

    known, logs = sorted_kind(_GRAM)
    score = np.zeros(rows)
    for row, g in grams(raw, off):
        score += np.bincount(row, logs[np.searchsorted(known, g)], rows)
    local, count = _tally(_word_parts(raw, off), train)
    elsewhere, c = sorted_kind(_WORD)  # words that training rows of other blocks hold too
    count = count.astype(np.float64)
    if len(elsewhere):
        count[np.searchsorted(local, elsewhere)] = c
    denominator = total + 0.5 * (distinct + 1)
    part = np.log10((count + 0.5) / denominator)
    base = np.full(rows, math.log10((ends + 0.5) / denominator))
    n_tokens, n_known = np.ones(rows, np.int64), np.full(rows, int(ends > 0), np.int64)
    for row, w in _word_parts(raw, off):
        at = np.searchsorted(local, w)
        base += np.bincount(row, part[at], rows)
        n_tokens += np.bincount(row, minlength=rows)
        n_known += np.bincount(row, count[at] > 0, rows).astype(np.int64)
    return pa.table({"doc_id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens),
                     "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(rows, total)),
                     "base_score": pa.array(base), "score": pa.array(score / math.log(10))})


# ---- the Spark jobs -----------------------------------------------------------

def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
          held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probability of the text) of every row.  Rows whose
    crc32(id as text) modulo ``folds`` is ``held_fold`` are held out; the
    others are learnt from.  ``base_score`` is that of a smoothed unigram
    word model of the same rows."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = (F.crc32(name) % folds) == held_fold
    size = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.sum(F.when(held, 0).otherwise(1)).alias("e")).first()
    ends = size["e"] or 0
    blocks = max(1, math.ceil((size["b"] or 0) / BLOCK_BYTES))
    dealt = docs.select(F.col(id_col).alias("id"), text.alias("text"), held.alias("held_out"),
                        F.pmod(F.xxhash64(name, F.octet_length(text)), F.lit(blocks)).cast("int").alias("block"))

    features = materialize(dealt.groupBy("block").applyInArrow(_features, "block int, kind int, key long, n long"),
                           "features")
    words = features.where(F.col("kind") == _WORD)
    counts = words.groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("blocks"))
    counts = materialize(counts, "word-counts")
    sums = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    shared = words.join(counts.where("blocks > 1"), "key").where("c != n") \
        .select("block", "kind", "key", F.col("c").cast("double").alias("value"))

    found = features.where(F.col("kind") == _GRAM)
    summed = found.groupBy("key").agg(F.sum("n").alias("n"))
    summed = materialize(summed.withColumn("context", F.shiftrightunsigned("key", 8 * (DEPTH - 1))), "gram-counts")
    trees = summed.groupBy("context")
    nodes = trees.applyInArrow(_nodes, "byte int, node int, n0 long, n1 long, log_pw double")
    one = nodes.groupBy("byte", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
                                            F.sum("log_pw").alias("below")).collect()  # at most 2**16 rows
    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    for r in one:
        n0[r["byte"], r["node"]], n1[r["byte"], r["node"]], below[r["byte"], r["node"]] = r["n0"], r["n1"], r["below"]
    top = spark.sparkContext.broadcast(upper(n0.astype(np.int64), n1.astype(np.int64), below))

    def log_probabilities(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("key")).view(U)
        tree = _Tree(keys, np.asarray(table.column("n")))
        nearest = ((keys >> U(8 * DEPTH)) & U(0xFF)).astype(np.int64)
        return pa.table({"key": table.column("key"), "value": pa.array(tree.probabilities(*top.value, nearest))})

    model = trees.applyInArrow(log_probabilities, "key long, value double")
    wanted = found.join(model, "key").select("block", "kind", "key", "value")
    facts = materialize(wanted.union(shared), "facts")
    discard(features, counts, summed)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scores(left, right, total, distinct, ends)

    return (dealt.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(
        scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double").withColumnRenamed("doc_id", id_col))
