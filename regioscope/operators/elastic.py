"""Many penalised logistic regressions from shared passes over the rows.

A *fit* is one regression: a part of the rows (all but one fold, or one
group), a penalty and a mixing value.  All fits advance together: their
coefficients are the columns of one matrix, and one aggregate over the rows
gives every column its gradient, whatever the number of grid points, folds or
groups.  No fit has a job of its own.

The objective is Spark ML's: mean logistic loss plus
``penalty * (mix * |w|_1 + (1 - mix) / 2 * |w|_2^2)`` over the coefficients
of features scaled by their standard deviation within the fit's rows, the
intercept free.

* ``fit_many`` majorises first: p(1 - p) <= 1/4, so a quarter of the part's
  moment matrix bounds every Hessian of that part and one matrix serves all
  grid points; each pass solves the bounded problem by coordinate descent.
* Columns that are slow to converge (no penalty, classes that a feature
  separates) go on with Newton steps: the same aggregate then also sums each
  column's own Hessian.  A step that raises the objective is halved.

The driver holds the coefficient matrix in chunks of at most ``CHUNK_BYTES``
and the moments of the parts (k x k each), as Spark ML's own solvers hold
their coefficients.  Rows stay where they are as blocks of scaled features, so
a hot group is more blocks, not a larger task; sums are combined before the
shuffle.

``gradient_condition`` measures the optimum independently of the iterations:
the largest violation of 0 in gradient + subdifferential, from a pass of its
own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.operators.ranking import auroc
from regioscope.session import cut_lineage

#: Bytes of coefficients (or Hessians) that one chunk of fits may take.
CHUNK_BYTES = 64 << 20
#: Rows and columns whose margins are in memory at once.
TILE = 1024
#: Fits updated by one task at a time, and with Hessians of their own.
BUCKET, NEWTON_BUCKET = 64, 16
#: Bytes of products of features that one step of a Hessian sum takes, and the
#: number of fits from which on these products pay off.
PRODUCT_BYTES, FEW_FITS = 32 << 20, 40


@dataclass
class Design:
    """Scaled feature blocks and the moments of every part."""

    blocks: DataFrame            # part, n, y (binary), z (binary): intercept column first
    parts: list[str]
    mean: np.ndarray
    scale: np.ndarray
    moments: dict[str, np.ndarray]   # sum of z z' per part; its corner is the part's number of rows
    positives: dict[str, float]

    def rows_of(self, part: str, own: bool) -> np.ndarray:
        total = sum(self.moments.values())
        return self.moments[part] if own else total - self.moments[part]

    def positives_of(self, part: str, own: bool) -> float:
        return self.positives[part] if own else sum(self.positives.values()) - self.positives[part]


def _block_rows(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        part = np.asarray(b.column(0).to_pylist(), dtype=object)
        y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        for p in sorted(set(part)):
            at = np.flatnonzero(part == p)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p], pa.string()), "n": pa.array([len(at)], pa.int32()),
                "y": pa.array([y[at].tobytes()], pa.binary()), "z": pa.array([z[at].tobytes()], pa.binary())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for b in batches:
        for r in b.to_pylist():
            y = np.frombuffer(r["y"])
            yield r["part"], y, np.frombuffer(r["z"]).reshape(r["n"], -1)


def _sums(blocks: DataFrame, partial: Callable) -> DataFrame:
    """(fit, row, v): the sums of the vectors that ``partial`` yields for
    each (fit, row), combined before the shuffle."""
    rows = blocks.mapInArrow(partial, "fit int, row int, v array<double>")
    return (rows.groupBy("fit", "row").agg(Summarizer.sum(array_to_vector("v")).alias("s"))
            .select("fit", "row", vector_to_array("s").alias("v")))


def _vectors(fits: np.ndarray, rows: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of (fit, row, vector); ``values`` is one vector a row."""
    for i in range(0, len(fits), 2048):
        v = np.ascontiguousarray(values[i:i + 2048])
        offsets = np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fits[i:i + 2048], pa.int32()), pa.array(rows[i:i + 2048], pa.int32()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], ["fit", "row", "v"])


def design(df: DataFrame, part: str, label: str = "y", features: str = "features") -> Design:
    """Blocks of ``df`` (label 0/1, a vector of features) by the column
    ``part``.  Rows without a part or label belong to no fit."""
    rows = df.where(F.col(part).isNotNull() & F.col(label).isNotNull())
    s = (rows.groupBy(F.lit(1)).agg(Summarizer.metrics("mean", "std").summary(F.col(features)).alias("s"))
         .select("s.mean", "s.std").first())
    if s is None:
        return Design(None, [], np.zeros(0), np.ones(0), {}, {})
    mean, std = s["mean"].toArray(), s["std"].toArray()
    scale = np.where(std > 0, std, 1.0)
    blocks = cut_lineage(rows.select(F.col(part).cast("string").alias("part"), F.col(label).cast("double").alias("y"),
                                     vector_to_array(features).alias("x"))
                         .mapInArrow(lambda b: _block_rows(b, mean, scale), "part string, n int, y binary, z binary"))
    names = sorted(r[0] for r in blocks.select("part").distinct().collect())
    code = {p: i for i, p in enumerate(names)}

    def moments(batches):
        held = {}
        for p, y, z in _read(batches):
            m = np.vstack([z.T @ z, y @ z])
            held[p] = held[p] + m if p in held else m
            if len(held) * m.nbytes > CHUNK_BYTES:
                yield from _flush(held)
                held = {}
        yield from _flush(held)

    def _flush(held):
        for p, m in held.items():
            yield from _vectors(np.full(len(m), code[p]), np.arange(len(m)), m)

    found = {p: np.zeros((len(mean) + 2, len(mean) + 1)) for p in names}
    for r in _sums(blocks, moments).toLocalIterator():
        found[names[r["fit"]]][r["row"]] = r["v"]
    return Design(blocks, names, mean, scale, {p: m[:-1] for p, m in found.items()},
                  {p: float(m[-1, 0]) for p, m in found.items()})


@dataclass
class Fits:
    """Coefficients of many fits, one column each, on scaled features."""

    design: Design
    own: bool                # rows of the part itself (a group), or of all others (a fold)
    part: list[str]
    penalty: np.ndarray
    mix: np.ndarray
    w: np.ndarray            # (1 + features) x fits
    spread: dict[str, np.ndarray]   # a part's standard deviations; 0 where constant, and for the intercept
    passes: int = 0

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """Intercepts and coefficients on the features as given."""
        coef = self.w[1:] / self.design.scale[:, None]
        return self.w[0] - self.design.mean @ coef, coef


def _start(d: Design, points: list[tuple[str, float, float]], own: bool) -> Fits:
    """All fits at their intercepts."""
    fits = Fits(d, own, [p for p, _, _ in points], np.array([a for _, a, _ in points], float),
                np.array([m for _, _, m in points], float), np.zeros((len(d.mean) + 1, len(points))), {})
    logits = {}
    for p in set(fits.part):
        m = d.rows_of(p, own)
        n = m[0, 0]
        var = np.maximum(np.diag(m) / n - (m[0] / n) ** 2, 0) * n / max(n - 1, 1)
        fits.spread[p] = np.where(var > 1e-12, np.sqrt(var), 0)
        share = min(max(d.positives_of(p, own) / n, 1e-12), 1 - 1e-12)
        logits[p] = np.log(share / (1 - share))
    fits.w[0] = [logits[p] for p in fits.part]
    return fits


def _penalties(spread: dict[str, np.ndarray], part: list[str], penalty: np.ndarray, mix: np.ndarray):
    """(l1, l2, constant features) of fits, features x fits."""
    v = np.stack([spread[p] for p in part], axis=1)
    constant = v == 0
    constant[0] = False
    return v * (penalty * mix), v ** 2 * (penalty * (1 - mix)), constant


def _violation(w, g, l1, l2, dead):
    """Distance of 0 from gradient + subdifferential, largest coordinate."""
    s = g + l2 * w
    r = np.where(w != 0, np.abs(s + l1 * np.sign(w)), np.maximum(np.abs(s) - l1, 0))
    return np.where(dead, 0, r).max(0)


def _descend(w, g, h, l1, l2, dead, sweeps):
    """Coordinate descent on g'd + d'hd/2 + penalties, d = change of ``w``.
    Columns are fits; ``h`` is one matrix for all or one each (k x k x
    fits)."""
    w, r = w.copy(), g.copy()
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            own = h[j, j]
            u = own * w[j] - r[j]
            new = np.sign(u) * np.maximum(np.abs(u) - l1[j], 0) / np.maximum(own + l2[j], 1e-300)
            step = np.where(dead[j] | (own + l2[j] <= 1e-14), 0, new - w[j])
            if step.any():
                r += (h[:, j:j + 1] if h.ndim == 2 else h[:, j]) * step
                w[j] += step
                largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-9:
            break
    return w


def _newton(w, g, h, l1, l2, dead):
    """A proximal Newton step of fits with Hessians ``h`` (k x k x fits):
    closed form without an l1 penalty, else coordinate descent."""
    out, lasso = w.copy(), l1.any(0)
    if lasso.any():
        out[:, lasso] = _descend(w[:, lasso], g[:, lasso], h[:, :, lasso], l1[:, lasso], l2[:, lasso], dead[:, lasso], 200)
    for f in np.flatnonzero(~lasso):
        on = ~dead[:, f]
        a = h[:, :, f][np.ix_(on, on)] + np.diag(l2[on, f])
        out[on, f] -= np.linalg.lstsq(a, g[on, f] + l2[on, f] * w[on, f], rcond=1e-10)[0]
    return out


def _logistic(m: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-m)), in the place of ``m``."""
    np.negative(m, out=m)
    with np.errstate(over="ignore"):  # exp of a very low margin: a probability of 0
        np.exp(m, out=m)
    m += 1
    return np.reciprocal(m, out=m)


def _add_hessians(second: np.ndarray, fits: np.ndarray, z: np.ndarray, weight: np.ndarray) -> None:
    """Add z' diag(weight of a fit) z of all ``fits`` (columns of ``weight``)
    to ``second``, whose rows are lower triangles.  One matrix of the products
    of all pairs of features serves many fits; a few have theirs made alone."""
    k = z.shape[1]
    if len(fits) < FEW_FITS:
        low = np.tril_indices(k)
        for f, x in zip(fits, weight.T):
            second[f] += (z.T @ (z * x[:, None]))[low]
        return
    size = k * (k + 1) // 2
    rows = max(1, PRODUCT_BYTES // (8 * size))
    for b in range(0, len(z), rows):
        x = np.ascontiguousarray(z[b:b + rows].T)
        pairs = np.empty((size, x.shape[1]))
        for i in range(k):
            at = i * (i + 1) // 2
            np.multiply(x[i], x[:i + 1], out=pairs[at:at + i + 1])
        second[fits] += weight[b:b + rows].T @ pairs.T


def _pass(fits: Fits, at: np.ndarray, w: np.ndarray, hessians: bool) -> DataFrame:
    """(fit, row, v): row -1 is the gradient sum of fit ``at[fit]`` at ``w``,
    and behind it the loss sum, which only steps with Hessians look at; rows
    0.. are its Hessian sum."""
    code = {p: i for i, p in enumerate(fits.design.parts)}
    owner = np.array([code[fits.part[i]] for i in at], np.int32)
    sent = fits.design.blocks.sparkSession.sparkContext.broadcast((w, owner, code))
    own = fits.own

    def partial(batches):
        w, owner, code = sent.value
        k, n = w.shape
        sums, touched = np.zeros((k + 1, n)), np.zeros(n, bool)
        second = np.zeros((n, k * (k + 1) // 2)) if hessians else None
        for p, y, z in _read(batches):
            cols = np.flatnonzero((owner == code[p]) == own)
            for a in range(0, len(cols), TILE):
                c = cols[a:a + TILE]
                for b in range(0, len(y), TILE):
                    zz, yy = z[b:b + TILE], y[b:b + TILE, None]
                    m = zz @ w[:, c]
                    if hessians:
                        sums[-1, c] += (np.logaddexp(0, m) - yy * m).sum(0)
                    prob = _logistic(m)
                    if hessians:
                        _add_hessians(second, c, zz, prob * (1 - prob))
                    prob -= yy
                    sums[:-1, c] += zz.T @ prob
            touched[cols] = True
        cols = np.flatnonzero(touched)
        yield from _vectors(cols, np.full(len(cols), -1), sums[:, cols].T)
        if hessians:
            low, one = np.tril_indices(k), np.zeros((k, k + 1))  # as wide as the gradient: the loss column is empty here
            for j in cols:
                one[low] = second[j]
                one[low[::-1]] = second[j]
                yield from _vectors(np.full(k, j), np.arange(k), one)

    return _sums(fits.design.blocks, partial)


def _step(fits: Fits, at: np.ndarray, hessians: bool, tol: float):
    """One pass and update of the fits ``at``: (violation, objective, next
    coefficients), in their order; the objective only with ``hessians``."""
    k = len(fits.w)
    w = fits.w[:, at]
    parts = sorted({fits.part[i] for i in at})
    rows = {p: fits.design.rows_of(p, fits.own) for p in parts}
    state = fits.design.blocks.sparkSession.sparkContext.broadcast(
        (w, fits.spread, [fits.part[i] for i in at], fits.penalty[at], fits.mix[at],
         {p: m[0, 0] for p, m in rows.items()}, None if hessians else rows))

    def update(table: pa.Table) -> pa.Table:
        w, spread, part, penalty, mix, count, rows = state.value
        fit, row = table["fit"].to_numpy(), table["row"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(fit), -1)
        ids = np.unique(fit)
        place = {int(f): i for i, f in enumerate(ids)}
        first = row < 0
        sums = np.empty((len(ids), v.shape[1]))
        sums[[place[int(f)] for f in fit[first]]] = v[first]
        n = np.array([count[part[f]] for f in ids])
        g, loss = (sums[:, :-1] / n[:, None]).T, sums[:, -1] / n
        w = w[:, ids]
        l1, l2, dead = _penalties(spread, [part[f] for f in ids], penalty[ids], mix[ids])
        bad = _violation(w, g, l1, l2, dead)
        value = loss + (l1 * np.abs(w)).sum(0) + (l2 * w * w).sum(0) / 2
        new = w.copy()
        todo = bad > tol
        if rows is None:
            h = np.zeros((k, k, len(ids)))
            for f, i, x in zip(fit[~first], row[~first], v[~first]):
                h[i, :, place[int(f)]] = x[:k]
            new[:, todo] = _newton(w[:, todo], g[:, todo], h[:, :, todo] / n[todo], l1[:, todo], l2[:, todo], dead[:, todo])
        else:
            for p in {part[f] for f in ids}:
                c = np.array([part[f] == p for f in ids]) & todo
                if c.any():
                    new[:, c] = _descend(w[:, c], g[:, c], rows[p] / (4 * count[p]), l1[:, c], l2[:, c], dead[:, c], 8)
        return pa.table({"fit": pa.array(ids, pa.int32()), "bad": pa.array(bad), "value": pa.array(value),
                         "w": pa.array(list(new.T), pa.list_(pa.float64()))})

    out = (_pass(fits, at, w, hessians)
           .withColumn("bucket", F.floor(F.col("fit") / (NEWTON_BUCKET if hessians else BUCKET))).groupBy("bucket")
           .applyInArrow(lambda t: update(t.drop_columns(["bucket"])), "fit int, bad double, value double, w array<double>"))
    t = out.toArrow()
    order = np.argsort(t["fit"].to_numpy())
    new = t["w"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order].T
    fits.passes += 1
    return t["bad"].to_numpy()[order], t["value"].to_numpy()[order], new


def fit_many(d: Design, points: list[tuple[str, float, float]], own: bool, tol: float = 1e-5,
             bound_passes: int = 40, newton_passes: int = 40) -> Fits:
    """Fit every (part, penalty, mix).  ``own``: on the rows of the part
    (groups), else on all others (folds)."""
    fits = _start(d, points, own)
    if not points:
        return fits
    k = len(fits.w)
    todo = np.arange(len(points))
    # a start that is optimal already: every point of a part shares its gradient
    todo = todo[gradient_condition(fits) > tol]
    own_matrices = max(1, CHUNK_BYTES // (8 * k * (k + 1)))
    wide = max(1, CHUNK_BYTES // (8 * k))
    if not own:  # one bound serves many grid points
        for _ in range(bound_passes):
            if len(todo) <= own_matrices:
                break
            left = []
            for c in range(0, len(todo), wide):
                at = todo[c:c + wide]
                bad, _, new = _step(fits, at, False, tol)
                fits.w[:, at] = new
                left.append(at[bad > tol])
            todo = np.concatenate(left)
    for c in range(0, len(todo), own_matrices):
        at = todo[c:c + own_matrices]
        before, low = fits.w[:, at].copy(), np.full(len(at), np.inf)
        for _ in range(newton_passes):
            bad, value, new = _step(fits, at, True, tol)
            rose = value > low + 1e-12
            here = fits.w[:, at]
            fits.w[:, at] = np.where(rose, (here + before) / 2, new)
            before = np.where(rose, before, here)
            low = np.where(rose, low, value)
            on = (bad > tol) | rose
            at, before, low = at[on], before[:, on], low[on]
            if not len(at):
                break
    return fits


def _distinct(fits: Fits) -> tuple[np.ndarray, np.ndarray]:
    """Fits with coefficients of their own (the first of each set of equal
    ones of a part), and which of them every fit equals."""
    seen, which = {}, []
    for i, p in enumerate(fits.part):
        which.append(seen.setdefault((p, fits.w[:, i].tobytes()), len(seen)))
    first = np.unique(which, return_index=True)[1]
    return first, np.array(which, int)


def gradient_condition(fits: Fits) -> np.ndarray:
    """The largest violation of the optimality condition of every fit, from
    new passes over the rows."""
    first, which = _distinct(fits)
    g, wide = np.zeros((len(fits.w), len(first))), max(1, CHUNK_BYTES // (8 * len(fits.w)))
    for c in range(0, len(first), wide):
        at = first[c:c + wide]
        t = _pass(fits, at, fits.w[:, at], False).toArrow()
        n = np.array([fits.design.rows_of(fits.part[i], fits.own)[0, 0] for i in at])
        sums = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        fit = t["fit"].to_numpy()
        g[:, c + fit] = sums[:, :-1].T / n[fit]
    out = np.zeros(len(which))
    for c in range(0, len(which), wide):
        at = slice(c, c + wide)
        out[at] = _violation(fits.w[:, at], g[:, which[at]], *_penalties(
            fits.spread, fits.part[at], fits.penalty[at], fits.mix[at]))
    return out


def held_out_counts(fits: Fits) -> np.ndarray:
    """(fits, 4): true and false positives, false and true negatives of every
    fit on the rows of its own part, which a fold's fit has not seen."""
    code = {p: i for i, p in enumerate(fits.design.parts)}
    first, which = _distinct(fits)
    out, wide = np.zeros((len(first), 4)), max(1, CHUNK_BYTES // (8 * len(fits.w)))
    for start in range(0, len(first), wide):
        at = first[start:start + wide]
        sent = fits.design.blocks.sparkSession.sparkContext.broadcast(
            (fits.w[:, at], np.array([code[fits.part[i]] for i in at], np.int32)))

        def partial(batches, sent=sent):
            w, owner = sent.value
            sums = np.zeros((len(owner), 4))
            for p, y, z in _read(batches):
                cols = np.flatnonzero(owner == code[p])
                for a in range(0, len(cols), TILE):
                    c = cols[a:a + TILE]
                    for b in range(0, len(y), TILE):
                        yes, one = z[b:b + TILE] @ w[:, c] > 0, y[b:b + TILE, None] > 0.5
                        sums[c] += np.stack([(yes & one).sum(0), (yes & ~one).sum(0), (~yes & one).sum(0),
                                             (~yes & ~one).sum(0)], axis=1)
            cols = np.flatnonzero(sums.any(1))
            yield from _vectors(cols, np.full(len(cols), -1), sums[cols])

        for r in _sums(fits.design.blocks, partial).toLocalIterator():
            out[start + r["fit"]] = r["v"]
    return out[which]


def weighted_f1(counts: np.ndarray) -> np.ndarray:
    """F1 of both classes weighted by their rows, as Spark ML's multiclass
    evaluator has it."""
    tp, fp, fn, tn = counts.T
    with np.errstate(invalid="ignore", divide="ignore"):
        one, zero = np.nan_to_num(2 * tp / (2 * tp + fp + fn)), np.nan_to_num(2 * tn / (2 * tn + fp + fn))
        return ((tp + fn) * one + (tn + fp) * zero) / (tp + fp + fn + tn)


def held_out_scores(fits: Fits) -> tuple[DataFrame, np.ndarray]:
    """(fit, score, y): the margin of every row under every distinct fit that
    has not seen it, and the number ``fit`` of each fit there.  That is rows x
    distinct fits of one part, so for one-dimensional grids."""
    code = {p: i for i, p in enumerate(fits.design.parts)}
    first, which = _distinct(fits)
    sent = fits.design.blocks.sparkSession.sparkContext.broadcast(
        (fits.w[:, first], np.array([code[fits.part[i]] for i in first], np.int32)))

    def score(batches):
        w, owner = sent.value
        for p, y, z in _read(batches):
            cols = np.flatnonzero(owner == code[p])
            for a in range(0, len(cols), 64):
                c = cols[a:a + 64]
                for b in range(0, len(y), TILE):
                    m = z[b:b + TILE] @ w[:, c]
                    yield pa.RecordBatch.from_pydict({
                        "fit": pa.array(np.tile(c, len(m)), pa.int32()), "score": pa.array(m.ravel()),
                        "y": pa.array(np.repeat(y[b:b + TILE], len(c)))})

    return fits.design.blocks.mapInArrow(score, "fit int, score double, y double"), which


def grid_points(parts: list[str], penalties, mixes) -> list[tuple[str, float, float]]:
    """Every part x penalty x mix."""
    return [(p, float(a), float(m)) for p in parts for a in penalties for m in mixes]


def cross_validate(d: Design, penalties, mixes, metric: str = "areaUnderROC", tol: float = 1e-5):
    """Grid search over the folds of ``d``: (fits, metric of every fit), in
    the order of ``grid_points``.  Without a penalty the mixing value is
    idle, so those fits are made once."""
    asked = grid_points(d.parts, penalties, mixes)
    key = [(p, a, m if a else 0.0) for p, a, m in asked]
    points = list(dict.fromkeys(key))
    fits = fit_many(d, points, own=False, tol=tol)
    if metric == "f1":
        value = weighted_f1(held_out_counts(fits))
    elif metric == "areaUnderROC":
        scores, which = held_out_scores(fits)
        found = {r["fit"]: r["auroc"] for r in auroc(scores, "fit").toLocalIterator()}
        value = np.array([np.nan if found.get(int(i)) is None else found[int(i)] for i in which])
    else:
        raise ValueError(f"unknown metric {metric}")
    at = {q: i for i, q in enumerate(points)}
    every = np.array([at[q] for q in key], int)
    return fits, asked, every, value[every]


def mean_over_folds(asked, values) -> list[tuple[float, float, float]]:
    """(penalty, mix, mean value) of every grid point, as asked; folds
    without a value do not count."""
    sums = {}
    for (_, a, m), v in zip(asked, values):
        sums.setdefault((a, m), []).append(v)
    return [(a, m, float(np.nanmean(v)) if np.isfinite(v).any() else None) for (a, m), v in sums.items()]
