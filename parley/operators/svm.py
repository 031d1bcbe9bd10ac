"""Linear SVM with squared hinge loss and a penalised intercept, by a trust-region
Newton method over distributed Hessian-vector products.

Minimises ``|w|^2 / 2 + sum c_i max(0, 1 - y_i w.x_i)^2`` with ``y_i`` of -1 and 1, a
cost ``c_i`` for each row, and a constant feature 1 whose weight is the intercept.

* ``blocks`` turns texts into compressed sparse rows, an Arrow batch of rows or less a block: term
  numbers and unit-length TF-IDF values by Arrow look-ups, once.
* A pass over the blocks sums a loss with its gradient and its Hessian's diagonal, or the
  product of the Hessian with one vector; ``treeAggregate`` adds up vectors of the
  vocabulary's length, so the driver gets a few of them whatever the number of tasks.
* The driver holds vectors of that length alone. A step comes from conjugate gradients,
  preconditioned by the diagonal, until the residual is small against the gradient or
  the step reaches the trust radius; the radius follows how well the step was foretold.

The blocks are a written table, so a lost executor repeats one task's share of a pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import terms
from parley.session import cut_lineage

#: Bytes of blocks that a task works through in one pass.
PASS_BYTES = 64 << 20
#: Fixed values of the method: what a step must gain, and how the radius follows it.
GAIN, GROW, SHRINK, RESIDUAL = 1e-4, 4.0, 0.25, 0.3
#: Rows of a block at most: what is worked out for it follows this, not how many rows Spark sends at once.
BLOCK_ROWS = 1024
BLOCK = "starts binary, terms binary, x binary, y binary, c binary"


def blocks(rows: DataFrame, vocab: list[str], idf: list[float], text: str = "text", label: str = "label",
           cost: str = "weight") -> DataFrame:
    """Written table of compressed sparse rows: a row's terms ascend, its values have
    length 1 (or it has none); y is 1 where the label is 1, else -1. A row without a
    label or a cost is left out; a null text has no terms."""
    shared = rows.sparkSession.sparkContext.broadcast((pa.array(vocab, pa.string()), np.asarray(idf, np.float64)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scale = shared.value
        for batch in (b.slice(k, BLOCK_ROWS) for b in batches for k in range(0, b.num_rows, BLOCK_ROWS)):
            found = batch.column(0)
            number = pc.index_in(found.flatten(), names)
            row = pc.list_parent_indices(found).to_numpy()
            known = number.is_valid().to_numpy(zero_copy_only=False)
            place = row[known].astype(np.int64) * len(names) + number.drop_null().to_numpy()
            place, tf = np.unique(place, return_counts=True)
            row, term = place // max(len(names), 1), place % max(len(names), 1)
            x = tf * scale[term]
            norm = np.sqrt(np.bincount(row, x * x, minlength=batch.num_rows))
            x = x / norm[row]
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            y = np.where(batch.column(1).to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
            c = batch.column(2).to_numpy(zero_copy_only=False)
            parts = starts.astype("<i8"), term.astype("<i4"), x.astype("<f8"), y.astype("<f8"), c.astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=[b.split()[0] for b in BLOCK.split(", ")])
    picked = rows.where(F.col(label).isNotNull() & F.col(cost).isNotNull()).select(
        terms(F.coalesce(F.col(text), F.lit(""))).alias("_terms"), F.col(label).cast("int").alias("_y"), F.col(cost).cast("double").alias("_c"))
    return cut_lineage(picked.mapInArrow(build, BLOCK), "svm-blocks")


class Block:
    """A block's rows as flat arrays, with the constant feature in the last place of a vector."""

    def __init__(self, row):
        self.starts, self.terms = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["terms"], "<i4")
        self.x, self.y, self.c = (np.frombuffer(row[k], "<f8") for k in ("x", "y", "c"))
        self.row = np.repeat(np.arange(len(self.y)), np.diff(self.starts))

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * v[self.terms], minlength=len(self.y)) + v[-1]

    def sums(self, weights: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        """Sum over rows of weight times values (``x``, and 1 in the last place)."""
        out = np.bincount(self.terms, weights[self.row] * x, minlength=size)
        out[-1] += weights.sum()
        return out


def losses(w: np.ndarray) -> Callable:
    """(loss, gradient, Hessian's diagonal) of a block at ``w``."""
    def of(b: Block) -> np.ndarray:
        gap = np.maximum(0.0, 1.0 - b.y * b.dot(w))
        on = 2 * b.c * (gap > 0)
        return np.concatenate([[(b.c * gap * gap).sum()], b.sums(-on * gap * b.y, b.x, len(w)), b.sums(on, b.x * b.x, len(w))])
    return of


def curvature(w: np.ndarray, v: np.ndarray) -> Callable:
    """The Hessian at ``w`` times ``v``, of a block."""
    def of(b: Block) -> np.ndarray:
        on = 2 * b.c * (b.y * b.dot(w) < 1)
        return b.sums(on * b.dot(v), b.x, len(w))
    return of


class Passes:
    """Sums of functions of the blocks; counts its passes."""

    def __init__(self, table: DataFrame):
        self.sc = table.sparkSession.sparkContext
        size = table.agg(F.sum(sum(F.length(b.split()[0]) for b in BLOCK.split(", ")))).first()[0] or 0
        tasks = max(1, -(-size // PASS_BYTES))
        rows = table.rdd.map(Block)
        # decoded once; a lost part is read again from the table
        self.rdd = (rows.coalesce(tasks) if tasks < rows.getNumPartitions() else rows).persist(StorageLevel.MEMORY_AND_DISK)
        self.count = 0

    def done(self) -> None:
        self.rdd.unpersist()

    def total(self, make: Callable, vectors: tuple[np.ndarray, ...], size: int) -> np.ndarray:
        self.count += 1
        shared = self.sc.broadcast(pickle.dumps(vectors))

        def add(total, block):
            return total + make(*pickle.loads(shared.value))(block)
        out = self.rdd.treeAggregate(np.zeros(size), add, lambda a, b: a + b, depth=2)
        shared.unpersist()
        return out


def first_pass(table: DataFrame, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian's diagonal) of the terms where all weights are 0."""
    passes, size = Passes(table), n_terms + 1
    sums = passes.total(losses, (np.zeros(size),), 1 + 2 * size)
    passes.done()
    return sums[1:size], 1.0 + sums[size + 1:-1]


def fit(table: DataFrame, n_terms: int, max_iter: int = 2000, tol: float = 1e-4) -> tuple[np.ndarray, float, int]:
    """(coefficients, intercept, passes over the blocks). Stops where the gradient is
    below ``tol`` of the one at zero, or after ``max_iter`` Newton steps. Without rows
    all weights are 0."""
    passes, size = Passes(table), n_terms + 1

    def at(w):
        sums = passes.total(losses, (w,), 1 + 2 * size)
        return float(w @ w / 2 + sums[0]), w + sums[1:size + 1], 1.0 + sums[size + 1:]
    w = np.zeros(size)
    value, gradient, diagonal = at(w)
    first = float(np.linalg.norm(gradient))
    radius = None
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= tol * first or first == 0:
            break
        scale = np.sqrt(diagonal)                       # steps are measured in the diagonal's norm
        if radius is None:
            radius = float(np.linalg.norm(gradient / scale))
        step, residual, edge = _conjugate(lambda v: v + passes.total(curvature, (w, v), size), gradient, scale, radius)
        foretold = float(residual @ step - gradient @ step) / 2
        new_value, new_gradient, new_diagonal = at(w + step)
        gained = value - new_value
        if gained < SHRINK * foretold:
            radius = max(float(np.linalg.norm(scale * step)) * SHRINK, 1e-12)
        elif edge and gained > (1 - SHRINK) * foretold:
            radius *= GROW
        if gained > GAIN * foretold:
            w, value, gradient, diagonal = w + step, new_value, new_gradient, new_diagonal
        elif abs(gained) <= 1e-14 * abs(value):
            break                                       # below what doubles tell apart
    passes.done()
    return w[:-1], float(w[-1]), passes.count


def _conjugate(times: Callable, gradient: np.ndarray, scale: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """(step, residual, whether it ends at the radius) of conjugate gradients, preconditioned
    by ``scale`` squared. A step is long enough once its residual is small by ``RESIDUAL``."""
    step, residual = np.zeros_like(gradient), -gradient
    z = residual / scale ** 2
    along, rz = z.copy(), float(residual @ z)
    enough = RESIDUAL ** 2 * rz
    while rz > enough:
        bent = times(along)
        alpha = rz / float(along @ bent)
        further = step + alpha * along
        if np.linalg.norm(scale * further) > radius:
            a, b = scale * along, scale * step          # |b + t a| = radius
            aa, ab, bb = float(a @ a), float(a @ b), float(b @ b)
            t = (-ab + np.sqrt(max(0.0, ab * ab + aa * (radius * radius - bb)))) / aa
            return step + t * along, residual - t * bent, True
        step, residual = further, residual - alpha * bent
        z = residual / scale ** 2
        rz, before = float(residual @ z), rz
        along = z + rz / before * along
    return step, residual, False
