"""Whitening of embeddings on their leading components, found by spectrum slicing.

Every entry c of a vector becomes the whole number x = floor(1024 c) + 100000.
Spark sums the x-vectors exactly; the whole part of the mean comes off before
entries are multiplied, so each task's Gram matrix is exact in integers, and the
fraction of the mean that is left comes off the sums in integers too: the
covariance does not depend on how rows are dealt out. Only sums of one number for
each pair of dimensions reach the driver.

There, the number of eigenvalues above a shift is read from the signs of D in an
LDL' factorisation of covariance - shift (Sylvester's law of inertia). Bisection
on that count gives each leading eigenvalue an interval of its own; inverse
iteration from its middle and then Rayleigh quotient iteration, which converges
cubically, give the pair; counts just above and below certify its number. Equal
eigenvalues, which no shift parts, are taken together as one subspace.

Rows: null vectors and those with a null, NaN or infinite entry are left out; a
vector shorter than the longest counts 0 for its missing entries; repeated rows
count and are returned as often as they occur; a null id is returned as null.
Directions without variance (up to rounding) are no components, so equal vectors
or a single one give an empty result, as does an empty table. An entry beyond
2**20 in size is an error. A deviation that no long holds is null. Further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024.0, 100_000, 1 << 20
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, column: str, scale: float, shift: int, *kept: Column) -> DataFrame:
    """`kept` columns and `x`, the whole numbers of each vector that is finite."""
    good = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(column, lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift))
    return rows.filter(good).select(*kept, whole.cast("array<long>").alias("x"))


def matrix(column: pa.Array, width: int, missing: int) -> np.ndarray:
    """Rows of a list column as int64, short ones filled up."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), missing, np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of integer matrices: by floating point where 53 bits hold every sum."""
    most = int(max(a.max(initial=0), -a.min(initial=0))) * int(max(b.max(initial=0), -b.min(initial=0))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b
    raise ValueError("sums of products beyond a long")


# ---------------------------------------------------------------- the spectrum


def above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above `shift`: positive signs of D in a
    completely pivoted LDL' (pivots of one or two rows) of a - shift."""
    m = a - shift * np.eye(len(a))
    positive, k = 0, 0
    while k < len(m):
        rest = m[k:, k:]
        diagonal = np.abs(np.diagonal(rest))
        one = int(diagonal.argmax())
        off = np.abs(np.tril(rest, -1))
        i, j = np.unravel_index(off.argmax(), off.shape)
        if max(diagonal[one], off[i, j]) == 0:
            break
        # the bound that keeps entries from growing, (1 + sqrt 17) / 8
        if diagonal[one] >= 0.6404 * off[i, j]:
            rest[[0, one]] = rest[[one, 0]]
            rest[:, [0, one]] = rest[:, [one, 0]]
            positive += bool(rest[0, 0] > 0)
            rest[1:, 1:] -= np.outer(rest[1:, 0] / rest[0, 0], rest[0, 1:])
            k += 1
        else:
            for to, frm in ((0, j), (1, i)):
                rest[[to, frm]] = rest[[frm, to]]
                rest[:, [to, frm]] = rest[:, [frm, to]]
            pivot = rest[:2, :2]
            positive += 1 if np.linalg.det(pivot) < 0 else 2 * bool(pivot[0, 0] > 0)
            rest[2:, 2:] -= rest[2:, :2] @ np.linalg.solve(pivot, rest[:2, 2:])
            k += 2
    return positive


def _slices(a: np.ndarray, k: int, top: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top down, of the k leading ones:
    one each and alone within three interval widths, or a cluster of equal ones."""
    found: list[tuple[float, float, int]] = []
    counted: dict[float, int] = {}

    def count(at: float) -> int:
        if at not in counted:
            counted[at] = above(a, at)
        return counted[at]

    todo = [(-1e-3 * top, 1.001 * top)]
    while todo and sum(n for *_, n in found) < k:
        low, high = todo.pop()
        n = count(low) - count(high)
        if not n:
            continue
        wide = high - low
        if wide <= 1e-12 * top or n == 1 and count(low - wide) - count(high + wide) == 1:
            found.append((low, high, n))
        else:
            middle = (low + high) / 2
            todo += [(low, middle), (middle, high)]
    return found


def _solve(a: np.ndarray, shift: float, x: np.ndarray, top: float) -> np.ndarray:
    try:
        return np.linalg.solve(a - shift * np.eye(len(a)), x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(a - (shift + 4 * np.finfo(float).eps * top) * np.eye(len(a)), x)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenvalues, fewer if the
    matrix has a lower rank; each number certified by inertia counts."""
    d = len(a)
    top = float(np.abs(a).sum(1).max()) if d else 0.0
    if top == 0:
        return np.zeros(0), np.zeros((d, 0))
    rng = np.random.default_rng(12)
    values, vectors = [], []
    for low, high, n in _slices(a, k, top):
        x = rng.standard_normal((d, n))
        for _ in range(4):  # inverse iteration from the middle of the interval
            x, _ = np.linalg.qr(_solve(a, (low + high) / 2, x, top))
        if n == 1:
            x = x[:, 0]
            least = np.inf
            for _ in range(12):
                e = float(x @ a @ x)
                residual = np.linalg.norm(a @ x - e * x)
                if not low <= e <= high:
                    e = (low + high) / 2
                elif residual >= least or residual <= np.finfo(float).eps * top:
                    break
                least = residual
                y = _solve(a, e, x, top)
                x = y / np.linalg.norm(y)
            x = x[:, None]
        for v in x.T:
            for _ in range(2):
                for u in vectors:
                    v = v - (u @ v) * u
                v = v / np.linalg.norm(v)
            vectors.append(v)
            values.append(float(v @ a @ v))
    order = sorted(range(len(values)), key=lambda i: -values[i])[:k]
    order = [i for i in order if values[i] > 8 * d * np.finfo(float).eps * top]
    for number, i in enumerate(order, 1):
        if not above(a, values[i] + 1e-9 * top) < number <= above(a, values[i] - 1e-9 * top):
            raise ArithmeticError(f"eigenvalue {number} is not certified")
    return np.array([values[i] for i in order]), np.array([vectors[i] for i in order]).reshape(-1, d).T


# -------------------------------------------------------------------- the fit


@dataclass
class Whitening:
    """n vectors, exact sums of their x, components (columns), eigenvalues, their
    share of the variance, and the largest deviation of whitened rows from the
    identity covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """Whole part of the mean of each dimension."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def left(self) -> list[int]:
        """What the sums are off n times the centre."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        fraction = np.array([r / self.n for r in self.left])
        return ((x - self.centre).astype(np.float64) - fraction) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)**2, exactly."""
        y, r = x - self.centre, self.left
        most = self.n * int(np.abs(y).max(initial=0)) + self.n
        if len(r) * most**2 < 1 << 63:
            z = self.n * y - np.array(r, np.int64)
            return (z * z).sum(1).tolist()
        z = self.n * y.astype(object) - np.array(r, object)
        return [t if t < 1 << 63 else None for t in (z * z).sum(1)]


def _sums(batches):
    """(dimension, sum, vectors that have it, largest size) of a task; -1 counts rows."""
    total, held, rows, largest = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    for batch in batches:
        x = batch.column(0)
        size = np.diff(x.offsets.to_numpy())
        width = max(len(total), int(size.max(initial=0)))
        total, held = np.pad(total, (0, width - len(total))), np.pad(held, (0, width - len(held)))
        m = matrix(x, width, 0)
        largest = max(largest, int(np.abs(m).max(initial=0)))
        total += m.sum(0)
        held += (size[:, None] > np.arange(width)).sum(0)
        rows += len(x)
    if rows:
        columns = np.append(np.arange(len(total)), -1), np.append(total, 0), np.append(held, rows), np.full(len(total) + 1, largest)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["dim", "total", "held", "largest"])


def _gram(centre: np.ndarray):
    """(i, j, sum of products) of a task's centred whole vectors, i <= j."""
    d = len(centre)
    i, j = np.triu_indices(d)

    def rows(g):
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], ["i", "j", "total"])

    def run(batches):
        total, bound = np.zeros((d, d), np.int64), 0
        for batch in batches:
            y = matrix(batch.column(0), d, SHIFT) - centre
            square = max(1, int(np.abs(y).max(initial=0)) ** 2)
            at_once = max(1, (1 << 62) // square)  # all rows but for huge entries
            for a in range(0, len(y), at_once):
                part = y[a : a + at_once]
                if bound + square * len(part) >= 1 << 63:
                    yield rows(total)
                    total, bound = np.zeros((d, d), np.int64), 0
                total += exact_product(part.T, part)
                bound += square * len(part)
        yield rows(total)

    return run


def _squares(model: Whitening):
    """(i, j, sum) of the whitened rows' products over a task; j = -1 sums rows."""
    k = len(model.values)

    def run(batches):
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = model.whiten(matrix(batch.column(0), len(model.sums), SHIFT))
            total += z.T @ z
            first += z.sum(0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array((j - 1).astype(np.int32)), pa.array(np.column_stack([first, total]).ravel())], ["i", "j", "total"])

    return run


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of the `x` column of `whole_vectors`; None without rows."""
    x = vectors.select("x")
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    sums = x.mapInArrow(_sums, "dim long, total long, held long, largest long").groupBy("dim").agg(exact, F.sum("held").alias("held"), F.max("largest").alias("largest"))
    of = {r.dim: r for r in sums.collect()}  # a row for each dimension
    if -1 not in of:
        return None
    n, d = of[-1].held, len(of) - 1
    if of[-1].largest > LARGEST * SCALE:
        raise ValueError(f"an entry beyond 2**20: {of[-1].largest}")
    model = Whitening(n, [int(of[i].total) + (n - of[i].held) * SHIFT for i in range(d)], np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    pairs = x.mapInArrow(_gram(model.centre), "i int, j int, total long").groupBy("i", "j").agg(exact).collect()  # a row for each pair of dimensions
    covariance, left = np.zeros((d, d)), model.left
    for p in pairs:
        covariance[p.i, p.j] = covariance[p.j, p.i] = (n * int(p.total) - left[p.i] * left[p.j]) / (n * n)
    model.values, model.vectors = leading(covariance, components)
    if len(model.values):
        model.explained = model.values / np.trace(covariance)
        k = len(model.values)
        seen, mean = np.zeros((k, k)), np.zeros(k)
        for p in x.mapInArrow(_squares(model), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
            if p.j < 0:
                mean[p.i] = p.total / n
            else:
                seen[p.i, p.j] = p.total / n
        model.identity_error = float(np.abs(seen - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(embeddings: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`key` and SCHEMA: a row for each finite vector and component."""
    vectors = whole_vectors(embeddings, column, SCALE, SHIFT, F.col(key))
    kind = embeddings.schema[key].dataType.simpleString()
    model = fit(vectors, components)

    def run(batches):
        k = len(model.values)
        for batch in batches:
            x = matrix(batch.column(1), len(model.sums), SHIFT)
            rows = np.repeat(np.arange(len(x)), k)
            number = np.tile(np.arange(k), len(x))
            columns = [batch.column(0).take(pa.array(rows)), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(rows), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(rows))]
            columns += [pa.array(model.whiten(x).ravel()), pa.array(model.explained[number]), pa.array(np.full(len(rows), model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"`{key}` {kind}, {SCHEMA}"
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(run, schema)
