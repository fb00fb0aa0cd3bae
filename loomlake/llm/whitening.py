"""Whitening of embeddings by principal components, found with FEAST contour integration.

Rows are made whole numbers, each different vector counts once, and sums and the centred covariance are added up by Spark from
one small matrix a task. The covariance (dimensions squared) is the only thing the driver sees. There:

* inertia counts (signs of the pivots of a shifted symmetric factorisation) say how many eigenvalues lie above any number, so
  intervals that hold the largest ones are found by bisection, with borders in gaps;
* for each interval, a quadrature of complex shifted solves along a circle through its borders projects a random
  block onto the interval's eigenvectors, Rayleigh-Ritz extracts them, and both are repeated until residuals are at rounding;
* the number found must be the inertia count, or the interval is solved again with a larger block; nothing is missed unnoticed.

Whitened rows are then projected in Arrow batches, and the covariance of the whitened fit list is measured in one more pass.

Defined cases: a row goes if its vector is null or has a null or non-finite entry, or an entry that 64 times exceeds 2**62, or if it has another length than
most remaining rows (ties: the longer); rows that repeat an id all come back; null ids stay null; an empty table, or vectors of length 0, give no rows; eigenvalues
not above 1e-12 of the largest (all of a single vector's) give no component, since nothing can be divided by them;
of equal eigenvalues any orthonormal vectors are taken. `deviation` is null where it exceeds a long (n * n * distance over 2**63); `deviation_exact`
has it as text at any size. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, portable, shared_dir, stored

portable(__name__)

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Eigenvalues up to this part of the largest count as zero.
FLAT = 1e-12
#: Eigenvalues that one contour encloses, if they can be told apart, and nodes on its upper half.
INSIDE, NODES = 8, 8


def fixed_point(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry, in whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < F.lit(2.0**62)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x - mean, the mean given as whole numbers and parts of one, so nothing large is rounded."""
    return (x - whole).astype(np.float64) - part


def summed(df: DataFrame, rows_of: Callable, d: int) -> np.ndarray:
    """The sum over all rows of the d x m matrix that `rows_of` makes of a batch; tasks add up their own first."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = rows_of(matrix(batch.column("x"), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = df.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # as many as the matrix has
    out = np.zeros((max((c["i"] for c in cells), default=-1) + 1, max((c["j"] for c in cells), default=-1) + 1))
    for c in cells:
        out[c["i"], c["j"]] = c["v"]
    return out


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and exact sums of each dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column("x"), d)
            n += len(x)
            small = len(x) and np.abs(x.astype(np.float64)).max() * len(x) < 2**62
            sums = x.sum(axis=0) if small else x.astype(object).sum(axis=0) if len(x) else [0] * d
            total = [a + int(b) for a, b in zip(total, sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(d)]


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than `shift`: positive pivots of a - shift.

    Pivots are single entries of the diagonal or, where those are small, blocks of two (one positive, one negative).
    """
    m = a - shift * np.eye(len(a))
    count = 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        r, c = np.unravel_index(int(off.argmax()), off.shape) if len(m) > 1 else (0, 0)
        if len(m) == 1 or diagonal[p] >= 0.64 * off[r, c]:
            if diagonal[p] == 0:
                break
            pivot = m[p, p]
            count += pivot > 0
            rest = np.delete(np.arange(len(m)), p)
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, p], m[p, rest]) / pivot
        else:
            count += 1
            rest = np.delete(np.arange(len(m)), [r, c])
            block = m[np.ix_([r, c], [r, c])]
            m = m[np.ix_(rest, rest)] - m[np.ix_(rest, [r, c])] @ np.linalg.solve(block, m[np.ix_([r, c], rest)])
    return int(count)


def border(a: np.ndarray, low: float, high: float, least: int, most: int, scale: float) -> float | None:
    """A number in (low, high) with `least` to `most` eigenvalues above it and none within reach of rounding; None if there is none to be told apart."""
    for _ in range(200):
        middle = (low + high) / 2
        n = above(a, middle)
        if n < least:
            high = middle
        elif n > most:
            low = middle
        else:
            for t in (0.5, 0.35, 0.65, 0.2, 0.8, 0.05, 0.95):
                x = low + t * (high - low)
                near = 1e-9 * scale
                if least <= (n := above(a, x)) <= most and above(a, x - near) == n == above(a, x + near):
                    return x
            # An eigenvalue is close to each of these: look on both sides of the middle.
            up, down = above(a, (middle + high) / 2), above(a, (low + middle) / 2)
            if least <= up <= most:
                low = middle
            elif least <= down <= most:
                high = middle
            else:
                return None
        if high - low < 1e-12 * scale:
            return None
    return None


def intervals(a: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down; together they hold the k largest at least."""
    d, size = len(a), float(np.abs(a).sum(axis=1).max())
    top, bottom = size * 1.01, -size * 1.01
    # The lowest border: as few below the k-th as can be told apart, at worst all.
    low = None
    for most in [m for m in (k, k + 4, 2 * k, 4 * k, 8 * k) if m < d]:
        low = border(a, bottom, top, k, most, size)
        if low is not None:
            break
    low = bottom if low is None else low
    todo, done = [(low, top, above(a, low))], []
    while todo:
        lo, hi, n = todo.pop()
        over = above(a, hi)
        cut = border(a, lo, hi, over + 1, over + n - 1, size) if n > INSIDE else None
        if cut is None:
            done.append((lo, hi, n))
        else:
            inside = above(a, cut) - over
            todo += [(lo, cut, n - inside), (cut, hi, inside)]
    return sorted((x for x in done if x[2]), reverse=True)


def feast(a: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors in (low, high), of which inertia says there are `count`."""
    d, scale = len(a), float(np.abs(a).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    angles = np.pi * (nodes + 1) / 2
    points, eye = centre + radius * np.exp(1j * angles), np.eye(d)
    for extra in (4, 16, d):
        size = min(d, count + max(extra, count // 2))
        y = np.random.default_rng(seed).standard_normal((d, size))
        best = None
        for _ in range(30):
            q = np.zeros((d, size))
            for z, angle, w in zip(points, angles, weights, strict=True):
                q += w / 2 * np.real(radius * np.exp(1j * angle) * np.linalg.solve(z * eye - a, y.astype(complex)))
            u, s, _ = np.linalg.svd(q, full_matrices=False)
            basis = u[:, s > 1e-14 * s[0]]
            small = basis.T @ a @ basis
            values, inner = np.linalg.eigh((small + small.T) / 2)
            vectors = basis @ inner
            inside = (values > low) & (values < high)
            left = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            worst = left.max(initial=0.0)
            if inside.sum() == count and worst <= 1e-13 * scale and best is not None and worst >= best / 2:
                return values[inside], vectors[:, inside]
            best = worst if inside.sum() == count else None
            y = vectors if vectors.shape[1] == size else np.hstack([vectors, np.random.default_rng(seed + 1).standard_normal((d, size - vectors.shape[1]))])
        if best is not None and best <= 1e-12 * scale:
            return values[inside], vectors[:, inside]
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found between {low} and {high}")


def components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns."""
    if not v.size or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scale = float(np.abs(v).max())
    a = v / scale
    found = [feast(a, *x) for x in intervals(a, min(k, len(a)))]
    # Vectors of neighbouring intervals are made orthogonal to rounding by one extraction from all of them.
    basis, _ = np.linalg.qr(np.hstack([x[1] for x in found]))
    small = basis.T @ a @ basis
    values, inner = np.linalg.eigh((small + small.T) / 2)
    by = np.argsort(-values)[:k]
    by = by[values[by] > FLAT * values.max()]
    return values[by] * scale, (basis @ inner)[:, by]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - S)**2."""
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if most < 2**61:
        d = n * x - np.array(sums, np.int64)
        rough = (d.astype(np.float64) ** 2).sum(axis=1)
        exact = (d * d).sum(axis=1).tolist()  # wraps only in rows that are counted again below
        return [e if r < 2**62 else sum(int(c) ** 2 for c in row) for e, r, row in zip(exact, rough.tolist(), d, strict=True)]
    return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (and deviation_exact) of each row and component."""
    spark, folder = embeddings.sparkSession, shared_dir(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == d).select("vec_id", fixed_point(F.col("v")).alias("x"))
    fit = stored(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), folder, "fit")
    n, sums = totals(fit, d)
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n / n for s in sums])

    def outer(x):
        c = centred(x, whole, part)
        return c.T @ c

    v = summed(fit, outer, d) / n
    values, vectors = components((v + v.T) / 2, k)
    if not len(values):
        return spark.createDataFrame([], schema)
    project = vectors / np.sqrt(values)

    def outer_whitened(x):
        z = centred(x, whole, part) @ project
        return z.T @ z

    error = float(np.abs(summed(fit, outer_whitened, d) / n - np.eye(len(values))).max())
    explained = values / np.trace(v)
    m = len(values)

    def make():
        def step(batch):
            x = matrix(batch.column("x"), d)
            exact = deviations(x, n, sums)
            z = centred(x, whole, part) @ project
            again = pa.array(np.repeat(np.arange(len(x)), m))
            fits = [e if e < 2**63 else None for e in exact]
            columns = [batch.column("vec_id"), pa.array(fits, pa.int64()), pa.array(map(str, exact), pa.string())]
            ids, near, text = (c.take(again) for c in columns)
            per = [np.tile(c, len(x)) for c in (np.arange(1, m + 1, dtype=np.int32), explained)]
            total = len(again)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(per[0]), pa.array(np.full(total, n)), near, pa.array(z.ravel()), pa.array(per[1]), pa.array(np.full(total, error)), text],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

        return step

    return map_batches(rows, make, schema)
