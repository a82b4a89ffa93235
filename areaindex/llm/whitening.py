"""Whitening of embeddings by spectrum slicing.

Spark sums the fit list: exact integer sums first, then the covariance of the centred vectors.  The covariance
has as many cells as the dimension squared, whatever the number of rows, and goes to the driver.  There an
LDL' factorisation of the covariance less a shift gives its inertia, which counts the eigenvalues above the
shift.  Bisection by such counts isolates each leading eigenvalue, Rayleigh quotient iteration then converges
cubically, and counts on both sides of what it found certify its number.  Tasks project the rows.

Eigenvalues that doubles can't tell apart share their counts.  Each vector is kept orthogonal to those before
it, so equal eigenvalues get a basis of their space.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those of another
length than the most frequent one (ties: the longest), nor empty ones.  A null vec_id stays null, repeated rows
count each.  Components whose eigenvalue can't be told from zero are left out, as they can't be scaled: one row
alone, or equal rows, have no components, and such a table, like an empty one, gives no rows.  Entries whose
floor(64 * c) is beyond 2^31 are an error, and so is a deviation beyond a long.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import rebatch

#: Fixed values of the contract.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = 1 << 31

EPS = float(np.finfo(np.float64).eps)


# The spectrum of one symmetric matrix.


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive ones of D in
    P(A - shift I)P' = LDL', with pivots of one row or two, chosen for bounded growth."""
    a = matrix - shift * np.eye(len(matrix))
    growth = (1 + 17**0.5) / 8
    positive, k, n = 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        # Complete pivoting: the largest diagonal entry, or the block of the largest entry beside it.
        rest = np.abs(a[k:, k:])
        diagonal = rest.diagonal().copy()
        np.fill_diagonal(rest, -1.0)
        d = int(diagonal.argmax())
        i, j = divmod(int(rest.argmax()), n - k) if n - k > 1 else (0, 0)
        if diagonal[d] == 0 and (n - k == 1 or rest[i, j] <= 0):
            break  # what is left is zero, and so are its eigenvalues
        if n - k == 1 or diagonal[d] >= growth * rest[i, j]:
            swap(k, k + d)
            pivot = a[k, k]
            positive += pivot > 0
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
            k += 1
        else:
            low, high = sorted((i, j))
            swap(k, k + low)
            swap(k + 1, k + high)
            block, columns = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            positive += 1  # such a block has an eigenvalue of each sign
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(block, columns.T)
            k += 2
    return int(positive)


def _rayleigh(matrix: np.ndarray, low: float, high: float, tolerance: float, found: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the eigenvalue between ``low`` and ``high``, orthogonal to the vectors
    found before; None where it does not settle there."""
    n, middle = len(matrix), (low + high) / 2

    def normal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    v, shift, settled = normal(np.random.default_rng(len(found)).normal(size=n)), middle, None
    for step in range(16):
        try:
            v = normal(np.linalg.solve(matrix - shift * np.eye(n), v))
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            v = normal(np.linalg.solve(matrix - (shift + tolerance) * np.eye(n), v))
        quotient = float(v @ matrix @ v)
        inside = low - tolerance <= quotient <= high + tolerance
        residual = float(np.linalg.norm(matrix @ v - quotient * v))
        if settled and residual >= settled[0]:
            break
        if inside and residual <= tolerance:
            settled = residual, quotient, v  # go on while it still gets better
        # Two steps at the middle turn towards the nearest eigenvalue; a quotient outside is another one's.
        shift = quotient if inside and step > 1 else middle
    return settled[1:] if settled else None


def leading_spectrum(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as rows; eigenvalues that can't be told from
    zero are left out."""
    n = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    tolerance = 4 * n * EPS * bound
    values, vectors = np.zeros(0), np.zeros((0, n))
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = inertia_above(matrix, shift)
        return counted[shift]

    for k in range(1, (min(components, above(tolerance)) if bound else 0) + 1):
        # At least k eigenvalues lie above low and fewer than k above high; earlier counts narrow the start.
        low = max((s for s, c in counted.items() if c >= k), default=tolerance)
        high = min((s for s, c in counted.items() if c < k), default=bound + tolerance)
        while True:
            if (above(low), above(high)) == (k, k - 1) or high - low <= tolerance:
                found = _rayleigh(matrix, low, high, tolerance, vectors)
                # Counts certify the number: k eigenvalues or more from here up, fewer beyond.
                if found and above(found[0] - 2 * tolerance) >= k > above(found[0] + 2 * tolerance):
                    break
            middle = (low + high) / 2
            if middle in (low, high):
                raise ArithmeticError(f"eigenvalue {k} is not certified")
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        values, vectors = np.append(values, found[0]), np.vstack([vectors, found[1]])
    return values, vectors


# The rows.


def _matrix(batch: pa.RecordBatch, dimension: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(SCALE * c), as doubles without the offset, of vectors of one length."""
    lists = batch.column("vector")
    values = lists.flatten().to_numpy().reshape(-1, dimension)
    y = np.floor(SCALE * values)
    if len(y) and np.abs(y).max() > LARGEST:
        raise OverflowError("an entry beyond 2^31 / 64")
    return batch.column("vec_id"), y


def _sums(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """Rows and exact sums of a partition; a batch of at most a million rows sums below 2^53."""
    total, n = np.zeros(dimension, np.int64), 0
    for batch in rebatch(batches):
        _, y = _matrix(batch, dimension)
        total += y.astype(np.int64).sum(axis=0)
        n += len(y)
    yield pa.RecordBatch.from_pydict({"place": np.arange(dimension + 1), "value": np.append(total, n)})


def _moments(batches: Iterator[pa.RecordBatch], dimension: int, centre: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the centred rows of a partition, projected on ``vectors``, and of their products."""
    size = len(vectors)
    first, second = np.zeros(size), np.zeros((size, size))
    for batch in rebatch(batches):
        z = (_matrix(batch, dimension)[1] - centre) @ vectors.T
        first += z.sum(axis=0)
        second += z.T @ z
    yield pa.RecordBatch.from_pydict({"place": np.arange(size + size * size), "value": np.append(first, second)})


def _gather(df: DataFrame) -> list:
    """Sums over the partitions' rows (place, value), by place; the places are as many as cells of a matrix."""
    return [r["value"] for r in df.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()]


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of (n * x - S)^2, exact; the offset is in both and drops out."""
    far = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if far * far * len(sums) < 1 << 63:
        away = n * y.astype(np.int64) - np.array(sums, np.int64)
        return (away * away).sum(axis=1)
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in y.tolist()]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation beyond a long")
    return np.array(exact, np.int64)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(batches, dimension, n, sums, centre, vectors, explained, error):
    size = len(vectors)
    for batch in rebatch(batches, 1 << 20):
        ids, y = _matrix(batch, dimension)
        rows = len(y)
        yield pa.RecordBatch.from_arrays(
            [
                pc.take(ids, pa.array(np.repeat(np.arange(rows), size))),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * size, n, np.int64)),
                pa.array(np.repeat(_deviations(y, n, sums), size)),
                pa.array(((y - centre) @ vectors.T).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * size, error)),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and ``vector``, doubles, of the rows whose vector has entries and none that is null or not finite."""
    limit = F.lit(float("inf"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == limit))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings[column].cast("array<double>").alias("vector"))
    return rows.where((F.size("vector") > 0) & ~odd)


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_vectors(embeddings, column)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = embeddings.sparkSession.createDataFrame([], WHITENED)
    if sizes is None:
        return empty
    d = sizes["d"]
    rows = rows.where(F.size("vector") == d)
    *sums, n = _gather(rows.mapInArrow(lambda it: _sums(it, d), "place long, value long"))
    # S/n to the nearest double, from exact whole numbers.
    centre = np.array([s // n + (s % n) / n for s in sums])

    def covariance(vectors: np.ndarray) -> np.ndarray:
        """Of the rows projected on ``vectors``, centred before multiplying and once more after."""
        size = len(vectors)
        found = np.array(_gather(rows.mapInArrow(lambda it: _moments(it, d, centre, vectors), "place long, value double"))) / n
        out = found[size:].reshape(size, size) - np.outer(found[:size], found[:size])
        return (out + out.T) / 2

    of_fit = covariance(np.eye(d))
    values, axes = leading_spectrum(of_fit, components)
    if not len(values):
        return empty
    scaled = axes / np.sqrt(values)[:, None]
    explained = values / np.trace(of_fit)
    # From the rows that are returned.
    error = float(np.abs(covariance(scaled) - np.eye(len(values))).max())
    return rows.mapInArrow(lambda it: _whiten(it, d, n, sums, centre, scaled, explained, error), WHITENED)
