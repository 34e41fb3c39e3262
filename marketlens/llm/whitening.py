"""Embedding whitening from the exact characteristic polynomial.

Vectors count as whole numbers, so the scatter of the distinct vectors is an integer matrix
M = n * sum(x x') - S S', and the covariance is M / n^2. Then

1. the characteristic polynomial of M is found modulo many primes, each by Hessenberg
   reduction; Spark deals the primes to its tasks, and Chinese remaindering joins the
   residues to the exact coefficients. All roots are real and none is negative, so
   Maclaurin's inequality bounds the coefficients by the trace and says how many primes
   are needed;
2. the largest roots are isolated: by Descartes' rule the changes of sign of p(x + a) are
   exactly the roots above a, repeated ones included. A root that stands alone is refined
   by the sign of p, to some 150 bits;
3. a component is the null space of M minus its root, found by inverse iteration with 100
   digits, orthogonal to the components before it.

What reaches the driver is one matrix (dimensions squared) and the residues (dimensions
times primes, whose number grows with the dimensions and the logarithm of the rows), never
rows. The distinct vectors are packed in as few bytes as they need before they are shuffled.

Defined results: components of vectors count as ``floor(256 * x)`` in double precision,
cut at 2^62; a vector that is null or holds a null or non-finite entry takes no part; rows
with a null or repeated id are kept, each as a row of its own; vectors of other lengths
have a fit of their own, empty ones no rows; equal eigenvalues take any orthonormal basis;
a component with eigenvalue 0 can't be scaled and is left out, so one lone vector gets no
rows; a deviation beyond 64 bits is null; sums of products must fit 38 digits; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

COMPONENTS = 4
#: Bits of a root, digits of an inverse iteration, primes of one task.
ROOT_BITS, DIGITS, PRIMES_PER_TASK = 192, 100, 16
#: Products of two limbs of so many bits, summed over so many rows, are exact in doubles.
_LIMB, _ROWS = 18, 1 << 14
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _whole(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, whole numbers)`` for every length among the lists."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.clip(np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False)), -(2.0**62), 2.0**62).astype(np.int64)
    ends = np.cumsum(lengths)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``dim, x``: every distinct vector once, packed in the narrowest integers that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data in _whole(batch.column(0)):
                dim = data.shape[1]
                width = np.zeros(len(data), np.int8)
                for i, kind in enumerate(_WIDTHS[:-1]):
                    width[(data < np.iinfo(kind).min).any(axis=1) | (data > np.iinfo(kind).max).any(axis=1)] = i + 1
                for i in np.unique(width).tolist():
                    packed = np.ascontiguousarray(data[width == i].astype(_WIDTHS[i]))
                    rows = [pa.array([dim] * len(packed), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(rows, names=["dim", "x"])

    return usable(vectors).select("embedding").mapInArrow(run, "dim int, x binary").distinct()


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    dims, lengths = batch.column("dim").to_numpy(), np.diff(np.frombuffer(batch.column("x").buffers()[1], np.int32)[batch.column("x").offset :][: len(batch) + 1])
    packed = batch.column("x").to_pylist()
    for dim, length in {(int(d), int(n)) for d, n in zip(dims, lengths)}:
        at = np.flatnonzero((dims == dim) & (lengths == length))
        kind = {np.dtype(k).itemsize: k for k in _WIDTHS}[length // dim]
        yield np.frombuffer(b"".join(packed[i] for i in at), kind).reshape(len(at), dim).astype(np.int64)


def _limbs(data: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2^18 more than the one before, is the data."""
    out = []
    while True:
        if np.abs(data).max(initial=0) < 1 << _LIMB:
            return [*out, data.astype(float)]
        out.append((data & ((1 << _LIMB) - 1)).astype(float))
        data = data >> _LIMB


def _exact(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).astype(object)


def products(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of the columns, as Python integers."""
    sums, squares = np.zeros(data.shape[1], object), np.zeros((data.shape[1],) * 2, object)
    for start in range(0, len(data), _ROWS):
        limbs = _limbs(data[start : start + _ROWS])
        for a, x in enumerate(limbs):
            sums += _exact(x.sum(axis=0)) << (_LIMB * a)
            for b, y in enumerate(limbs):
                squares += _exact(x.T @ y) << (_LIMB * (a + b))
    return sums, squares


def moments(distinct: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """``{length: (n, S, M)}`` of the distinct vectors; sums are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for data in _unpacked(batch):
                dim = data.shape[1]
                held = found.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
                sums, squares = products(data)
                held[0], held[1], held[2] = held[0] + len(data), held[1] + sums, held[2] + squares
        for dim, (n, sums, squares) in found.items():
            values = [n, *sums, *squares[np.triu_indices(dim)]]
            columns = [pa.array([dim] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "place", "value"])

    rows = distinct.mapInArrow(run, "dim int, place int, value decimal(38,0)").groupBy("dim", "place").agg(F.sum("value").alias("value")).collect()
    out = {}
    for dim in sorted({r.dim for r in rows}):
        values = [int(v) for _, v in sorted((r.place, r.value) for r in rows if r.dim == dim)]
        n, sums = values[0], values[1 : dim + 1]
        matrix = np.zeros((dim, dim), object)
        matrix[np.triu_indices(dim)] = values[dim + 1 :]
        matrix = np.triu(matrix) + np.triu(matrix, 1).T
        out[dim] = n, sums, n * matrix - np.outer(np.array(sums, object), np.array(sums, object))
    return out


# The characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product is above ``bound``."""
    out, total, n = [], 1, 2**31 - 1
    while total <= bound:
        if _is_prime(n):
            out.append(n)
            total *= n
        n -= 2
    return out


def residues(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients (prime, power) of det(x - matrix) modulo each prime, for all primes at once."""
    d, q = len(matrix), len(primes)
    a = np.stack([(matrix % int(p)).astype(np.int64) for p in primes])
    p1, p2 = primes[:, None], primes[:, None, None]
    every = np.arange(q)
    for m in range(1, d - 1):
        pivot = m + np.argmax(a[:, m:, m - 1] != 0, axis=1)
        kept = a[every, pivot].copy()
        a[every, pivot], a[:, m] = a[:, m].copy(), kept
        kept = a[every, :, pivot].copy()
        a[every, :, pivot], a[:, :, m] = a[:, :, m].copy(), kept
        inverse = np.array([pow(int(x), -1, int(p)) if x else 0 for x, p in zip(a[:, m, m - 1], primes)])
        u = a[:, m + 1 :, m - 1] * inverse[:, None] % p1
        a[:, m + 1 :] = (a[:, m + 1 :] - u[:, :, None] * a[:, m, None, :] % p2) % p2
        a[:, :, m] = (a[:, :, m] + (a[:, :, m + 1 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    # of the leading blocks of the Hessenberg matrix, one after the other
    polys = np.zeros((d + 1, q, d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(d):
        new = -a[:, k, k, None] * polys[k] % p1
        new[:, 1:] += polys[k][:, :-1]
        below = np.ones(q, np.int64)
        for i in range(1, k + 1):
            below = below * a[:, k - i + 1, k - i] % primes
            new = (new - (a[:, k - i, k] * below % primes)[:, None] * polys[k - i] % p1) % p1
        polys[k + 1] = new % p1
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - matrix), by rising power; the matrix is positive semidefinite."""
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_numpy()
            for start in range(0, len(some), PRIMES_PER_TASK):
                part = some[start : start + PRIMES_PER_TASK]
                found = residues(matrix, part)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["prime", "residues"])

    tasks = -(-len(primes) // PRIMES_PER_TASK)
    dealt = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(tasks)
    found = dealt.mapInArrow(run, "prime bigint, residues array<bigint>").collect()
    whole = prod(r.prime for r in found)
    out = [0] * (d + 1)
    for r in found:
        rest = whole // r.prime
        one = rest * pow(rest, -1, r.prime)
        out = [x + c * one for x, c in zip(out, r.residues)]
    out = [x % whole for x in out]
    return [x - whole if x > whole // 2 else x for x in out]


# Roots and components


def roots_above(poly: list[int], point: int) -> int:
    """How many roots of a polynomial with real roots only are above the point, repeated ones included."""
    shifted = poly.copy()
    for i in range(len(poly) - 1):
        for k in range(len(poly) - 2, i - 1, -1):
            shifted[k] += point * shifted[k + 1]
    signs = [x > 0 for x in shifted if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], bound: int, k: int) -> tuple[list[int], int]:
    """The k largest roots above 0 (fewer, if there are fewer), times 2^shift, and the shift."""
    d, shift = len(poly) - 1, max(0, ROOT_BITS - bound.bit_length())
    scaled = [c << (shift * (d - i)) for i, c in enumerate(poly)]
    counts = {0: roots_above(scaled, 0), (top := (bound + 1) << shift): 0}

    def above(x: int) -> int:
        if x not in counts:
            counts[x] = roots_above(scaled, x)
        return counts[x]

    def sign(x: int) -> int:
        value = 0
        for c in reversed(scaled):
            value = value * x + c
        return (value > 0) - (value < 0)

    out = []
    for j in range(1, min(k, counts[0]) + 1):
        low = max(x for x, n in counts.items() if n >= j)
        high = min(x for x, n in counts.items() if n < j and x > low)
        while high - low > 1 and not (counts[low] == j and counts[high] == j - 1):
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) >= j else (low, middle)
        while high - low > 1:  # one root in here, so the sign is that of -1 to the number of roots above
            middle = (low + high) // 2
            value = sign(middle)
            low, high = (low, middle) if value in (0, (-1) ** (j - 1)) else (middle, high)
            if value == 0:
                break
        out.append(high)
    return out, shift


def component(matrix: np.ndarray, root: Decimal, before: list[np.ndarray]) -> np.ndarray:
    """A unit vector of the null space of ``matrix - root``, orthogonal to the ones before; in the current decimal context."""
    d, tiny = len(matrix), Decimal(10) ** -(DIGITS - 10)
    a = matrix - root * np.array([[Decimal(int(i == j)) for j in range(d)] for i in range(d)], object)
    scale = max(abs(x) for x in a.ravel()) or Decimal(1)
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if abs(a[k, k]) < scale * tiny:
            a[k, k] = scale * tiny
        if k + 1 < d:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
    seed = 12345 + len(before)
    best = None
    for _ in range(5):  # a start may lack the component, which its residual tells
        x = np.empty(d, object)
        for i in range(d):
            seed = (1103515245 * seed + 12345) % 2**31
            x[i] = Decimal(seed - 2**30)
        for _ in range(4):
            y = x[order]
            for k in range(1, d):
                y[k] = y[k] - y[:k].dot(a[k, :k])
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - (y[k + 1 :].dot(a[k, k + 1 :]) if k + 1 < d else 0)) / a[k, k]
            y = y / max(abs(v) for v in y)
            for b in [*before, *before]:
                y = y - b * b.dot(y)
            x = y / y.dot(y).sqrt()
        off = max(abs(v) for v in matrix.dot(x) - root * x)
        if best is None or off < best[0]:
            best = off, x
        if off < scale * Decimal(10) ** -25:
            break
    return best[1]


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: their number and sums, eigenvalues and unit eigenvectors of the covariance."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float]

    def whitened(self, data: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (data - mean) @ self.vectors.T / np.sqrt(np.array(self.values))

    def deviations(self, data: np.ndarray) -> list[int | None]:
        """Sums of ``(n * x - S)^2``: in integers modulo 2^64, exact wherever they fit."""
        n, sums = np.uint64(self.n % 2**64), np.array([s % 2**64 for s in self.sums], np.uint64)
        off = data.astype(np.uint64) * n - sums
        exact = (off * off).sum(axis=1).astype(np.int64).tolist()
        about = ((data.astype(float) * self.n - np.array([float(s) for s in self.sums])) ** 2).sum(axis=1)
        for i in np.flatnonzero(about > 0.99 * 2**63).tolist():
            true = sum((self.n * int(x) - s) ** 2 for x, s in zip(data[i], self.sums))
            exact[i] = true if true < 2**63 else None
        return exact


def fit(spark: SparkSession, distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for every length of vectors."""
    out = {}
    for dim, (n, sums, matrix) in moments(distinct).items():
        trace = int(sum(matrix.diagonal()))
        if not trace:
            continue
        roots, shift = largest_roots(characteristic_polynomial(spark, matrix), trace, components)
        with localcontext(Context(prec=DIGITS)):
            decimals = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
            vectors = []
            for r in roots:
                vectors.append(component(decimals, Decimal(r) / Decimal(2) ** shift, vectors))
            values = [float(Decimal(r) / Decimal(2) ** shift / Decimal(n) ** 2) for r in roots]
            explained = [float(Decimal(r) / Decimal(2) ** shift / Decimal(trace)) for r in roots]
        out[dim] = Fit(n, sums, values, np.array([[float(x) for x in v] for v in vectors]), explained)
    return out


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For every length, the largest entry by which the covariance of the whitened distinct vectors misses the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for data in _unpacked(batch):
                if (dim := data.shape[1]) in fits:
                    w = fits[dim].whitened(data)
                    w = np.hstack([w, np.ones((len(w), 1))])
                    found[dim] = found.get(dim, 0) + w.T @ w
        for dim, sums in found.items():
            values = sums.ravel()
            columns = [pa.array([dim] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "place", "value"])

    rows = distinct.mapInArrow(run, "dim int, place int, value double").groupBy("dim", "place").agg(F.sum("value").alias("value")).collect()
    out = {}
    for dim, model in fits.items():
        k = len(model.values)
        sums = np.array([v for _, v in sorted((r.place, r.value) for r in rows if r.dim == dim)]).reshape(k + 1, k + 1) / model.n
        out[dim] = float(np.abs(sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k]) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component."""
    spark = vectors.sparkSession
    distinct = scratch_table(distinct_vectors(vectors), "distinct-vectors")
    fits = fit(spark, distinct, components)
    errors = identity_errors(distinct, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, data in _whole(batch.column(1)):
                if (model := fits.get(data.shape[1])) is None:
                    continue
                k, m = len(model.values), len(rows)
                deviation = pa.array(model.deviations(data), pa.int64())
                again = pa.array(np.repeat(np.arange(m), k))
                columns = [ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)), deviation.take(again)]
                columns += [pa.array(model.whitened(data).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, errors[data.shape[1]]))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors).mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(Tables(spark, folder).embeddings)
