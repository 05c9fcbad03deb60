"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Entries become integers, so that the scatter n * sum(x x^T) - S S^T over the distinct vectors is an exact integer matrix M
(n^2 times the covariance). Then

1. the characteristic polynomial of M modulo many 31-bit primes, one row per prime: similarity transforms bring M to
   Hessenberg form, whose polynomial follows by recurrence;
2. Chinese remaindering of the residues. M is positive semidefinite, so that the k-th coefficient has the sign (-1)^k and is at most
   C(d, k) (trace / d)^k; primes are taken until their product is larger;
3. isolation of the largest eigenvalues. All roots are real, so that Descartes' rule is exact: the sign changes of p(x + t) are
   the roots above t, with multiplicity. Bisection over integer multiples of a power of two narrows every root to ``ROOT_BITS`` bits;
   roots that are still together are one root with a multiplicity;
4. inverse iteration, one row per root, in fixed point: (M - e I) z = v solved by elimination with pivots, repeated
   and made orthonormal. A multiple root gives as many orthonormal vectors of its null space.

What reaches the driver is bounded by the dimension d: the d(d+1)/2 sums of the scatter, residues of d coefficients per prime,
``components`` vectors.

Defined cases. Vectors that are null or empty, or hold null, NaN, infinite or (as integers) more than 62-bit entries, are dropped; of
vectors of several lengths the most frequent length is kept (the longer of equal ones). Repeated vectors count once in the fit
and are all returned; repeated or null ids are kept. Roots of zero have no whitened direction and no rows, so that a table with fewer than
two different vectors gives none. Components of equal roots are any orthonormal basis, the same for all rows. Other columns of
the input do not reach the result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.llm.common import map_batches, materialised, pieces, ship

COMPONENTS = 16
#: x = floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Bits of a root beyond its first, and of the fractions of fixed-point numbers beyond those of the matrix.
ROOT_BITS = 128
FRACTION_BITS = 192
#: Solves of the inverse iteration; each gains the ratio of a root's error to its distance from the next.
SOLVES = 4
#: Sums travel as high * HALF + low.
HALF = 10**18


def clean_vectors(embeddings: DataFrame, id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v): usable vectors as doubles, all of one length, and that length (1 without any)."""
    v = F.col("v")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 56))))
    rows = embeddings.select(F.col(id).alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") > 0) & usable)
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "d")).alias("m")).first()["m"]
    d = length["d"] if length else 1
    return rows.where(F.size("v") == d), d


def _matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """Integer vectors of a batch, without the shift."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(batch.num_rows, -1)).astype(np.int64)


def _short(y: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it: equal vectors have equal bytes."""
    most = max(-int(y.min()), int(y.max()) + 1)
    kind = "<i1" if most <= 1 << 7 else "<i2" if most <= 1 << 15 else "<i4" if most <= 1 << 31 else "<i8"
    return y.astype(kind).tobytes()


def _long(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{len(raw) // d}").astype(np.int64)


def distinct_vectors(clean: DataFrame) -> DataFrame:
    """(y): each distinct integer vector once, packed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_short(y) for y in _matrix(batch)], pa.binary())], names=["y"])

    return map_batches(clean.select("v"), run, "y binary").distinct()


def _exact(a: np.ndarray) -> np.ndarray:
    """a^T a in Python integers, by floating-point products where those are exact."""
    most = int(np.abs(a).max(initial=0)) + 1
    if most * most * len(a) < 1 << 52:
        f = a.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(a) < 1 << 62:
        return (a.T @ a).astype(object)
    o = a.astype(object)
    return o.T.dot(o)


def _cells(total: np.ndarray, *values: Callable) -> pa.RecordBatch:
    """Lower triangle of a matrix as rows (i, j, values)."""
    i, j = np.tril_indices(len(total))
    columns = [pa.array([f(x) for x in total[i, j]]) for f in values]
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *columns], names=["i", "j", "high", "low"][: 2 + len(values)])


@dataclass(frozen=True)
class Scatter:
    """Count, sums and n^2 times the covariance of the distinct integer vectors (without the shift), in Python integers."""

    n: int
    sums: list[int]
    m: list[list[int]]


def scatter(distinct: DataFrame, d: int) -> Scatter:
    """Exact scatter: every task hands on one sum per pair of dimensions, which Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            for part in pieces(batch, 4096):
                a = np.stack([_long(y, d) for y in part.column("y").to_pylist()])
                total = total + _exact(np.concatenate([np.ones((len(a), 1), dtype=np.int64), a], axis=1))
        yield _cells(total, lambda x: str(int(x) // HALF), lambda x: str(int(x) % HALF))

    # Sums of products outgrow decimals: they are added in two halves.
    cells = distinct.mapInArrow(run, "i int, j int, high string, low string").groupBy("i", "j")
    halves = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = {(r["i"], r["j"]): int(r["high"]) * HALF + int(r["low"]) for r in cells.agg(*halves).collect()}
    n = sums.get((0, 0), 0)
    s = [sums.get((i + 1, 0), 0) for i in range(d)]
    m = [[0] * d for _ in range(d)]
    for i in range(d if n else 0):
        for j in range(i + 1):
            m[i][j] = m[j][i] = n * sums[i + 1, j + 1] - s[i] * s[j]
    return Scatter(n, s, m)


def _is_prime(p: int) -> bool:
    return all(p % q for q in range(3, isqrt(p) + 1, 2))


def primes(product: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``product``."""
    out, got, p = [], 1, (1 << 31) - 1
    while got <= product:
        if _is_prime(p):
            out.append(p)
            got *= p
        p -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - A) modulo p, highest first, through the Hessenberg form of A."""
    h = matrix.copy()
    d = len(h)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        r = k + 1 + int(pivots[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        # Column operation of the inverse: products are reduced one by one so that sums stay within 62 bits.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)  # polys[k][i]: coefficient of x^i of the leading k x k block
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1 : k + 1] = polys[k - 1, :k]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1] % p) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            polys[k] = (polys[k] - int(h[k - i - 1, k - 1]) * chain % p * polys[k - i - 1] % p) % p
    return polys[d, ::-1].tolist()


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - M), highest first, of a positive semidefinite integer matrix."""
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    bound = max(comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    chosen = primes(bound)
    text = [[str(x) for x in row] for row in m]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = np.array([[int(x) for x in row] for row in text], dtype=object)
        out = [polynomial_mod((whole % p).astype(np.int64), p) for p in batch.column("p").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("p"), pa.array(out, pa.list_(pa.int64()))], names=["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(min(len(chosen), 64), "p")
    found = {r["p"]: r["residues"] for r in map_batches(rows, run, "p bigint, residues array<bigint>").collect()}
    product = 1
    for p in chosen:
        product *= p
    weights = {p: product // p * pow(product // p, -1, p) for p in chosen}
    sizes = [sum(weights[p] * (found[p][k] if k % 2 == 0 else -found[p][k] % p) for p in chosen) % product for k in range(d + 1)]
    return [c if k % 2 == 0 else -c for k, c in enumerate(sizes)]


def roots_above(coefficients: list[int], t: int) -> int:
    """Roots greater than t, with multiplicity, of a polynomial with real roots only: sign changes of p(x + t)."""
    c = list(coefficients)
    n = len(c)
    for stop in range(n - 1, 0, -1):  # Taylor shift by repeated division
        for i in range(1, stop + 1):
            c[i] += t * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], most: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """(numerator, shift, multiplicity) of the largest positive roots, falling, ``most`` of them with multiplicity at least.

    A root lies within (numerator - 1, numerator] / 2^shift; the numerator has more than ``bits`` bits.
    """
    high = 1
    while roots_above(coefficients, high):
        high *= 2
    out, got = [], 0
    todo = [(0, high, 0, 0, roots_above(coefficients, 0))]  # roots in (low, high] / 2^shift: those above low less those above high
    while todo and got < most:
        low, high, shift, over, upto = todo.pop()
        if upto == over:
            continue
        if high - low == 1:
            if low.bit_length() > bits:
                out.append((high, shift, upto - over))
                got += upto - over
                continue
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        if upto - over == 1:  # a single root: the sign there tells whether an odd number lies above
            value, power = 0, 0
            for c in coefficients:
                value, power = value * middle + (c << power), power + shift
            between = over + (value != 0 and (value < 0) != (over % 2 == 1))
        else:
            between = roots_above([c << (shift * k) for k, c in enumerate(coefficients)], middle)
        todo += [(low, middle, shift, between, upto), (middle, high, shift, over, between)]
    return out


def null_vectors(m: np.ndarray, numerator: int, shift: int, count: int, solves: int = SOLVES) -> list[list[float]]:
    """``count`` orthonormal vectors of M - e I for e = numerator / 2^shift, by inverse iteration in fixed point."""
    d = len(m)
    size = max(int(x).bit_length() for x in m.reshape(-1)) + 1
    f = FRACTION_BITS + size
    a = m * (1 << f)
    e = (numerator << f) >> shift
    for i in range(d):
        a[i, i] -= e
    # Elimination with row pivots; factors are kept for the right-hand sides.
    order, factors = list(range(d)), np.zeros((d, d), dtype=object)
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(a[i, k]))
        if r != k:
            a[[k, r]], factors[[k, r]] = a[[r, k]], factors[[r, k]]
            order[k], order[r] = order[r], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factors[k + 1 :, k] = (a[k + 1 :, k] << f) // a[k, k]
            a[k + 1 :, k:] = a[k + 1 :, k:] - ((factors[k + 1 :, k][:, None] * a[k, k:][None, :]) >> f)
    vectors = []
    for seed in range(count):
        rng = np.random.default_rng(seed + 1)
        v = np.array([int(x) << f for x in rng.integers(1, 1 << 20, d)], dtype=object)
        v = _unit(v, f, vectors)
        for _ in range(solves):
            z = v[order]
            for k in range(d - 1):
                z[k + 1 :] = z[k + 1 :] - ((factors[k + 1 :, k] * z[k]) >> f)
            for k in range(d - 1, -1, -1):
                rest = int((a[k, k + 1 :] * z[k + 1 :]).sum()) >> f if k + 1 < d else 0
                z[k] = ((z[k] - rest) << f) // a[k, k]
            v = _unit(z, f, vectors)
        vectors.append(v)
    one = 1 << f
    return [[int(x) / one for x in v] for v in vectors]


def _unit(v: np.ndarray, f: int, others: list[np.ndarray]) -> np.ndarray:
    """Length one, orthogonal to others, with the largest entry positive; numbers are multiples of 2^-f."""
    for _ in range(2):
        most = max(abs(int(x)) for x in v) or 1
        v = np.array([(int(x) << f) // most for x in v], dtype=object)
        for o in others:
            v = v - ((o * (int((v * o).sum()) >> f)) >> f)
        length = isqrt(int((v * v).sum())) or 1
        v = np.array([(int(x) << f) // length for x in v], dtype=object)
    top = max(range(len(v)), key=lambda i: (abs(v[i]), -i))
    return -v if v[top] < 0 else v


@dataclass(frozen=True)
class Whitener:
    """Fit over the distinct vectors: ``vectors`` [k, d], ``values`` the eigenvalues of x's covariance, ``explained`` their shares."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitener:
    """The largest components with positive eigenvalues of the covariance of distinct packed vectors (see ``distinct_vectors``)."""
    spark = distinct.sparkSession
    s = scatter(distinct, d)
    trace = sum(s.m[i][i] for i in range(d))
    if not trace:
        return Whitener(s.n, s.sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    roots = largest_roots(characteristic_polynomial(spark, s.m), components)
    text = [[str(x) for x in row] for row in s.m]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = np.array([[int(x) for x in row] for row in text], dtype=object)
        at, found = [], []
        for i, e, shift, count in zip(*[batch.column(c).to_pylist() for c in ("i", "e", "shift", "count")]):
            found += null_vectors(whole, int(e), shift, min(count, components))
            at += [i] * min(count, components)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["i", "v"])

    rows = [(i, str(e), shift, count) for i, (e, shift, count) in enumerate(roots)]
    table = spark.createDataFrame(rows, "i int, e string, shift int, count int").repartition(len(rows), "i")
    found = map_batches(table, run, "i int, v array<double>").collect()
    vectors, values, explained = [], [], []
    for i, (e, shift, _) in enumerate(roots):
        for r in found:
            if r["i"] == i and len(vectors) < components:
                vectors.append(r["v"])
                values.append(e / (s.n**2 << shift))
                explained.append(e / (trace << shift))
    return Whitener(s.n, s.sums, np.array(vectors), np.array(values), np.array(explained))


def _projected(y: np.ndarray, w: Whitener) -> np.ndarray:
    """Whitened rows; the mean is split into whole and rest so that large entries lose nothing."""
    whole = [s // w.n for s in w.sums]
    rest = np.array([(s % w.n) / w.n for s in w.sums])
    centred = (y - np.array(whole, dtype=np.int64)).astype(np.float64) - rest
    return centred @ w.vectors.T / np.sqrt(w.values)


def identity_error(distinct: DataFrame, d: int, w: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance, measured on their rows, minus the identity."""
    k = len(w.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for part in pieces(batch, 4096):
                z = _projected(np.stack([_long(y, d) for y in part.column("y").to_pylist()]), w)
                z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
                total += z.T @ z
        yield _cells(total, float)

    sums = np.zeros((k + 1, k + 1))
    for r in distinct.mapInArrow(run, "i int, j int, high double").groupBy("i", "j").agg(F.sum("high").alias("s")).collect():
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["s"]
    # Rows are centred already; what is left of their mean is taken off as well.
    mean = sums[1:, 0] / w.n
    return float(np.abs(sums[1:, 1:] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(y: np.ndarray, w: Whitener) -> list[int]:
    """Exact sum over dimensions of (n x - S)^2, which does not depend on the shift."""
    most = max(int(np.abs(y).max(initial=0)) * w.n, max(abs(s) for s in w.sums))
    if 4 * most * most * y.shape[1] < 1 << 62:
        return ((y * w.n - np.array(w.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    o = y.astype(object) * w.n - np.array(w.sums, dtype=object)
    return (o * o).sum(axis=1).tolist()


def whiten(embeddings: DataFrame, id: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every usable row and component.

    ``deviation`` is null where the sum does not fit a long; ``deviation_exact`` has its digits in any case.
    """
    ship(embeddings.sparkSession)
    clean, d = clean_vectors(embeddings, id, vec)
    distinct = materialised(distinct_vectors(clean), "whiten-distinct")
    w = fit(distinct, d, components)
    error = identity_error(distinct, d, w)
    k = len(w.values)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not k:
            return None
        y = _matrix(batch)
        rows = len(y)
        exact = _deviations(y, w)
        fits = [x if x < 1 << 63 else None for x in exact]
        each = np.repeat(np.arange(rows), k)
        columns = [
            batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, w.n), pa.int64()),
            pa.array(fits, pa.int64()).take(pa.array(each)), pa.array(_projected(y, w).reshape(-1)), pa.array(np.tile(w.explained, rows)),
            pa.array(np.full(rows * k, error)), pa.array([str(x) for x in exact]).take(pa.array(each)),
        ]
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = clean.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"
    return map_batches(clean, run, schema).withColumnRenamed("vec_id", id)
