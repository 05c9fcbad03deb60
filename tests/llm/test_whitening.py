"""Whitening against eigenvectors in floating point, and its exact parts against plain integer computation."""

from fractions import Fraction

import numpy as np
import pytest

from speakerprint.llm import queries, whitening
from speakerprint.plans.catalog import table


def plain(rows, most=16):
    """(n, vec_id -> deviation, x, eigenvalues, eigenvectors, mean) over distinct integer vectors."""
    x = {i: np.floor(64 * np.asarray(v, dtype=np.float64)).astype(int) + 1_000_000 for i, v in rows}
    fitted = np.array(sorted({tuple(v) for v in x.values()}))
    n, mean = len(fitted), fitted.mean(axis=0)
    values, vectors = np.linalg.eigh((fitted - mean).T @ (fitted - mean) / n)
    s = fitted.sum(axis=0)
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    return n, deviation, x, values[::-1][:most], vectors[:, ::-1][:, :most].T, mean, values.sum()


def check(out, rows, most=16):
    n, deviation, x, values, vectors, mean, trace = plain(rows, most)
    kept = [k for k in range(min(most, len(values))) if values[k] > 1e-9 * trace]
    assert len(out) == len(rows) * len(kept)
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
    for k in kept:
        want = {i: (v - mean) @ vectors[k] / np.sqrt(values[k]) for i, v in x.items()}
        have = {i: got[(i, k + 1)]["whitened"] for i in x}
        sign = np.sign(sum(want[i] * have[i] for i in x))
        assert max(abs(sign * have[i] - want[i]) for i in x) < 1e-6
        r = got[(rows[0][0], k + 1)]
        assert r["n"] == n and abs(r["explained"] / (values[k] / trace) - 1) < 1e-9
    assert all(r["deviation"] == deviation[r["vec_id"]] and r["deviation_exact"] == str(deviation[r["vec_id"]]) for r in out)


def test_given_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    check(queries.op11_whitening(spark, sf_dir).collect(), rows)


def test_unusable_vectors_copies_and_other_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200, [1e3, -7.0, 0.0, 5.0, 2.0])]
    bad = [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0]), (303, [float("nan")] * 5), (304, [float("inf")] + [0.0] * 4), (305, [1.0, 2.0]), (306, [1e300] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").repartition(4)
    out = whitening.whiten(df.selectExpr("*", "1 AS v", "2 AS y", "3 AS d", "4 AS i")).collect()
    check(out, rows)


def test_rank_below_dimension(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, (3, 8))
    rows = [(i, (rng.integers(-9, 9, 3) @ base / 64.0).tolist()) for i in range(200)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in out} == {1, 2, 3}
    check(out, rows)


def test_equal_roots(spark):
    """Axis vectors: all roots but one are equal; any orthonormal basis has an identity covariance."""
    rows = [(i, [float(i == j) for j in range(6)]) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in out} == {1, 2, 3, 4, 5} and out[0]["identity_error"] < 1e-9
    assert all(abs(r["explained"] - 0.2) < 1e-12 for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(None, [1.0]), (2, [1.0])]])
def test_no_variance_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-(10**15), 10**15, 3)).astype(float).tolist()) for i in range(30)] + [(None, [3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    n, deviation, *_ = plain(rows)
    out = whitening.whiten(df).collect()
    assert {(r["vec_id"], r["deviation_exact"], r["deviation"]) for r in out} == {(i, str(v), None) for i, v in deviation.items()}
    assert out[0]["identity_error"] < 1e-4


def faddeev(m):
    """Coefficients of det(x I - M) in fractions."""
    d = len(m)
    a, c, out = [[Fraction(0)] * d for _ in range(d)], Fraction(1), [1]
    for k in range(1, d + 1):
        a = [[sum(m[i][t] * a[t][j] for t in range(d)) + (c * m[i][j] if True else 0) for j in range(d)] for i in range(d)]
        c = -sum(a[i][i] for i in range(d)) / k
        out.append(int(c))
    return out


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(7)
    for d, rank in ((1, 1), (4, 4), (7, 5)):
        a = rng.integers(-99, 99, (rank, d))
        m = [[int(x) for x in row] for row in a.T @ a]
        p = whitening.characteristic_polynomial(spark, m)
        assert p == faddeev(m)
        roots = whitening.largest_roots(p, d)
        assert sum(c for _, _, c in roots) == rank
        want = np.linalg.eigvalsh(np.array(m, dtype=float))[::-1][:rank]
        assert np.allclose([e / (1 << s) for e, s, _ in roots], want, rtol=1e-9)
    assert [c for _, _, c in whitening.largest_roots(whitening.characteristic_polynomial(spark, [[5, 0, 0], [0, 5, 0], [0, 0, 0]]), 3)] == [2]
