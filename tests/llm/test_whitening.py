"""Whitening against numpy's eigenvectors of the covariance itself, computed in exact integers."""

import math

import numpy as np
import pytest

from viewframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, id int, n long"


def table(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 1, 2) for k, v in rows], SCHEMA).repartition(3)


def brute(rows, components=4):
    usable = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in usable]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n))
    whole = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in usable if len(v) == usual]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], object)
    cov = (a.T @ a).astype(float) / float(n) ** 3
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = sum(v > 1e-9 * max(np.trace(cov), 1e-300) for v in e[:components])
    out = {}
    for i, x in whole:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        z = (np.array(off, float) / n) @ u[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((sum(o * o for o in off), z))
    return n, k, e[:k] / np.trace(cov) if k else e[:0], out


@pytest.mark.parametrize("case", ["plain", "few", "awkward", "flat"])
def test_against_numpy(spark, case):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.standard_normal(12) * np.linspace(3, 1, 12)]) for k in range(200)]
    if case == "few":
        rows = [(k, [float(c) for c in rng.standard_normal(2)]) for k in range(9)]
    if case == "awkward":
        rows += [(300, None), (301, []), (302, [None] * 12), (303, [float("nan")] * 12), (304, [float("inf")] + [0.0] * 11), (305, [1.0, 2.0]), (306, [0.0] * 12), (307, [-0.0] * 12), (1, rows[1][1]), (308, rows[2][1])]
        rows += [(400 + k, rows[5][1]) for k in range(100)]  # a hot vector
    if case == "flat":
        rows = [(k, [float(k % 5), 2.0, 2.0]) for k in range(30)]
    n, k, explained, expected = brute(rows)
    vectors = W.whole_vectors(table(spark, rows))
    fit = W.fitted(vectors)
    got = {}
    for r in W.whitened(vectors, fit).collect():
        got.setdefault(r.id, {}).setdefault(r.component, []).append(r)
    assert fit.moments.n == n and len(fit.values) == k and set(got) == set(expected)
    assert np.abs(fit.vectors.T @ fit.vectors - np.eye(k)).max() < 1e-14 and fit.residual <= 1e-12 * fit.values[0]
    for j in range(k):
        one = [(r.whitened, z[j]) for i, all_ in expected.items() for (_, z), r in zip(all_, got[i][j + 1], strict=True)]
        ours, theirs = (np.array(c) for c in zip(*one, strict=True))
        sign = 1 if ours @ theirs > 0 else -1
        assert np.abs(ours * sign - theirs).max() < 1e-9
    for i, all_ in expected.items():
        for rs in got[i].values():
            assert [(r.n, r.deviation) for r in rs] == [(n, d) for d, _ in all_]
            assert all(abs(r.explained - explained[r.component - 1]) <= 1e-10 and r.identity_error < 1e-10 for r in rs)


def test_nothing_and_one_vector(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        vectors = W.whole_vectors(table(spark, rows))
        fit = W.fitted(vectors)
        assert fit is None or W.whitened(vectors, fit).count() == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(k, [1e15 * (k + 1), -3e14 * k * k]) for k in range(5)]
    n, _, _, expected = brute(rows)
    vectors = W.whole_vectors(table(spark, rows))
    fit = W.fitted(vectors)
    assert fit.moments.sums == tuple(sum(math.floor(256 * float(np.float32(v[d]))) for _, v in rows) for d in range(2))
    assert all(r.deviation == (d if (d := expected[r.id][0][0]) < 1 << 63 else None) for r in W.whitened(vectors, fit).collect())


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 1, 1], [9, 0, 0, 0, 0, 0], list(range(40)), [1e6, 1e6 - 1e-3, *([1] * 50)]])
def test_iteration_finds_the_largest(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))
    a = (q * np.array(values, float)) @ q.T
    e, u, _ = W.jacobi_davidson(lambda v: a @ v, len(values), 4, float(sum(values)))
    assert np.allclose(e, sorted(values, reverse=True)[:4], atol=1e-9 * max(values))
    assert np.abs(a @ u - u * e).max() < 1e-13 * max(values) and np.abs(u.T @ u - np.eye(4)).max() < 1e-13
