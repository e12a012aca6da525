"""Cluster-robust inference against plain matrices."""

import math

import numpy as np
import pytest

from quillmap.operators import robust


def root(m, power):
    values, vectors = np.linalg.eigh(m)
    return vectors @ np.diag(values**power) @ vectors.T


def plain(y, v, g, tau2, scheme, rho):
    """est, se, dof, tau2 by matrices: CR2 with the working covariance of the weights, degrees of freedom by traces."""
    y, v, g = np.array(y), np.array(v), np.array(g)
    names = sorted(set(g))
    if scheme == "collapse":
        rows = []
        for n in names:
            own = g == n
            s, k = np.sqrt(v[own]), own.sum()
            cov = rho * np.outer(s, s) + (1 - rho) * np.diag(v[own])
            rows.append((y[own].mean(), cov.sum() / k**2, n))
        y, v, g = (np.array(x) for x in zip(*rows, strict=True))
    if scheme == "rescale":
        base = np.array([v[g == n].mean() for n in g])
        sizes = np.array([(g == n).sum() for n in g])
    else:
        base, sizes = v, np.ones(len(g))
    if tau2 is None:
        w = 1 / (sizes * base)
        S = w.sum()
        est = (w * y).sum() / S
        q = (w * (y - est) ** 2).sum()
        # expected q is linear in tau2: take it at 0 and 1
        def expected(t):
            out = (w * (base + t)).sum()
            for n in names:
                own = g == n
                k = own.sum()
                if scheme == "individual":
                    cov = np.diag(base[own] + t)
                else:
                    cov = t * np.ones((k, k)) + base[own][0] * ((1 - rho) * np.eye(k) + rho * np.ones((k, k)))
                out -= w[own] @ cov @ w[own] / S
            return out
        tau2 = max(0.0, (q - expected(0)) / (expected(1) - expected(0)))
    W = np.diag(1 / (sizes * (base + tau2)))
    X = np.ones((len(y), 1))
    M = np.linalg.inv(X.T @ W @ X)
    est = float((M @ X.T @ W @ y)[0])
    phi = np.linalg.inv(W)
    resid = np.eye(len(y)) - X @ M @ X.T @ W
    lines, V = [], 0.0
    for n in names:
        own = np.flatnonzero(g == n)
        P = phi[np.ix_(own, own)]
        half = root(P, 0.5)
        back = root(P, -0.5)
        A = half @ root(back @ (P - X[own] @ M @ X[own].T) @ back, -0.5) @ back
        assert np.allclose(A @ (P - X[own] @ M @ X[own].T) @ A.T, P)
        line = (M @ X[own].T @ W[np.ix_(own, own)] @ A @ resid[own])[0]
        lines.append(line)
        V += float(line @ y) ** 2
    G = np.array([[a @ phi @ b for b in lines] for a in lines])
    return est, math.sqrt(V), np.trace(G) ** 2 / np.trace(G @ G), tau2


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for voxel in range(12):
        spread = 0.0 if voxel % 3 == 0 else 0.8
        for study in range(2 + voxel):
            shift = rng.normal(0.5, spread)
            for _ in range(1 + (study * 7 + voxel) % 4):
                out.append((voxel, study, float(shift + rng.normal(0, 0.3)), float(rng.uniform(0.05, 1.0))))
    return out


@pytest.mark.parametrize("scheme", robust.SCHEMES)
@pytest.mark.parametrize("tau2", ["dl", 0.25])
def test_same_as_matrices(spark, rows, scheme, tau2):
    image = spark.createDataFrame(rows, "voxel long, study_id long, value double, varcope double")
    got = {r["voxel"]: r for r in robust.estimate(image, tau2, scheme, 0.6).collect()}
    for voxel in range(12):
        _, g, y, v = zip(*[r for r in rows if r[0] == voxel], strict=True)
        est, se, dof, t = plain(y, v, g, None if tau2 == "dl" else tau2, scheme, 0.6)
        r = got[voxel]
        assert (r["est"], r["se"], r["dof"], r["tau2"]) == pytest.approx((est, se, dof, t), rel=1e-8, abs=1e-10)
        # p of a t with fractional degrees of freedom, by integration
        x = np.linspace(-60, 60, 1_200_001)
        density = np.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + x * x / dof) ** (-(dof + 1) / 2)
        inner = np.trapezoid(np.where(np.abs(x) <= abs(est / se), density, 0.0), x)
        assert r["p"] == pytest.approx(1 - inner, abs=2e-4)
        assert np.sign(r["z"]) == np.sign(est)


def test_singletons_of_equal_weight_are_a_t_test(spark):
    y = [0.3, 1.2, -0.4, 0.9, 0.5]
    image = spark.createDataFrame([(0, i, v, 1.0) for i, v in enumerate(y)], "voxel long, study_id long, value double, varcope double")
    r = robust.estimate(image, 0.0).first()
    assert (r["est"], r["se"], r["dof"]) == pytest.approx((np.mean(y), np.std(y, ddof=1) / math.sqrt(5), 4.0))


def test_edges(spark):
    image = spark.createDataFrame([(0, 1, 0.5, 1.0), (0, 1, 0.7, 1.0), (1, None, 0.5, 1.0), (1, 2, 0.5, 1.0)], "voxel long, study_id long, value double, varcope double")
    got = {r["voxel"]: r for r in robust.estimate(image).collect()}
    assert got[0]["se"] is None and got[0]["p"] is None and got[0]["est"] == pytest.approx(0.6)
    assert got[1]["m"] == 2 and got[1]["se"] == pytest.approx(0.0)
    assert robust.estimate(image.limit(0)).count() == 0
    for bad in ({"scheme": "none"}, {"rho": 1.5}, {"tau2": "ml"}):
        with pytest.raises(ValueError):
            robust.estimate(image, **bad)


def test_stouffer_of_clusters(spark):
    image = spark.createDataFrame([(0, i // 2, 1.0 + i, 1.0) for i in range(6)], "voxel long, study_id long, value double, varcope double")
    r = robust.stouffers(image, 0.5).first()
    assert r["dof"] == 2.0 and 0 < r["p"] < 1
