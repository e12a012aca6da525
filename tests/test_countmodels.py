"""Count models: planted dispersion, likelihoods written out plainly, and finite estimates where no focus lies."""

import math

import numpy as np
import pytest

from quillmap.operators import cbmr, countmodels
from quillmap.plans.studyset import Grid

GRID = Grid(6, 6, 6, 2.0, -5.0, (0, 5))


def rates(total, grid=GRID):
    i, j, k = np.indices(grid.shape)
    out = np.exp(-((i - 2) ** 2 + (j - 3) ** 2 + (k - 2) ** 2) / 8.0).ravel() + 0.2
    return out / out.sum() * total


def frames(spark, counts, z, grid=GRID):
    """counts: (analysis, voxel) array of foci."""
    rows = [(int(a), *map(int, np.unravel_index(v, grid.shape))) for a, v in zip(*np.nonzero(counts), strict=True) for _ in range(counts[a, v])]
    points = spark.createDataFrame(rows, "id long, i long, j long, k long")
    return points, spark.createDataFrame([(a, float(x)) for a, x in enumerate(z)], "id long, g double")


def parts(data):
    voxels = data.voxels.toPandas().sort_values("voxel")
    analyses = data.analyses.toPandas().sort_values("id")
    return data.splines.rows(voxels["voxel"].to_numpy()), voxels["y"].to_numpy(float), analyses[data.columns].to_numpy(float), analyses["n"].to_numpy(float)


def lg(x):
    return np.array([math.lgamma(v) for v in np.atleast_1d(x)])


def is_top(f, at, information, tolerance=1e-4):
    """The distance to the top, by differences in each coordinate, is below the tolerance in standard errors."""
    middle = f(at)
    for c, unit in enumerate(1 / np.sqrt(np.diag(information))):
        e = np.zeros(len(at))
        e[c] = 0.01 * unit
        up, down = f(at + e), f(at - e)
        curve = (2 * middle - up - down) / 0.01**2
        assert curve > 0 and abs(up - down) / 0.02 / curve < tolerance, c


def test_special_functions():
    x = np.array([0.05, 0.5, 1.0, 2.5, 9.9, 10.0, 150.0, 1e6])
    assert countmodels.ln_gamma(x) == pytest.approx(lg(x), rel=1e-12, abs=1e-12)
    assert countmodels.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -0.5772156649015329 - 2 * math.log(2)], abs=1e-12)
    assert countmodels.trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], abs=1e-11)


def test_poisson_agrees_with_the_driver_model(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=40)
    counts = rng.poisson(rates(4.0)[None] * np.exp(0.3 * z)[:, None])
    points, mods = frames(spark, counts, z)
    data = countmodels.prepare(points, mods, GRID, ["g"], 3)
    got = countmodels.poisson(data)
    want = cbmr.fit(points, mods, GRID, ["g"], 3)
    assert got["beta"] == pytest.approx(want["beta"], abs=1e-5) and got["gamma"] == pytest.approx(want["gamma"], abs=1e-6)
    rows = countmodels.intensity(data, got).toPandas().sort_values("voxel")
    assert rows["intensity"].to_numpy() == pytest.approx(want["intensity"], rel=1e-5)


def test_blocks_give_the_same_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points, mods = frames(spark, rng.poisson(rates(8.0)[None] * rng.gamma(2.0, 0.5, (30, 1))), rng.normal(size=30))
    one = countmodels.clustered_negative_binomial(countmodels.prepare(points, mods, GRID, ["g"], 3))
    monkeypatch.setattr(countmodels, "BLOCK_VOXELS", 20)
    monkeypatch.setattr(countmodels, "BLOCK_ANALYSES", 7)
    monkeypatch.setattr(countmodels, "ADD", 3)
    many = countmodels.clustered_negative_binomial(countmodels.prepare(points, mods, GRID, ["g"], 3))
    assert many["beta"] == pytest.approx(one["beta"], abs=1e-5) and float(many["loglik"]) == pytest.approx(float(one["loglik"]), abs=1e-6)


def test_negative_binomial_finds_planted_dispersion(spark):
    rng = np.random.default_rng(2)
    n, alpha, ridge = 40, 20.0, 1e-3
    r = n / alpha
    grid = Grid(12, 12, 12, 2.0, 0.0, (0, 11))  # many voxels for each spline, else the splines take up the dispersion
    totals = rng.poisson(rng.gamma(r, 1 / r, 12**3) * rates(60.0, grid) * n)
    counts = np.stack([rng.multinomial(t, np.full(n, 1 / n)) for t in totals], 1)
    points, mods = frames(spark, counts, np.zeros(n), grid)
    data = countmodels.prepare(points, mods, grid, [], 12)
    model = countmodels.negative_binomial(data, ridge)
    assert 0.85 * alpha < model["alpha"] < 1.15 * alpha
    x, y, _, _ = parts(data)

    def f(at):
        m, size = n * np.exp(x @ at[:-1]), n / np.exp(at[-1])
        p = m / (m + size)
        return float((lg(y + size) - lg(y + 1) - math.lgamma(size) + size * np.log(1 - p) + y * np.log(p)).sum() - 0.5 * ridge * at[:-1] @ at[:-1])

    at = np.concatenate([model["beta"], [np.log(model["alpha"])]])
    assert float(model["loglik"]) == pytest.approx(f(at))
    is_top(f, at, model["information"])


def test_clustered_negative_binomial_finds_planted_dispersion(spark):
    rng = np.random.default_rng(3)
    n, alpha, ridge = 300, 0.5, 1e-3
    z = rng.normal(size=n)
    counts = rng.poisson(rates(6.0)[None] * (rng.gamma(1 / alpha, alpha, n) * np.exp(0.4 * z))[:, None])
    points, mods = frames(spark, counts, z)
    data = countmodels.prepare(points, mods, GRID, ["g"], 3)
    model = countmodels.clustered_negative_binomial(data, ridge)
    assert abs(model["alpha"] - alpha) < 0.15 and abs(model["gamma"][0] - 0.4) < 0.15
    x, y, w, foci = parts(data)
    k = x.shape[1]

    def f(at):
        beta, gamma, v = at[:k], at[k:-1], math.exp(-at[-1])
        q = np.exp(x @ beta).sum() * np.exp(w @ gamma)
        own = v * math.log(v) - math.lgamma(v) + lg(foci + v) - (foci + v) * np.log(q + v) + foci * (w @ gamma)
        return float(own.sum() + y @ (x @ beta) - 0.5 * ridge * beta @ beta)

    at = np.concatenate([model["beta"], model["gamma"], [np.log(model["alpha"])]])
    assert float(model["loglik"]) == pytest.approx(f(at))
    is_top(f, at, model["information"])


def test_firth_is_finite_where_no_focus_lies(spark):
    rng = np.random.default_rng(4)
    n = 400
    rate = rates(3.0).reshape(GRID.shape)
    rate[4:] = 0  # a third of the volume is empty, so the likelihood alone has no top
    counts = rng.poisson(np.broadcast_to(rate.ravel(), (n, 216)))
    points, mods = frames(spark, counts, np.zeros(n))
    data = countmodels.prepare(points, mods, GRID, [], 6)
    model = countmodels.MODELS["firth"](data)
    assert np.isfinite(model["beta"]).all()
    rows = countmodels.intensity(data, model).toPandas().sort_values("voxel")["intensity"].to_numpy().reshape(GRID.shape)
    assert 0 < rows[5].sum() < 0.1 * rows[:4].sum() / 4
    # the splines sum to 1, and each coefficient adds half a focus to all that are expected
    assert n * rows.sum() == pytest.approx(data.foci + len(model["beta"]) / 2, rel=1e-4)
    x, y, _, _ = parts(data)

    def f(at):
        mu = np.exp(x @ at)
        return float(y @ (x @ at) - n * mu.sum() + 0.5 * np.linalg.slogdet(n * (x * mu[:, None]).T @ x)[1])

    is_top(f, model["beta"], model["information"])
