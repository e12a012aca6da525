"""Subsamples and balanced maps against plain NumPy over the same replicates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import cbma, diagnostics, kernels, pairwise, resampling
from tests.test_pairwise import GRID, N, ON, ONE, dense, groups, label, points  # noqa: F401


def members(spark, ids, size, n, seed):
    h = {r["id"]: r["h"] for r in ids.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
    names = sorted(h)
    x = cbma._draws(np.array([h[i] for i in names]), np.arange(n), seed).astype(np.int64)
    order = np.argsort(x, 0)[:size]
    return [[names[i] for i in order[:, r]] for r in range(n)]


def keeps(stat, threshold, least):
    on = np.zeros(ON.shape, bool)
    on[ON] = stat > threshold
    marks, n = label(on)
    for c in range(1, n + 1):
        if (marks == c).sum() < least:
            on[marks == c] = False
    return on[ON]


@pytest.mark.parametrize(("kind", "least", "rows"), [("ale", 0, 10**6), ("kda", 3, 10**6), ("mkda", 0, 50)])
def test_support_is_that_of_the_schedule(spark, points, monkeypatch, kind, least, rows):  # noqa: F811
    monkeypatch.setattr(pairwise, "TASK_ROWS", rows)
    ids = spark.createDataFrame([(i,) for i in range(N)], "id long")
    weights = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(N)], "id long, weight double")
    ma = kernels.ale_gaussian(points, GRID, 4.0) if kind == "ale" else kernels.kda(points, GRID, 2.0) if kind == "kda" else kernels.mkda(points, GRID, 2.0)
    threshold = {"ale": 0.06, "kda": 4.0, "mkda": 0.3}[kind]
    got = {r["voxel"]: r["support"] for r in resampling.stability(ma, ids, GRID, threshold, kind, leave=7, n=40, least=least, weights=weights, seed=2).collect()}
    x, w = dense(spark, ma, "value"), 1.0 + np.arange(N) % 3
    hits = 0
    for own in members(spark, ids, N - 7, 40, 2):
        stat = {"ale": 1 - np.prod(1 - np.minimum(x[own], 1 - 1e-12), 0), "kda": x[own].sum(0), "mkda": (w[own, None] * x[own]).sum(0) / w[own].sum()}[kind]
        hits = hits + keeps(stat, threshold, least)
    assert [got[v] for v in np.flatnonzero(ON.ravel())] == pytest.approx((hits / 40).tolist())
    assert 0 < np.mean(hits) < 40


def test_subsamples_agree_with_schedule_and_check_sizes(spark, points):  # noqa: F811
    ids = spark.createDataFrame([(i,) for i in range(N)], "id long")
    ma = kernels.ale_gaussian(points, GRID, 4.0)
    schedule = spark.createDataFrame([(r, i) for r, own in enumerate(members(spark, ids, 9, 25, 0)) for i in own], "replicate long, id long")
    want = {r["voxel"]: r["support"] for r in diagnostics.stability(ma, schedule, 0.04, GRID.mask(spark)).collect()}
    got = {r["voxel"]: r["support"] for r in resampling.stability(ma, ids, GRID, 0.04, size=9, n=25).collect()}
    assert got == pytest.approx(want)
    for bad in ({"size": 3, "leave": 2}, {}, {"size": 99}, {"leave": N}):
        with pytest.raises(ValueError):
            resampling.stability(ma, ids, GRID, 0.2, **bad)


def test_random_subsets_of_foci(spark):
    foci = spark.createDataFrame([(i, 1 + i % 3) for i in range(12)], "id long, n long")
    volumes = cbma.simulated(spark, foci, np.argwhere(ON), GRID, 30, "kda", 0.0, seed=5, subset=4).collect()
    totals = [np.frombuffer(bytes(r["part"])).sum() for r in volumes]
    assert all(4 <= t <= 12 for t in totals) and len(set(totals)) > 2 and np.mean(totals) == pytest.approx(8, abs=1.2)


def test_balanced_maps(spark, points, groups):  # noqa: F811
    ma = kernels.ale_gaussian(points, GRID, 4.0)
    foci = points.groupBy("id").agg(F.count("*").alias("n"))
    size, n_sub, n_iters, per, threshold = 6, 20, 25, 3, 0.09
    rows = {r["voxel"]: r for r in resampling.balanced(ma, *groups, foci, GRID, threshold, size, n_sub, n_iters, per, 0.6, 4.0, seed=1).collect()}
    x = np.log1p(-np.minimum(dense(spark, ma, "value"), 1 - 1e-12))
    ale = lambda own: -np.expm1(x[own].sum(0))
    probs = []
    for place, g in enumerate(groups):
        own = foci.join(g, "id", "left_semi")
        least = resampling.cluster_size_null(spark, own, size, GRID, threshold, fwhm=4.0, n_iters=n_iters, alpha=0.6, seed=1 + place)
        probs.append(sum(keeps(ale(s), threshold, least) for s in members(spark, g, size, n_sub, 1 + place)) / n_sub)
    seen = np.mean([ale(a) - ale(b) for a, b in zip(members(spark, groups[0], size, per, 11), members(spark, groups[1], size, per, 12), strict=True)], 0)
    # labellings, and subsamples within each label
    every = groups[0].union(groups[1])
    h = {r["id"]: r["h"] for r in every.select("id", F.xxhash64("id").alias("h")).collect()}
    names = np.array([h[i] for i in range(N)])
    lows, highs = [], []
    for it in range(n_iters):
        order = np.argsort(cbma._draws(names, np.array([it]), 21)[:, 0])
        one, two = order[:ONE], order[ONE:]
        pairs = []
        for d in range(per):
            pick = lambda own, s: own[np.argsort(cbma._draws(names[own], np.array([it * per + d]), s)[:, 0])[:size]]  # noqa: B023, E731
            pairs.append(ale(pick(one, 22)) - ale(pick(two, 23)))
        lows.append(np.mean(pairs, 0).min())
        highs.append(np.mean(pairs, 0).max())
    low, high = np.percentile(lows, 30), np.percentile(highs, 70)
    for v, p1, p2, d in zip(np.flatnonzero(ON.ravel()), *probs, seen, strict=True):
        r = rows[v]
        assert (r["prob1"], r["prob2"], r["conjunction"], r["difference"]) == pytest.approx((p1, p2, min(p1, p2), d), abs=1e-9)
        p = max((np.array(highs) >= d).mean(), 1 / n_iters) if d > high else max((np.array(lows) <= d).mean(), 1 / n_iters) if d < low else 1.0
        assert r["p"] == pytest.approx(p)
    assert max(probs[0]) > 0 and len(rows) == ON.sum()
