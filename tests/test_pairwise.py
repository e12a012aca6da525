"""Family-wise inference for two groups against plain NumPy over the same labellings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import cbma, kernels, pairwise
from quillmap.plans.studyset import Grid

ON = np.random.default_rng(5).random((6, 6, 6)) < 0.8
GRID = Grid(6, 6, 6, 2.0, -5.0).with_mask(ON)
N, ONE = 24, 10


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(N):
        middle = (1, 1, 1) if i < ONE else (4, 4, 4)
        for _ in range(4):
            at = np.clip(np.rint(rng.normal(middle, 1.0)) if rng.random() < 0.7 else rng.integers(0, 6, 3), 0, 5)
            rows.append((i, *map(int, at)))
    return spark.createDataFrame(rows, "id long, i long, j long, k long")


@pytest.fixture(scope="module")
def groups(spark):
    return tuple(spark.createDataFrame([(i,) for i in r], "id long") for r in (range(ONE), range(ONE, N)))


def label(on):
    """Clusters of face neighbours by a plain flood."""
    marks, n = np.zeros(on.shape, int), 0
    for start in zip(*np.nonzero(on), strict=True):
        if marks[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            at = todo.pop()
            if not all(0 <= c < s for c, s in zip(at, on.shape, strict=True)) or not on[at] or marks[at]:
                continue
            marks[at] = n
            for axis in range(3):
                for d in (-1, 1):
                    todo.append(tuple(c + d * (axis == x) for x, c in enumerate(at)))
    return marks, n


def measures(values, threshold):
    """(largest, [(voxels, size, mass)]) of one statistic over the mask."""
    volume = np.zeros(ON.shape)
    volume[ON] = values
    found = []
    for sign in (1, -1):
        marks, n = label(sign * volume > threshold)
        for c in range(1, n + 1):
            own = marks == c
            found.append((np.flatnonzero(own.ravel()), int(own.sum()), float((sign * volume[own] - threshold).sum())))
    return float(np.abs(values).max()), found


def dense(spark, rows, column):
    out = np.zeros((N, 216))
    for r in rows.collect():
        out[r["id"], r["voxel"]] = r[column]
    return out[:, ON.ravel()]


def labellings(spark, groups, n_iters, seed):
    ids = groups[0].union(groups[1])
    cuts = cbma.label_cuts(ids, ONE, n_iters, seed)
    h = {r["id"]: r["h"] for r in ids.select("id", F.xxhash64("id").alias("h")).collect()}
    x = cbma._draws(np.array([h[i] for i in range(N)]), np.arange(n_iters), seed).astype(np.int64)
    return (x <= cuts).T


def expect(got, family, observed, nulls, threshold):
    """Compare p of voxels, sizes and masses with counts over the nulls."""
    n = len(nulls)
    tops = np.array([measures(v, threshold)[0] for v in nulls])
    sizes = np.array([max([c[1] for c in measures(v, threshold)[1]], default=0) for v in nulls])
    masses = np.array([max([c[2] for c in measures(v, threshold)[1]], default=0.0) for v in nulls])
    p = lambda null, x: min(max((null >= x - 1e-9 * max(1.0, abs(x))).mean(), 1 / n), 1 - 1 / n)
    rows = {r["voxel"]: r for r in got.where(F.col("family") == family).collect()}
    voxels = np.flatnonzero(ON.ravel())
    assert sorted(rows) == voxels.tolist()
    cluster = {}
    for own, size, mass in measures(observed, threshold)[1]:
        for v in own:
            cluster[v] = (p(sizes, size), p(masses, mass))
    for v, x in zip(voxels, observed, strict=True):
        r = rows[v]
        assert r["stat"] == pytest.approx(x, abs=1e-9)
        assert r["p_voxel"] == pytest.approx(p(tops, abs(x)))
        assert (r["p_size"], r["p_mass"]) == pytest.approx(cluster.get(v, (1.0, 1.0)))
    return len({c for c in cluster.values()})


def families(a, b, n1, n2):
    def one(x, n):
        e = np.full(len(x), x.mean())
        return (x - e) ** 2 / e + ((n - x) - (n - e)) ** 2 / (n - e)

    table = np.array([[a, b], [n1 - a, n2 - b]])
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = table.sum(0, keepdims=True) * table.sum(1, keepdims=True) / (n1 + n2)
        two = ((table - expected) ** 2 / expected).sum((0, 1))
    return {"uniformity": one(a, n1), "group2": one(b, n2), "association": np.where(np.isfinite(two), two, 2.0)}


@pytest.mark.parametrize("rows", [10**6, 40])
def test_chi2_clusters_under_permuted_labels(spark, points, groups, monkeypatch, rows):
    monkeypatch.setattr(pairwise, "TASK_ROWS", rows)  # of 40: stripes in parts, which are added
    monkeypatch.setattr(pairwise, "ADD_PARTS", 2)
    active = kernels.mkda(points, GRID, 2.0)
    n_iters = 200 if rows > 40 else 30
    got = pairwise.chi2_fwe(active, *groups, GRID, n_iters, 0.05, seed=4).cache()
    x = dense(spark, active, "value")
    labels = labellings(spark, groups, n_iters, 4)
    assert (labels.sum(1) == ONE).all()
    seen = families(x[:ONE].sum(0), x[ONE:].sum(0), ONE, N - ONE)
    found = 0
    for f in pairwise.FAMILIES:
        nulls = [families(x[l].sum(0), x[~l].sum(0), ONE, N - ONE)[f] for l in labels]
        found += expect(got, f, seen[f], nulls, pairwise.chi2_threshold(0.05))
    assert found and pairwise.chi2_threshold(0.001) == pytest.approx(10.827566, abs=1e-5)


def test_chi2_clusters_under_random_foci(spark, points, groups):
    foci = [points.join(g, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")) for g in groups]
    threshold = pairwise.chi2_threshold(0.05)
    null = pairwise.chi2_foci_null(spark, *foci, GRID, 2.0, 25, threshold, seed=2)
    active = kernels.mkda(points, GRID, 2.0)
    got = pairwise.chi2_fwe(active, *groups, GRID, 25, 0.05, null=null)
    pool, steps = np.argwhere(ON), kernels.sphere(2.0, 2.0)
    counts = []
    for s, n in ((2, ONE), (3, N - ONE)):
        counts.append([])
        for it in range(25):
            picks = pool[np.random.default_rng([s, it, 0]).integers(len(pool), size=4 * n)].reshape(n, 4, 3)
            total = np.zeros(ON.shape)
            for own in picks:
                on = np.zeros(ON.shape, bool)
                for q in (own[:, None] + np.array(steps)[None]).reshape(-1, 3):
                    if ((q >= 0) & (q < 6)).all():
                        on[tuple(q)] = True
                total += on
            counts[-1].append(total[ON])
    x = dense(spark, active, "value")
    seen = families(x[:ONE].sum(0), x[ONE:].sum(0), ONE, N - ONE)
    for f in pairwise.FAMILIES:
        expect(got, f, seen[f], [families(a, b, ONE, N - ONE)[f] for a, b in zip(*counts, strict=True)], threshold)


def test_subtraction_clusters(spark, points, groups):
    ma = kernels.ale_gaussian(points, GRID, 4.0)
    n_iters = 60
    got = pairwise.subtraction_fwe(ma, *groups, GRID, n_iters, 0.05, seed=1)
    x = np.log1p(-np.minimum(dense(spark, ma, "value"), 1 - 1e-12))
    stat = lambda l: np.exp(x[~l].sum(0)) - np.exp(x[l].sum(0))
    nulls = [stat(l) for l in labellings(spark, groups, n_iters, 1)]
    threshold = np.quantile(np.abs(nulls), 0.95)
    expect(got, "difference", stat(np.arange(N) < ONE), nulls, threshold)
    z = pairwise.with_z(got).where("stat < 0").first()
    assert z["z_voxel"] <= 0 and z["logp_voxel"] >= 0


def test_exact_quantile(spark):
    rng = np.random.default_rng(1)
    data = [np.concatenate([rng.exponential(1.0, 500), np.zeros(200)]) for _ in range(9)]
    volumes = spark.createDataFrame([(i, d.tobytes()) for i, d in enumerate(data)], "iteration long, part binary")
    for q in (0.0, 0.2, 0.5, 0.9, 0.999, 1.0):
        assert pairwise.exact_quantile(volumes, np.frombuffer, q, bins=7) == pytest.approx(np.quantile(np.concatenate(data), q), abs=1e-12)
    same = spark.createDataFrame([(0, np.full(5, 2.5).tobytes())], "iteration long, part binary")
    assert pairwise.exact_quantile(same, np.frombuffer, 0.3) == 2.5


def test_scale_maxima(spark, points):
    ma = kernels.ale_gaussian(points, GRID, 4.0)
    foci = points.groupBy("id").agg(F.count("*").alias("n"))
    pool = np.argwhere(ON)
    got = pairwise.scale_fwe(ma, foci, pool, GRID, 20, 4.0, seed=3).collect()
    tops = []
    for it in range(20):
        picks = pool[np.random.default_rng([3, it, 0]).integers(len(pool), size=4 * N)]
        work, total = kernels.Gaussians(GRID, 4.0), np.zeros(ON.shape)
        for i in range(N):
            box = work.stamp(picks[4 * i : 4 * i + 4], 0.0)
            total[box] += np.log1p(-work.best[box])
            work.clear(box)
        tops.append((-np.expm1(total))[ON].max())
    assert len(got) == ON.sum()
    for r in got:
        assert r["p_voxel"] == pytest.approx(np.clip((np.array(tops) >= r["stat"] - 1e-12).mean(), 1 / 20, 1 - 1 / 20))


def test_groups_that_share_an_analysis(spark, points, groups):
    with pytest.raises(ValueError, match="share"):
        pairwise.chi2_fwe(kernels.mkda(points, GRID, 2.0), groups[0], groups[0], GRID, 5)
