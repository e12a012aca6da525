"""Sources, edge cases and operators without SQL."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.functions import native
from quillmap.operators import cbma, cbmr, clusters, correction, diagnostics, ibma, kernels, selection, structure, text
from quillmap.plans import workflows
from quillmap.plans.studyset import Grid, Studyset
from quillmap.sources import nimads, proxy, sleuth, tables
from quillmap.streaming import label_counts

GRID = Grid(6, 6, 6, 2.0, -5.0, (0, 5))


@pytest.fixture(scope="module")
def ss(spark):
    a = spark.createDataFrame([(1, 10, 20), (2, 10, 25), (3, 11, 30), (4, 12, 16)], "id long, study_id long, sample_size long")
    rows = [(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (3, 4, 4, 4), (3, 9, 9, 9)]
    p = spark.createDataFrame([(i, x, y, z, 2.0 * x - 5, 2.0 * y - 5, 2.0 * z - 5) for i, x, y, z in rows], "id long, i long, j long, k long, x double, y double, z double")
    n = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.0), (2, "b", 1.0), (3, "b", None)], "id long, label string, value double")
    return Studyset(analysis=a, point=p, annotation=n, grid=GRID)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_label_selection_edges(ss):
    a, n = ss.analysis, ss.annotation
    assert ids(selection.by_labels(a, n, ["a", "b"], match="any")) == [1, 2]
    assert ids(selection.by_labels(a, n, ["a"], 0.5)) == [1]
    assert ids(selection.by_labels(a, n, ["a", "b"], 0.0)) == [1, 2, 3, 4]
    assert ids(selection.by_labels(a, n, ["nothing"])) == []


def test_metadata_errors(ss):
    with pytest.raises(ValueError, match="unknown"):
        selection.by_metadata(ss.analysis, "nothing", "==", 1)
    assert ids(selection.by_metadata(ss.analysis, "sample_size", "contains", "^2")) == [1, 2]


def test_mask_selection_clips_and_filter_drops(ss):
    assert ids(selection.by_mask(ss.point, GRID)) == [1, 2, 3]
    assert selection.focus_filter(ss.point, GRID).count() == 4


def test_studyset_narrowing(ss):
    part = ss.select(ss.analysis.where("id < 3"))
    assert part.point.count() == 3 and ss.drop(ss.analysis.where("id < 3")).point.count() == 2
    with pytest.raises(ValueError, match="no valid"):
        ss.require(ss.point.where("id > 99"))
    with pytest.raises(ValueError, match="some analyses"):
        ss.require(ss.point, drop_invalid=False)
    assert ss.require(ss.point).analysis.count() == 3
    assert ss.check() == {"repeated": 0, "orphan_point": 0, "orphan_annotation": 0}


def test_image_policy(spark):
    rows = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 5, "z")], "id long, image_pos long, v string")
    assert {r["v"] for r in selection.first_image(rows).collect()} == {"y", "z"}
    with pytest.raises(ValueError, match="several"):
        selection.first_image(rows, "error")


def test_upsert_and_tails(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), spark.createDataFrame([(2, None), (3, "c")], "id long, text string")
    assert {r["id"]: r["text"] for r in structure.upsert(old, new).collect()} == {1: "a", 2: "b", 3: "c"}
    p, q = spark.createDataFrame([(1, 2.0)], "id long, value double"), spark.createDataFrame([(2, 3.0)], "id long, value double")
    assert sorted(map(tuple, structure.tails(p, q).collect())) == [(1, 2.0, 0.0), (2, 0.0, 3.0)]


def test_kernel_shapes():
    assert len(kernels.sphere(4.0, 2.0)) == 33 and len(kernels.sphere(0.0, 2.0)) == 1
    k = kernels.ale_kernel(10.0, 2.0)
    assert k.sum() == pytest.approx(1.0) and k.max() == k[tuple(n // 2 for n in k.shape)]
    assert kernels.ale_fwhm(20) == pytest.approx(math.hypot(5.7, 11.6 / math.sqrt(20)) / (2 * math.sqrt(2 / math.pi)) * math.sqrt(8 * math.log(2)))


def test_kda_sums_where_mkda_does_not(ss):
    kda = {(r["id"], r["voxel"]): r["value"] for r in kernels.kda(ss.point, GRID, 2.0).collect()}
    mkda = {(r["id"], r["voxel"]): r["value"] for r in kernels.mkda(ss.point, GRID, 2.0).collect()}
    assert kda.keys() == mkda.keys() and max(kda.values()) == 2.0 and set(mkda.values()) == {1.0}


def test_fold_matches_direct_convolution(spark):
    hist = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.5), (2, 0, 0.25), (2, 1, 0.75)], "id long, bin long, share double")
    assert cbma.fold_histograms(hist, 0.1, additive=True) == pytest.approx([0.125, 0.375, 0.125, 0.375])
    null = cbma.null_table(spark, np.array([0.5, 0.25, 0.25]))
    stat = spark.createDataFrame([(1, 0.0), (2, 0.1), (3, 0.9)], "voxel long, stat double")
    assert [r["p"] for r in cbma.stat_to_p(stat, null, 0.1).orderBy("voxel").collect()] == [1.0, 0.5, 0.25]


def test_fold_of_many_analyses_matches_sequential_fold(spark, monkeypatch):
    rng = np.random.default_rng(1)
    step, rows, want = 1e-3, [], np.ones(1)
    for i in range(40):
        bins = np.sort(rng.choice(np.arange(1, 60), 3, replace=False))
        share = rng.dirichlet(np.ones(4))
        rows += [(i, int(b), float(x)) for b, x in zip([0, *bins], share)]
    hist = spark.createDataFrame(rows, "id long, bin long, share double")
    for i in range(40):
        h = np.zeros(60)
        for _, b, x in rows[4 * i : 4 * i + 4]:
            h[b] = x
        out = np.zeros(1001)
        for a in np.flatnonzero(want):
            for b in np.flatnonzero(h):
                out[int(round((1 - (1 - a * step) * (1 - b * step)) / step))] += want[a] * h[b]
        want = out
    exact = cbma.fold_histograms(hist, step)
    assert np.pad(exact, (0, 1001 - len(exact))) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(cbma, "FOLD_ANALYSES", 3)
    monkeypatch.setattr(cbma, "FOLD_DIRECT", 0)
    # by blocks and transforms: as a distribution, within the rounding of bins
    fast = cbma.fold_histograms(hist, step)
    tails = [np.cumsum(np.pad(x, (0, 1001 - len(x)))[::-1])[::-1] for x in (want, fast)]
    assert tails[1][0] == pytest.approx(1.0) and np.interp(0.5, tails[1][::-1], np.arange(1001)) == pytest.approx(np.interp(0.5, tails[0][::-1], np.arange(1001)), abs=12)
    add = cbma.fold_histograms(hist, 1.0, additive=True)
    direct = np.ones(1)
    for i in range(40):
        h = np.zeros(60)
        for _, b, x in rows[4 * i : 4 * i + 4]:
            h[b] = x
        direct = np.convolve(direct, h)
    assert np.pad(add, (0, len(direct) - len(add))) == pytest.approx(direct, abs=1e-12)


def test_nulls_of_spheres(spark, ss):
    ma = kernels.mkda(ss.point, GRID, 2.0)
    share = [r["n"] / 216 for r in ma.groupBy("id").agg(F.count("*").alias("n")).orderBy("id").collect()]
    want = np.ones(1)
    for p in share:
        want = np.convolve(want, [1 - p, p])
    assert cbma.mkda_null(ma, 216) == pytest.approx(want)
    null = cbma.null_table(spark, want)
    assert cbma.p_to_stat(null, float(want[-1]), 1.0) == len(share) - 1
    reduced = {r["bin"]: r["p"] for r in cbma.reduced_null(spark, cbma.ale_histograms(ma, 216, 1.0), 20000, 1.0, additive=True).collect()}
    assert reduced[0] == 1.0 and reduced[1] == pytest.approx(1 - want[0], abs=0.01)


def simulate(grid, counts, pool, n_iters, r):
    """As the operator draws, but for one block and plainly."""
    out = []
    steps = kernels.sphere(r, grid.size)
    for it in range(n_iters):
        rng = np.random.default_rng([0, it, 0])
        picks = pool[rng.integers(len(pool), size=sum(counts))].tolist()
        stat, at = np.zeros(grid.shape), 0
        for n in counts:
            on = np.zeros(grid.shape, bool)
            for p in picks[at : at + n]:
                for s in steps:
                    q = tuple(a + b for a, b in zip(p, s))
                    if all(0 <= x < y for x, y in zip(q, grid.shape)):
                        on[q] = True
            stat += on & grid.mask_array()
            at += n
        out.append(stat / len(counts))
    return out


def test_random_foci_match_brute_force(spark):
    on = np.zeros(GRID.shape, bool)
    on[1:5, 1:5, 1:5] = True
    on[2, 2, 2] = False
    grid = GRID.with_mask(on)
    foci = spark.createDataFrame([(1, 2), (2, 5), (3, 1)], "id long, n long")
    got = {r["iteration"]: r for r in cbma.monte_carlo(spark, foci, grid.mask(spark), grid, 2.0, 12, threshold=0.4).collect()}
    for it, stat in enumerate(simulate(grid, [2, 5, 1], np.argwhere(on), 12, 2.0)):
        marks = clusters.label(stat > 0.4)
        sizes = np.bincount(marks.ravel())[1:]
        assert got[it]["max_stat"] == pytest.approx(stat.max()) and got[it]["max_size"] == max(sizes, default=0)
    null = {r["bin"]: r["p"] for r in cbma.monte_carlo_null(spark, foci, grid, 2.0, 12, 1 / 3).collect()}
    every = np.concatenate([s[on] for s in simulate(grid, [2, 5, 1], np.argwhere(on), 12, 2.0)])
    assert null == pytest.approx({b: (every >= b / 3 - 1e-9).mean() for b in range(int(round(every.max() * 3)) + 1)})
    sized = foci.withColumn("sample_size", F.lit(20.0))
    assert cbma.monte_carlo(spark, sized, grid.mask(spark), grid, 0.0, 3, kind="ale").where("max_stat > 0 and max_stat < 1").count() == 3


def test_gaussian_activation_matches_table_kernel(spark, ss):
    p = structure.with_sample_size(ss.point, ss.analysis)
    sizes = sorted({r["sample_size"] for r in p.select("sample_size").distinct().collect()})
    want = {(r["id"], r["voxel"]): r["value"] for r in kernels.ale(p, kernels.ale_kernels(spark, sizes, GRID.size), GRID, ["sample_size"]).collect()}
    rows = kernels.ale_gaussian(p, GRID).collect()
    assert {(r["id"], r["voxel"]): r["value"] for r in rows} == pytest.approx(want)
    logs = {r["voxel"]: r["log_none"] for r in kernels.ale_log_sums(p, GRID).collect()}
    sums = {}
    for (_, v), x in want.items():
        sums[v] = sums.get(v, 0.0) + math.log1p(-x)
    assert logs == pytest.approx(sums)


def test_permuted_labels_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, float(rng.uniform(0.01, 0.3))) for i in range(9) for v in range(12) if rng.random() < 0.6]
    ma = spark.createDataFrame(rows, "id long, voxel long, value double")
    one, two = (spark.createDataFrame([(i,) for i in range(*r)], "id long") for r in ((0, 4), (4, 9)))
    mask = spark.range(14).select(F.col("id").alias("voxel"))
    got = {r["voxel"]: r for r in cbma.ale_difference(ma, one, two, mask, 30).collect()}
    cuts = cbma.label_cuts(one.union(two), 4, 30)
    h = [r["h"] for r in spark.range(9).select(F.xxhash64("id").alias("h")).collect()]
    labels = cbma._draws(np.array(h), np.arange(30), 0).astype(np.int64) <= cuts
    assert (labels.sum(0) == 4).all() and len({tuple(x) for x in labels.T}) > 20
    def stat(first):
        s = np.zeros((2, 14))
        for i, v, x in rows:
            s[0 if first[i] else 1, v] += math.log1p(-x)
        return np.exp(s[1]) - np.exp(s[0])
    seen = stat(np.arange(9) < 4)
    perms = np.array([stat(labels[:, it]) for it in range(30)])
    for v in {r[1] for r in rows}:
        p = 2 * min((perms[:, v] >= seen[v] - 1e-15).sum(), (perms[:, v] <= seen[v] + 1e-15).sum()) / 30
        assert got[v]["stat"] == pytest.approx(seen[v]) and got[v]["p"] == pytest.approx(min(max(p, 1 / 30), 29 / 30))
    assert got[13]["stat"] == 0 and got[13]["p"] == 1
    maxima = [r["max_stat"] for r in cbma.difference_maxima(ma, one, two, 30).orderBy("iteration").collect()]
    assert maxima == pytest.approx(np.abs(perms).max(1))
    with pytest.raises(ValueError, match="share"):
        cbma.ale_difference(ma, one, one, mask)
    ids = spark.createDataFrame([(v, 1 if v % 2 else -1) for v in range(14)], "voxel long, sign int")
    assert all(r["stat"] * (1 if r["voxel"] % 2 else -1) >= 0 for r in cbma.ale_difference(ma, one, two, mask, 5, within=ids).collect())


def test_mask_of_any_voxels(spark, ss):
    on = np.zeros(GRID.shape, bool)
    on[4, 4, 4] = on[2, 1, 1] = True
    grid = GRID.with_mask(on)
    assert (grid.mask_array() == on).all() and sorted(r["voxel"] for r in grid.mask(spark).collect()) == np.flatnonzero(on).tolist()
    assert ids(selection.by_mask(ss.point, grid)) == [1, 3] and selection.focus_filter(ss.point, grid).count() == 2
    assert {(r["id"], r["voxel"]) for r in kernels.mkda(ss.point, grid, 0.0).collect()} == {(1, int(np.ravel_multi_index((2, 1, 1), GRID.shape))), (3, int(np.ravel_multi_index((4, 4, 4), GRID.shape)))}
    uneven = Grid(4, 5, 6, (2.0, -3.0, 4.0), (-4.0, 9.0, 0.0))
    row = spark.range(1).select(*[uneven.to_voxel(F.lit(mm), a).alias(a) for a, mm in zip("xyz", (0.0, 3.0, 9.0))], uneven.to_mm(F.lit(2), "y").alias("back")).first()
    assert tuple(row) == (2, 2, 2, 3.0)
    assert len(kernels.sphere(4.0, (2.0, 4.0, 8.0))) == len([1 for a in range(-2, 3) for b in (-1, 0, 1) if 4 * a * a + 16 * b * b <= 16])


def test_ranges_hold_about_as_many(spark):
    rows = spark.range(20000).select((-F.col("id") / 20000).alias("x")).union(spark.createDataFrame([(-3000.0,), (None,)], "x double"))
    sizes = [r["n"] for r in cbma.in_ranges(rows.where("x is not null"), "x", 64).groupBy("_b_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 55 and max(sizes) < 1500
    again = cbma.in_ranges(rows, "x", 8).groupBy("x").agg(F.count_distinct("_b_").alias("n")).where("n > 1")
    assert again.count() == 0


def test_brainmap_decoding_matches_brute_force(spark, tiny):
    from quillmap.operators import decode

    p, n, s = proxy.points(spark, tiny), proxy.annotations(spark, tiny), proxy.selected(spark, tiny)
    foci = {r["id"]: r["count"] for r in p.groupBy("id").count().collect()}
    selected = {r["id"] for r in s.collect()} & foci.keys()
    has = {}
    for r in n.collect():
        if r["value"] >= 0.001 and r["id"] in foci:
            has.setdefault(r["label"], set()).add(r["id"])
    uses, every, n_sel = sum(map(len, has.values())), sum(foci.values()), len(selected)
    share = n_sel / every
    post = {}
    for label, own in has.items():
        post[label] = len(own & selected) / sum(foci[i] for i in own) * len(own) / uses / share
    mean = np.mean([len(o & selected) for o in has.values()])
    for r in decode.decode_brainmap(p, n, s).collect():
        own = has[r["label"]]
        a, b, f = len(own & selected), len(own - selected), sum(foci[i] for i in own)
        tail = math.fsum(math.exp(math.lgamma(f + 1) - math.lgamma(k + 1) - math.lgamma(f - k + 1) + k * math.log(share) + (f - k) * math.log(1 - share)) for k in range(a + 1, f + 1))
        assert r["p_forward"] == pytest.approx(1.0 if a < 5 else tail, rel=1e-8)
        assert r["likelihood_forward"] == pytest.approx(a / f / share) and r["prob_reverse"] == pytest.approx(post[r["label"]] / sum(post.values()))
        assert r["z_forward"] == 0 or (r["z_forward"] > 0) == (a > mean)
        n1, n2 = n_sel, len(foci) - n_sel
        chi2 = (n1 + n2) * (a * n2 - b * n1) ** 2 / ((a + b) * (n1 + n2 - a - b) * n1 * n2)
        sign = np.sign(a / f - (n1 - a) / (every - f))
        assert r["z_reverse"] == pytest.approx(0.0 if a < 5 else sign * math.sqrt(chi2), rel=1e-6, abs=1e-9)


def test_closure_of_a_long_chain(spark):
    rel = spark.createDataFrame([(f"t{i:02d}", f"t{i + 1:02d}", 1.0) for i in range(70)], "input string, output string, weight double")
    out = text.closure(rel)
    assert out.count() == 71 * 70 // 2 and out.where("weight <> 1").count() == 0


def test_sleuth_keeps_analyses_without_a_size(spark, ss):
    a = ss.analysis.withColumn("sample_size", F.when(F.col("id") == 2, F.lit(None)).otherwise(F.col("sample_size")))
    rows = {r["id"]: r["value"] for r in sleuth.blocks(ss.point, a).collect()}
    assert rows.keys() == {1, 2, 3} and "Subjects" not in rows[2] and rows[2].count("\t") == 2 and "Subjects=20" in rows[1]


def test_correction_without_z_is_an_error(ss):
    with pytest.raises(ValueError, match="unknown correction"):
        workflows.run(ss, "kda", "magic")
    with pytest.raises(ValueError, match="unknown diagnostics"):
        workflows.run(ss, "kda", None, diagnose=("magic",))


@pytest.mark.parametrize(("name", "options"), [("mkdadensity", {"r": 2.0}), ("kda", {"r": 2.0}), ("ale", {"fwhm": 4.0, "step": 1e-3})])
def test_family_wise_correction_of_coordinates(spark, ss, name, options):
    result = workflows.run(ss, name, "montecarlo", threshold=1.0, n_iters=20, **options)
    p = result.maps["p_level-voxel_corr-FWE_method-montecarlo"]
    assert p.count() == 216 and p.where("value < 0.05 or value > 0.95").count() == 0
    table = result.tables["clusters_corr-FWE_method-montecarlo"].collect()
    assert table and all(0.05 <= r["p_size"] <= 0.95 and 0.05 <= r["p_mass"] <= 0.95 for r in table)
    again = workflows.run(ss, name, "bonferroni", threshold=1.0, **options)
    assert again.maps["z_corr-FWE_method-bonferroni"].count() == 216


def test_named_pairwise_estimators(spark, ss):
    one = ss.analysis.where("id < 2").select("id")
    out = workflows.run(ss, "alesubtraction", "montecarlo", n_iters=10, group1=one, fwhm=4.0)
    assert out.maps["stat"].count() == 216 and out.maps["z_level-voxel_corr-FWE_method-montecarlo"].count() == 216
    pool = ss.point.where("i < 6").select("i", "j", "k")
    out = workflows.run(ss, "scale", "bh", n_iters=10, pool=pool, fwhm=4.0)
    assert out.maps["stat"].where("p < 0.1 or p > 1").count() == 0
    chi = workflows.run(ss, "mkdachi2", "montecarlo", n_iters=10, group1=one, r=2.0)
    assert chi.maps["p_level-voxel_corr-FWE_method-montecarlo"].count() == 216
    with pytest.raises(ValueError, match="no permutations"):
        workflows.run(ss, "scale", "montecarlo", n_iters=5, pool=pool, fwhm=4.0)


def test_image_outputs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i // 2, v, float(rng.normal(0.4, 1)), float(rng.uniform(0.1, 1))) for i in range(10) for v in range(4)]
    im = spark.createDataFrame(rows, "id long, study_id long, voxel long, value double, varcope double")
    from quillmap.functions import special

    for r in ibma.random_effects(im).collect():
        y, v = (np.array([x[c] for x in rows if x[2] == r["voxel"]]) for c in (3, 4))
        w = 1 / (v + r["tau2"])
        est = (w * y).sum() / w.sum()
        se = math.sqrt((w * (y - est) ** 2).sum() / 9 / w.sum())
        ln_p = special.t_to_nlogp(np.array([est / se]), np.array([9.0]))[0]
        assert (r["est"], r["se"], r["dof"]) == pytest.approx((est, se, 9.0)) and r["p"] == pytest.approx(math.exp(ln_p)) and r["logp"] == pytest.approx(-ln_p / math.log(10))
        assert special.z_to_nlogp(np.array([r["z"]]))[0] == pytest.approx(ln_p)
    plain, tied = (ibma.stouffers(im, correlation=c).orderBy("voxel").collect() for c in (0.0, 1.0))
    for a, b in zip(plain, tied):
        total = sum(x[3] for x in rows if x[2] == a["voxel"])
        assert a["z"] == pytest.approx(total / math.sqrt(10)) and b["z"] == pytest.approx(total / math.sqrt(5 * 4))
    some = im.where("id % 3 <> 0 or voxel <> 1")
    want = {(a, b): None for a in range(10) for b in range(a + 1, 10)}
    got = {(r["a"], r["b"]): r["r"] for r in ibma.image_correlations(some).collect()}
    assert got.keys() == want.keys()
    value = {(x[0], x[2]): x[3] for x in rows if x[0] % 3 or x[2] != 1}
    for a, b in got:
        both = [v for v in range(4) if (a, v) in value and (b, v) in value]
        assert got[a, b] == pytest.approx(np.corrcoef([value[a, v] for v in both], [value[b, v] for v in both])[0, 1])


def test_image_correlations_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    im = spark.createDataFrame([(i, v, float(rng.normal())) for i in range(20) for v in range(6)], "id long, voxel long, value double")
    whole = sorted(map(tuple, ibma.image_correlations(im).collect()))
    monkeypatch.setattr(ibma, "BLOCK_VALUES", 30)
    parts = sorted(map(tuple, ibma.image_correlations(im).collect()))
    assert len(whole) == len(parts) == 190 and all(a == pytest.approx(b) for a, b in zip(whole, parts))


def test_peaks_keep_their_distance(spark):
    volume = np.zeros(GRID.shape)
    volume[0, 0, :6] = [5, 1, 4, 1, 3, 1]
    rows = spark.createDataFrame([(int(v), float(x)) for v, x in enumerate(volume.ravel())], "voxel long, value double")
    assert [(r["rank"], r["voxel"]) for r in diagnostics.peaks(rows, GRID, 0.5, 4.0, 9).orderBy("rank").collect()] == [(1, 0), (2, 2), (3, 4)]
    assert [(r["rank"], r["voxel"]) for r in diagnostics.peaks(rows, GRID, 0.5, 8.0, 9).orderBy("rank").collect()] == [(1, 0), (2, 4)]
    assert diagnostics.peaks(rows, GRID, 0.5).count() == 1


def test_leave_one_out_support_matches_schedule(spark):
    rng = np.random.default_rng(8)
    ma = spark.createDataFrame([(i, v, float(rng.uniform(0.05, 0.4))) for i in range(7) for v in range(9) if rng.random() < 0.5], "id long, voxel long, value double")
    ids_, mask = spark.range(8), spark.range(10).select(F.col("id").alias("voxel"))
    want = {r["voxel"]: r["support"] for r in diagnostics.stability(ma, diagnostics.leave_one_out(ids_), 0.4, mask).collect()}
    assert {r["voxel"]: r["support"] for r in diagnostics.leave_one_out_support(ma, ids_, 0.4, mask).collect()} == pytest.approx(want)


def test_fdr_brute_force(spark):
    p = np.array([0.01, 0.02, 0.03, 0.5, 0.02, 1.0])
    rows = spark.createDataFrame([(i, float(np.log(v))) for i, v in enumerate(p)] + [(9, None)], "i long, nlogp double")
    got = {r["i"]: r["corrected"] for r in correction.fdr(rows).collect()}
    order = np.argsort(p)[::-1]
    low, want = 1.0, {}
    for n, i in enumerate(order):
        low = min(low, p[i] * len(p) / (len(p) - n))
        want[int(i)] = low
    assert {i: math.exp(v) for i, v in got.items() if v is not None} == pytest.approx(want) and got[9] is None
    with pytest.raises(ValueError, match="unknown"):
        correction.correct(rows, "fdr_bh")


def test_cluster_labels(spark):
    on = np.zeros((6, 6, 6), bool)
    on[0, 0, :2] = on[0, 1, 1] = on[3, 3, 3] = True
    marks = clusters.label(on)
    assert sorted(np.unique(marks)) == [0, 1, 2] and (marks > 0).sum() == 4
    stat = spark.createDataFrame([(int(v), 3.0) for v in np.flatnonzero(on)] + [(200, -4.0)], "voxel long, stat double")
    table = {(r["tail"], r["size"]) for r in clusters.cluster_table(stat, GRID, 2.0).collect()}
    assert table == {("PositiveTail", 3), ("PositiveTail", 1), ("NegativeTail", 1)}


def test_image_estimators(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i // 2, v, float(rng.normal(0.5, 1)), float(rng.uniform(0.1, 1))) for i in range(12) for v in range(3)]
    im = spark.createDataFrame(rows, "id long, study_id long, voxel long, value double, varcope double")
    ml = {r["voxel"]: r for r in ibma.likelihood(im).collect()}
    for v in range(3):
        y, s = (np.array([r[c] for r in rows if r[2] == v]) for c in (3, 4))
        def loss(t):
            w = 1 / (s + t)
            return 0.5 * (np.log(s + t).sum() + (w * (y - (w * y).sum() / w.sum()) ** 2).sum())
        assert loss(ml[v]["tau2"]) <= min(map(loss, np.linspace(0, 4, 400))) + 1e-6
    maxima = ibma.sign_flips(im, 20)
    assert maxima.count() == 20 and maxima.where("max_stat > 0").count() == 20
    assert ibma.valid(im.withColumn("value", F.when(F.col("voxel") == 0, F.lit(0.0)).otherwise(F.col("value"))), aggressive=True).where("voxel = 0").count() == 0
    single = ibma.one_sample_t(im.where("study_id = 0")).first()
    assert single["t"] is None and single["dof"] is None


def test_meta_regression_recovers_counts(spark):
    rng = np.random.default_rng(0)
    pts, mods = [], []
    for i in range(60):
        group = i % 2
        mods.append((i, float(group)))
        pts += [(i, int(x), int(y), int(z)) for x, y, z in rng.integers(0, 6, (4 + 8 * group, 3))]
    p = spark.createDataFrame(pts, "id long, i long, j long, k long")
    m = spark.createDataFrame(mods, "id long, g double")
    model = cbmr.fit(p, m, GRID, ["g"], spacing=3)
    assert math.exp(model["gamma"][0]) == pytest.approx(3.0, rel=0.01)
    assert model["intensity"].sum() * 30 * (1 + math.exp(model["gamma"][0])) == pytest.approx(len(pts), rel=0.01)
    assert abs(cbmr.moderator_z(model)[0]) > 5
    one = cbmr.fit(p, m, GRID, spacing=3)
    assert np.abs(cbmr.compare_groups(one, one)).max() == 0
    assert cbmr.contrast_matrix("A-B", ["A", "B", "C"]).tolist() == [0.5, -0.5, 0.0]


def test_subsets():
    assert diagnostics.subsets(4, 3) == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    many = diagnostics.subsets(30, 10, 50)
    assert len(many) == 50 and many == sorted(set(many))


def test_ontology_order_and_closure(spark):
    onto = spark.createDataFrame([("trm1", "working memory", "WM (memory), short store"), ("trm2", "memory", None)], "id string, name string, alias string")
    forms = text.alias_forms(onto)
    docs = spark.createDataFrame([(1, "Working memory and memory; WM, WM."), (2, None)], "id long, text string")
    got = {(r["id"], r["name"]): r["n"] for r in text.ontology_counts(docs, forms).collect()}
    assert got == {(1, "trm1"): 3, (1, "trm2"): 1}
    w = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 1.0)], "input string, output string, weight double")
    out = {(r["input"], r["output"]): r["weight"] for r in text.closure(w).collect()}
    assert out[("a", "c")] == 0.25 and out[("c", "b")] == 0.5


def test_topics(spark):
    docs = spark.createDataFrame([(i, ("apple pear plum fruit " if i % 2 else "iron steel metal ore ") * 4) for i in range(20)], "id long, text string")
    words, shares = text.lda(docs, 2)
    assert shares.groupBy("id").agg(F.sum("value").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert words.select("name").distinct().count() == 2


def test_native_functions(spark):
    row = spark.createDataFrame([(" Variance Map", "[20, 30]", "25")], "t string, l string, s string").select(native.image_type(F.col("t")).alias("t"), native.sample_size(F.col("l"), F.col("s")).alias("n"), native.sample_size(F.lit(None).cast("string"), F.col("s")).alias("m"), native.group_name(F.lit("abC"), F.lit("dE")).alias("g")).first()
    assert (row["t"], row["n"], row["m"], row["g"]) == ("varcope", [20.0, 30.0], [25.0], "AbcDe")
    t = native.mni_to_tal(F.lit(10.0), F.lit(-20.0), F.lit(30.0))
    back = spark.range(1).select(*[c.alias(n) for c, n in zip(native.tal_to_mni(*t), "xyz")]).first()
    assert tuple(back) == pytest.approx((10.0, -20.0, 30.0))


def test_sleuth_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("// Reference=Talairach\n// Smith et al., 2001; task\n// Jones, 1999: rest\n// Subjects=12\n1 2 3\n4\t5\t6\n\n// Lee 2010: go\n// Subjects=8\n-1 0 2.5\n")
    rows = sleuth.read(spark, str(tmp_path / "in"))
    got = sorted((r["study"], r["contrast"], r["sample_size"], r["x"], r["space"]) for r in rows.collect())
    assert got == [("Jones, 1999", "rest", 12, 1.0, "TAL"), ("Jones, 1999", "rest", 12, 4.0, "TAL"), ("Lee 2010", "go", 8, -1.0, "TAL"), ("Smith et al., 2001", "task", 12, 1.0, "TAL"), ("Smith et al., 2001", "task", 12, 4.0, "TAL")]
    with pytest.raises(ValueError, match="unknown space"):
        list(sleuth.parse("// Reference=Dog\n"))
    a = rows.select(F.concat_ws("|", "study", "contrast").alias("id"), F.col("study").alias("study_id"), "sample_size").distinct()
    sleuth.write(rows.select(F.concat_ws("|", "study", "contrast").alias("id"), "x", "y", "z"), a, str(tmp_path / "out"))
    again = "".join(r["value"] + "\n" for r in spark.read.text(str(tmp_path / "out")).collect())
    assert again.count("// Reference=MNI") >= 1 and again.count("Subjects=12") == 2


def test_nested_json_and_parquet(spark, tmp_path):
    doc = {"id": "s", "studies": [{"id": "st", "name": "None", "analyses": [{"id": "a1", "name": "n", "metadata": {"sample_sizes": "[10]"}, "points": [{"coordinates": [1, 2, 3], "space": "MNI"}, {"coordinates": [4, 5, 6]}], "annotations": {"x": {"label": "0.5"}}, "texts": {"abstract": "t"}}, {"name": "empty"}]}, {"analyses": []}]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    ss = nimads.read(spark, str(path))
    assert ids(ss.analysis) == ["st-a1", "st-analysis-1"]
    assert [(r["x"], r["point_pos"]) for r in ss.point.orderBy("point_pos").collect()] == [(1.0, 0), (4.0, 1)]
    assert ss.annotation.first()["value"] == 0.5 and ss.analysis.first()["study_id"] == "st"
    tables.write(ss.with_(analysis=ss.analysis.select("id", "study_id", "contrast_id")), str(tmp_path / "t"))
    assert tables.read(spark, str(tmp_path / "t")).point.count() == 2
    with pytest.raises(Exception, match="exist"):
        tables.write(ss.with_(analysis=ss.analysis.select("id")), str(tmp_path / "t"))
    nimads.write(ss, str(tmp_path / "out"))
    again = nimads.read(spark, str(tmp_path / "out"))
    assert ids(again.analysis) == ids(ss.analysis) and again.point.count() == 2 and again.annotation.count() == 1


def test_nested_json_keeps_everything(spark, tmp_path):
    doc = {"studies": [{"id": "b", "name": "B", "authors": "X, Y", "doi": "10/1", "year": 2001, "analyses": [{"id": "2", "name": "two", "points": [{"coordinates": [1.0, 2.0, 3.0], "space": "MNI", "values": [{"kind": "z", "value": 3.5}]}], "images": [{"url": "u", "filename": "f", "value_type": "z"}], "texts": {"abstract": 'say "hi"'}, "annotations": {"n": {"l": "1"}}, "conditions": [{"name": "c1"}], "weights": [0.5], "metadata": {"sample_sizes": "[4, 6]"}}, {"id": "1", "name": "one"}]}, {"id": "a", "analyses": [{"id": "1"}], "metadata": {"sample_size": "9"}}]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    ss = nimads.read(spark, str(path))
    nimads.write(ss, str(tmp_path / "one"))
    nimads.write(ss, str(tmp_path / "many"), whole=False)
    for again in (nimads.read(spark, str(tmp_path / "one")), nimads.read(spark, str(tmp_path / "many"), lines=True)):
        for name in ("point", "image", "text", "annotation"):
            a, b = (sorted(str(r) for r in getattr(x, name).collect()) for x in (ss, again))
            assert a == b, name
        rows = {r["id"]: r for r in again.analysis.collect()}
        assert rows["b-2"]["sample_size"] == [4.0, 6.0] and rows["b-1"]["sample_size"] is None
        assert [(c["condition"]["name"], c["weight"]) for c in rows["b-2"]["conditions"]] == [("c1", 0.5)]
        assert {(r["study_id"], r["authors"], r["doi"], r["year"]) for r in again.study.collect()} == {("b", "X, Y", "10/1", 2001), ("a", None, None, None)}
    assert {r["id"]: r["sample_size"] for r in ss.analysis.collect()}["a-1"] == [9.0]
    assert [r["analysis_pos"] for r in spark.createDataFrame([], "analysis_pos int").collect()] == []


def test_edits_and_projections(spark, ss):
    wide = spark.createDataFrame([(1, 0.0, 2.0), (4, 1.0, 0.0)], "id long, `g__x y` double, g__z double")
    more = ss.add_annotations(wide, "new", dense=True)
    assert {(r["id"], r["label"], r["value"]) for r in more.annotation.where("annotation_id = 'new'").collect()} == {(1, "g__z", 2.0), (4, "g__x y", 1.0)}
    assert {r["label"] for r in more.labels("g").collect()} == {"g__x y", "g__z"}
    assert {r["id"]: r["age"] for r in ss.add_metadata("age", spark.createDataFrame([(2, 30)], "id long, value int")).field("age").collect()} == {1: None, 2: 30, 3: None, 4: None}
    with pytest.raises(ValueError, match="unknown field"):
        ss.field("nothing")
    assert ss.keep("point", F.col("i") > 3).point.count() == 2 and ss.keep("point", F.col("i") > 3).analysis.count() == 4
    assert [r["id"] for r in ss.in_order().point.collect()] == [1, 1, 2, 3, 3]
    text_rows = Studyset(ss.analysis, text=spark.createDataFrame([(1, "abstract", "t")], "id long, field string, text string"))
    assert text_rows.texts("abstract").first()["text"] == "t"
    with pytest.raises(ValueError, match="unknown text"):
        text_rows.texts("body")
    keyed, moved = structure.combine_analyses(ss.analysis.withColumn("name", F.concat(F.lit("n"), "id")), ss.point)
    assert {r["study_id"]: (r["combined"], r["name"]) for r in keyed.collect()}[10] == ("1_2", "n1; n2") and moved.where("id = '1_2'").count() == 3


def test_decoder_object(spark, tiny):
    from quillmap.operators import decode

    p, n, s = proxy.points(spark, tiny), proxy.annotations(spark, tiny), proxy.selected(spark, tiny)
    grouped = n.withColumn("label", F.concat(F.lit("g__"), "label"))
    one = decode.Decoder(group="g", features=["Brand#11", "g__Brand#12"], correction=None).fit(p, grouped).transform(s)
    assert {r["label"] for r in one.collect()} == {"g__Brand#11", "g__Brand#12"}
    assert decode.Decoder("brainmap").fit(p, grouped).transform(s).count() == 25
    with pytest.raises(ValueError, match="no label"):
        decode.Decoder(group="h").fit(p, grouped)


def test_spaces_and_sleuth_studysets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("// Reference=TAL\n// Lee 2010: go\n// Subjects=8\n10 -20 30\n")
    own = sleuth.to_studyset(sleuth.read(spark, str(tmp_path / "a.txt")))
    assert own.analysis.first()["id"] == "Lee 2010-go" and own.analysis.first()["sample_size"] == 8
    moved = sleuth.in_space(own.point, "MNI")
    back = sleuth.in_space(moved, "TAL").first()
    assert moved.first()["x"] != 10.0 and (back["x"], back["y"], back["z"]) == pytest.approx((10.0, -20.0, 30.0))
    with pytest.raises(Exception, match="unknown space"):
        sleuth.in_space(own.point.withColumn("space", F.lit("DOG")), "MNI").collect()


def test_group_contrasts(spark):
    rng = np.random.default_rng(1)
    pts = [(i, *map(int, rng.integers(0, 6, 3))) for i in range(20) for _ in range(20)]
    p = spark.createDataFrame(pts, "id long, i long, j long, k long")
    model = cbmr.fit(p, spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "id long, g double"), GRID, ["g"], spacing=3)
    chi2, dof, ln_p = cbmr.general_linear(model, [[2.0], [0.0], [2.0]])
    assert dof == 1 and chi2 == pytest.approx(cbmr.moderator_z(model)[0] ** 2) and math.exp(ln_p) == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    same, dof, _ = cbmr.group_contrast([model, model], [[1, -1]])
    assert np.abs(same).max() == 0 and dof == 1
    even, dof, ln_p = cbmr.group_contrast([model, model], [[1, 0], [0, 1]])
    assert dof == 2 and (even >= 0).all() and (ln_p <= 0).all()
    with pytest.raises(ValueError, match="zero"):
        cbmr.contrast_rows([[0.0, 0.0]])


def test_z_to_t_inverts():
    from quillmap.functions import special

    t, dof = np.array([-7.0, -0.3, 0.0, 2.0, 30.0]), np.array([3.0, 5.0, 5.0, 12.0, 4.0])
    assert special.z_to_t(special.t_to_z(t, dof), dof) == pytest.approx(t, abs=1e-9)


def test_synthetic_is_reproducible(spark):
    a, b = (tables.synthetic(spark, [(0, 0, 0), (10, 10, 10)], 20, n_noise=3).point for _ in range(2))
    assert a.count() == 20 * 5 and a.exceptAll(b.repartition(3)).count() == 0


def test_workflow(spark, tiny):
    ss = proxy.studyset(spark, tiny)
    some = ss.select(ss.analysis.where("id % 100 = 0"))
    result = workflows.run(some, "mkdachi2", "bh", threshold=0.5, group1=ss.analysis.where("status = 'O'"), r=4.0)
    assert set(result.tables) == {"clusters", "focus_counter", "jackknife"} and "z_corr-FDR_method-bh" in result.maps
    assert result.maps["z_corr-FDR_method-bh"].count() == 700
    with pytest.raises(ValueError, match="unknown estimator"):
        workflows.run(some, "magic")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id"))).alias("ts"), (F.col("id") % 3).cast("string").alias("label"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = label_counts.label_counts(label_counts.from_folder(spark, str(tmp_path / "in"), "ts timestamp, label string, value double"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").exceptAll(label_counts.label_counts(rows)).count() == 0


def test_word_and_coordinate_topics(spark):
    from quillmap.operators import topics

    rng = np.random.default_rng(0)
    counts, pts = [], []
    for d in range(30):
        g = d % 2
        counts += [(d, int(w), 2) for w in rng.choice(4, 3, replace=False) + 4 * g]
        pts += [(d, *map(float, rng.normal(30 * (2 * g - 1), 2, 3))) for _ in range(4)]
    model = topics.fit(spark.createDataFrame(counts, "id long, word long, n int"), spark.createDataFrame(pts, "id long, x double, y double, z double"), 2, 8, rounds=6, blocks=2)
    at = np.array([[-30.0] * 3, [30.0] * 3])
    low, high = topics.topic_given_voxel(model, at)
    assert low.argmax() != high.argmax() and model["word_given_topic"].sum(1) == pytest.approx([1.0, 1.0])
    words = topics.decode(model, at[:1], np.ones(1), topics.weight_priors(np.ones(2), 0.5))
    assert words[:4].sum() > 5 * words[4:].sum()
    text = topics.encode(model, np.array([3, 3, 3, 3, 0, 0, 0, 0.0]), at)
    assert text[0] > text[1]


def test_words_and_citations(spark):
    docs = spark.createDataFrame([(1, r"Colour of colour; see \citep[p. 2]{smith2001, lee99} and \cite{lee99}."), (2, None)], "id long, text string")
    out = {r["id"]: r["text"] for r in text.substitute_words(docs, {"colour": "color"}).collect()}
    assert out[1].startswith("Colour of color;") and out[2] is None
    assert sorted(r["key"] for r in text.citation_keys(docs).collect()) == ["lee99", "smith2001"]


def test_contrast_and_coactivation(spark, tiny):
    ss = proxy.studyset(spark, tiny)
    some = ss.select(ss.analysis.where("id % 150 = 0"))
    g1, g2 = (some.analysis.where(c).select("id") for c in ("status = 'O'", "status <> 'O'"))
    maps = workflows.contrast(some, g1, g2, fwhm=4.0, r=4.0, step=1e-2).maps
    assert {m.count() for m in maps.values()} == {700}
    assert workflows.coactivation(some, (2, 3), fwhm=4.0, step=1e-2).maps["stat"].count() == 700
