"""Counts of round 3's findings: right where analyses meet their labels, and made once."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import cbma, coordinates, decode, ibma, kernels, text
from quillmap.plans.studyset import Grid

GRID = Grid(6, 7, 8, 2.0, 0.0, (1, 6))


def points(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(a), *map(int, rng.integers(-4, 12, 3))) for a in rng.integers(0, n, 4 * n)]
    return spark.createDataFrame([*rows, (n, None, 1, 1)], "id long, i long, j long, k long")


@pytest.mark.parametrize("most", [1 << 23, 1000])
def test_labelled_counts_agree_with_joins(spark, monkeypatch, most):
    monkeypatch.setattr(kernels, "LABEL_COUNTS", most)
    monkeypatch.setattr(kernels, "STAMPS", most)
    p = points(spark)
    rows = [(a, f"l{a % 5}") for a in range(70)] + [(a, "l9") for a in range(0, 70, 3)] + [(3, "l9"), (4, None)]
    labels = spark.createDataFrame(rows, "id long, label string")
    ma, ids = kernels.mkda(p, GRID, 4.0), p.select("id").distinct()
    named = labels.where("label is not null").join(ids, "id", "left_semi")
    want = ma.join(named, "id").groupBy("label", "voxel").count().unionByName(ma.groupBy("voxel").count().withColumn("label", F.lit(None).cast("string")))
    want = want.unionByName(named.groupBy("label").count().withColumn("voxel", F.lit(-1))).unionByName(ids.agg(F.count("*").alias("count")).select(F.lit(None).cast("string").alias("label"), F.lit(-1).alias("voxel"), "count"))
    got = kernels.mkda_labelled(p, labels, GRID, 4.0)
    assert {(r["label"], r["voxel"]): r["n"] for r in got.collect()} == {(r["label"], r["voxel"]): r["count"] for r in want.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_chi2_and_correlations_of_labelled_counts(spark):
    p, mask = points(spark), GRID.mask(spark)
    one = spark.createDataFrame([(a,) for a in range(0, 70, 3)], "id long")
    want = cbma.mkda_chi2(kernels.mkda(p, GRID, 4.0), one, p.select("id"), mask).orderBy("voxel").collect()
    out = cbma.mkda_chi2_of(kernels.mkda_labelled(p, one.withColumn("label", F.lit(1)), GRID, 4.0), mask)
    assert out.orderBy("voxel").collect() == want
    ann = spark.createDataFrame([(a, f"l{a % 5}", 0.5) for a in range(70)] + [(a, "l9", 0.0) for a in range(9)], "id long, label string, value double")
    target = mask.select("voxel", (F.col("voxel") % 7).cast("double").alias("value"))
    old = decode.correlation_decoder(kernels.mkda(p, GRID, 4.0), ann, p.select("id"), target, mask)
    new = decode.correlation_decoder_points(p, ann, GRID, 4.0, target)
    want = {r["label"]: r["r"] for r in old.collect()}
    got = {r["label"]: r["r"] for r in new.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_histograms_are_made_and_drawn_from_in_one_pass(spark):
    p, mask = points(spark), GRID.mask(spark)
    want = cbma.ale_histograms(kernels.kda(p, GRID, 4.0), mask.count(), 1.0)
    hist = kernels.kda_histograms(p, GRID, 4.0)
    assert {(r["id"], r["bin"]): r["share"] for r in hist.collect()} == {(r["id"], r["bin"]): r["share"] for r in want.collect()}
    total = np.zeros(200)
    for name, h in want.toPandas().sort_values(["id", "bin"]).groupby("id"):
        draws = np.random.default_rng([0, zlib.crc32(str(name).encode())]).random(200) * h["share"].sum()
        total += h["bin"].to_numpy()[np.searchsorted(np.cumsum(h["share"].to_numpy()), draws, "right").clip(0, len(h) - 1)]
    tail = {int(b): (total >= b).mean() for b in np.unique(total)}
    for out in (cbma.reduced_null(spark, hist, 200, 1.0, additive=True, dealt=True), cbma.reduced_null(spark, want, 200, 1.0, additive=True)):
        got = {r["bin"]: r["p"] for r in out.collect()}
        assert all(abs(got[b] - x) < 1e-12 for b, x in tail.items())
    plan = cbma.reduced_null(spark, hist, 200, 1.0, additive=True, dealt=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan


@pytest.mark.parametrize("method", ["ML", "REML"])
def test_likelihoods_multiply_no_rows(spark, method):
    rng = np.random.default_rng(3)
    rows = [(int(v), float(rng.normal(0.3, 0.5)), float(rng.uniform(0.05, 0.3))) for v in range(3) for _ in range(40)]
    im = spark.createDataFrame(rows, "voxel long, value double, varcope double")
    out = ibma.likelihood(im, method)
    assert "Generate" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        y, v = np.array([x[1:] for x in rows if x[0] == r["voxel"]]).T

        def loss(t):
            w = 1 / (v + t)
            out = 0.5 * (np.log(v + t).sum() + (w * y * y).sum() - (w * y).sum() ** 2 / w.sum())
            return out + 0.5 * np.log(w.sum()) if method == "REML" else out

        grid = np.linspace(0, 4 * y.var(), 20001)
        best = grid[np.argmin([loss(t) for t in grid])]
        assert abs(r["tau2"] - best) < 1e-3 and abs(r["est"] - (y / (v + best)).sum() / (1 / (v + best)).sum()) < 1e-3


@pytest.mark.parametrize("subpeaks,least", [(True, 0), (False, 0), (True, 3)])
def test_peaks_of_many_images_at_once(spark, monkeypatch, subpeaks, least):
    monkeypatch.setattr(coordinates, "VOLUME_VOXELS", 3 * 336)
    rng = np.random.default_rng(5)
    volumes = np.round(rng.normal(0, 2, (11, *GRID.shape)), 1)
    rows = [(i, int(v), float(x)) for i, vol in enumerate(volumes) for v, x in enumerate(vol.ravel())]
    out = coordinates.image_peaks(spark.createDataFrame(rows, "id long, voxel long, value double"), GRID, 1.0, least, 5.0, True, subpeaks)
    want, most = set(), coordinates.MOST if subpeaks else 0
    for i, vol in enumerate(volumes):
        for sign in (1, -1):
            want |= {(i, c, r, v, sign * x) for c, r, v, x in coordinates.peaks_of(sign * vol, GRID.matrix[:, :3], 1.0, least, 5.0, most)}
    assert {tuple(r) for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_where_texts_are(spark, monkeypatch):
    monkeypatch.setattr(text, "TASK_TERMS", 20)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 12, i % 9))) for i in range(80)] + [(80, None), (81, ""), (5, "w1 w2 w1"), (82, "\u00c4b \u00e4B x1, x1")]
    docs = spark.createDataFrame(rows, "id long, text string")
    terms = text.tokens(docs).select("id", F.explode("terms").alias("label")).groupBy("id", "label").count()
    df = terms.groupBy("label").agg(F.count("*").alias("df")).where(f"df >= 3 and df <= {0.5 * len(rows)}")
    want = {(r["id"], r["label"]): (r["count"], r["df"]) for r in terms.join(df, "label").collect()}
    out = text.term_counts(docs, min_df=3)
    assert {(r["id"], r["label"]): (r["n"], r["df"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in plan and "ReusedExchange" in plan


def test_pairs_of_images_shuffle_few_copies(spark, monkeypatch):
    """A block has no more images than a task holds values for; before, blocks grew with the images, and each value was a row in all of them."""
    monkeypatch.setattr(ibma, "BLOCK_IMAGES", 4)
    monkeypatch.setattr(ibma, "BLOCKS", 3)
    rng = np.random.default_rng(11)
    value = np.round(rng.normal(size=(40, 6)), 3)
    value[7] = 0.1  # no variance
    gone = {(3, 1), (3, 2), (3, 3), (3, 4), (3, 5), (9, 0), (20, 4)}
    rows = [(i, v, float(value[i, v])) for i in range(40) for v in range(6) if (i, v) not in gone]
    for some, holes in ((rows, gone), ([r for r in rows if r[0] not in (3, 9, 20)], set())):
        out = ibma.image_correlations(spark.createDataFrame([*some, (5, 99, None)], "id long, voxel long, value double"))
        kept = sorted({r[0] for r in some})
        got = {(r["a"], r["b"]): r["r"] for r in out.collect()}
        assert len(got) == out.count() == sum(len({v for v in range(6) if not {(a, v), (b, v)} & holes}) > 1 for a in kept for b in kept if a < b)
        for (a, b), r in got.items():
            both = [v for v in range(6) if not {(a, v), (b, v)} & holes]
            if 7 in (a, b):
                assert np.isnan(r) or holes
            else:
                assert abs(r - np.corrcoef(value[a, both], value[b, both])[0, 1]) < 1e-12
        assert out.rdd.getNumPartitions() == 6  # pairs of three blocks


def test_weights_meet_points_and_no_activations_are_sent(spark):
    """before, the planner took a task's activations for few rows and sent them all to the driver."""
    p, mask = points(spark).where("i is not null"), GRID.mask(spark)
    weights = spark.createDataFrame([(i, 0.5 + i % 7) for i in range(60)], "id long, weight double")
    ma = kernels.mkda(p, GRID, 4.0)
    old, new = cbma.mkda_density(ma, weights, mask), cbma.mkda_density_points(p, weights, GRID, 4.0, mask)
    want = {r["voxel"]: r["s"] for r in ma.toPandas().merge(weights.toPandas(), "left", "id").fillna(0).groupby("voxel")["weight"].sum().rename("s").reset_index().to_dict("records")}
    for out in (old, new):
        got = {r["voxel"]: r["stat"] for r in out.collect()}
        assert len(got) == mask.count() and all(abs(x - want.get(v, 0.0)) < 1e-9 for v, x in got.items())
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id" not in plan and "SortMergeJoin [id" in plan


def test_leave_one_out_goes_by_counts_of_values(spark):
    """before, all activations were joined with the sums of their voxels, and sent to the driver for it."""
    from quillmap.operators import diagnostics

    rng, mask = np.random.default_rng(2), GRID.mask(spark)
    p = spark.createDataFrame([(int(a), *map(int, rng.integers(1, 5, 3))) for a in rng.integers(0, 9, 36)], "id long, i long, j long, k long")
    steps = [(0, 0, 0, 0.25), (1, 0, 0, 0.125), (-1, 0, 0, 0.125), (0, 1, 0, 0.125), (0, 0, 1, 0.2)]
    kernel = spark.createDataFrame(steps, "di int, dj int, dk int, v double")
    ma, counts = kernels.ale(p, kernel, GRID), kernels.ale_counts(p, kernel, GRID)
    want = {(r["voxel"], r["value"]): r["count"] for r in ma.groupBy("voxel", "value").count().collect()} | {(-1, 0.0): ma.select("id").distinct().count()}
    assert {(r["voxel"], r["value"]): r["n"] for r in counts.collect()} == want
    n = counts.where("voxel = -1").select(F.col("n").cast("double").alias("n"))
    by_schedule = diagnostics.stability(ma, diagnostics.leave_one_out(ma.select("id").distinct()), 0.19, mask)
    new = diagnostics.leave_one_out_of_counts(counts.where("voxel >= 0"), n, 0.19, mask)
    old = diagnostics.leave_one_out_support(ma, ma.select("id"), 0.19, mask)
    want = {r["voxel"]: r["support"] for r in by_schedule.collect()}
    assert len(set(want.values())) > 2
    for out in (new, old):
        assert {r["voxel"]: r["support"] for r in out.collect()} == pytest.approx(want)
    assert "BroadcastHashJoin [id" not in old._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most,once", [(1 << 22, False), (1000, True)])
def test_null_of_spheres_from_kinds_of_histograms(spark, monkeypatch, most, once):
    """before, each analysis' voxels were rows of three shuffles, and its histogram was a row."""
    monkeypatch.setattr(kernels, "STAMPS", most)
    monkeypatch.setattr(kernels, "TASK_KINDS", 3)
    p, n = points(spark, 90), GRID.mask(spark).count()
    ma = kernels.mkda(p, GRID, 4.0) if once else kernels.kda(p, GRID, 4.0)
    sums = kernels.mkda_summary(p, GRID, 4.0) if once else kernels.kda_sums(p, GRID, 4.0)
    want = {r["voxel"]: r["s"] for r in ma.groupBy("voxel").agg(F.sum("value").alias("s")).collect()}
    assert {r["voxel"]: float(r["n"]) for r in sums.collect()} == want
    hist = cbma.ale_histograms(ma, n, 1.0).toPandas()
    kinds = {}
    for _, h in hist.sort_values(["id", "bin"]).groupby("id"):
        key = tuple((int(b), round(s, 12)) for b, s in zip(h["bin"], h["share"]) if s)
        kinds[key] = kinds.get(key, 0) + 1
    out = kernels.histogram_kinds(p, GRID, 4.0, once)
    assert {tuple((x["bin"], round(x["share"], 12)) for x in r["h"]): r["times"] for r in out.collect()} == kinds
    top = int(max(want.values())) + 1
    for exact in (8192, 5):
        monkeypatch.setattr(cbma, "FOLD_EXACT", exact)
        old = cbma.mkda_null(ma, n) if once else cbma.kda_null(ma, n)
        new = cbma.sphere_null(p, GRID, 4.0, top, once)
        upto = max(len(old), len(new))
        assert np.abs(np.pad(old, (0, upto - len(old))) - np.pad(new, (0, upto - len(new)))).max() < 1e-13
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1 << 22, 1000])
def test_permuted_maxima_from_points(spark, monkeypatch, most):
    """before, activations were rows for Python, and points met their groups in a join for each use."""
    from quillmap.operators import pairwise

    monkeypatch.setattr(kernels, "STAMPS", most)
    p = points(spark)
    one, two = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([*range(0, 70, 3), 3], range(1, 70, 3)))
    own = [g.join(p, "id", "left_semi") for g in (one, two)]
    want = cbma.chi2_maxima(kernels.mkda(pairwise.grouped(p, *own), GRID, 4.0, keep=["g"]), *own, 12, 5)
    out = cbma.chi2_maxima_points(p, one, two, GRID, 4.0, 12, 5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 12
    monkeypatch.setattr(pairwise, "TASK_BYTES", 100)  # volumes that do not fit a task
    found = sorted(map(tuple, cbma.chi2_maxima_points(p, one, two, GRID, 4.0, 12, 5).collect()))
    assert all(a == b and abs(x - y) < 1e-9 for (a, x), (b, y) in zip(found, sorted(map(tuple, want.collect())), strict=True))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="share"):
        cbma.chi2_maxima_points(p, one, two.unionByName(one.limit(1)), GRID, 4.0, 2)
    stamps = kernels.Stamps(GRID, kernels.sphere(4.0, 2.0))
    rows, _ = pairwise.group_ids(p, one, two, GRID, stamps)
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("first", [1, 2, 16])
def test_random_foci_end_where_no_draw_matters(spark, monkeypatch, first):
    """F8: before, all analyses were drawn although the union was 1.0 at all voxels after some of them."""
    monkeypatch.setattr(cbma, "DRAW_FOCI", 300)
    monkeypatch.setattr(cbma, "FIRST_BLOCKS", first)
    foci = spark.createDataFrame([(i, 1 + i % 4, 10.0 + i % 3) for i in range(1200)], "id long, n long, sample_size double")
    pool = np.argwhere(GRID.mask_array())[::5]
    for least in (-1.0, -3.0, cbma.NONE_LEFT):  # passed early, by some iterations or later, and never
        whole, ended = ({r["iteration"]: np.frombuffer(bytes(r["part"])) for r in cbma.simulated(spark, foci, pool, GRID, 5, "ale", least=x).collect()} for x in (None, least))
        inside = GRID.mask_array().ravel()
        assert whole.keys() == ended.keys()
        for it, x in whole.items():
            y = ended[it]
            assert np.allclose(x, y, atol=1e-9) or (x[inside] <= y[inside] + 1e-12).all() and (y[inside] < least).all()
            assert np.array_equal(np.maximum(np.round(x, 9), least), np.maximum(np.round(y, 9), least))


def test_unions_of_many_analyses_at_once(spark, monkeypatch):
    """F8: before, each analysis was stamped into a volume of its own; F9: ale_scale drew 5 times, and draws as often as its estimator does by default."""
    import inspect

    from quillmap.plans import registry

    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(int(a), *map(int, rng.integers(-3, 10, 3)), 10.0 + int(a) % 3) for a in rng.integers(0, 40, 150)], "id long, i long, j long, k long, sample_size double")
    for fwhm in (None, 6.0):
        monkeypatch.setattr(kernels, "TABLE_BYTES", 0)
        stamped = {r["voxel"]: r["log_none"] for r in kernels.ale_log_sums(p, GRID, fwhm).collect()}
        for size, held in ((128 << 20, 400_000), (3_000_000, 7)):
            monkeypatch.setattr(kernels, "TABLE_BYTES", size)
            monkeypatch.setattr(kernels, "HELD_ROWS", held)
            assert {r["voxel"]: r["log_none"] for r in kernels.ale_log_sums(p, GRID, fwhm).collect()} == pytest.approx(stamped, rel=1e-12)
    assert "5000)" in inspect.getsource(registry.ale_scale)
