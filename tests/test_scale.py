"""Steps that must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import kernels
from quillmap.plans.studyset import Grid

GRID = Grid(6, 7, 8, 2.0, 0.0, (1, 6))


def points(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(a), *map(int, rng.integers(-2, 10, 3))) for a in rng.integers(0, n, 4 * n)]
    return spark.createDataFrame(rows, "id long, i long, j long, k long"), rows


def brute(rows, steps):
    out = {}
    for a, i, j, k in rows:
        for x, y, z in steps:
            x, y, z = i + x, j + y, k + z
            if 0 <= x < 6 and 0 <= y < 7 and 1 <= z < 7:
                key = (a, x * 56 + y * 8 + z)
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("stamps", [1 << 22, 300])
def test_only_cells_are_shuffled_and_spheres_agree(spark, monkeypatch, stamps):
    monkeypatch.setattr(kernels, "STAMPS", stamps)
    p, rows = points(spark)
    want = brute(rows, kernels.sphere(4.0, 2.0))
    kda = kernels.kda(p, GRID, 4.0)
    plan = kda._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    assert {(r["id"], r["voxel"]): r["value"] for r in kda.collect()} == want
    assert sorted((r["id"], r["voxel"]) for r in kernels.mkda(p, GRID, 4.0).collect()) == sorted(want)
    n = {r["voxel"]: r["n"] for r in kernels.mkda_summary(p, GRID, 4.0).collect()}
    assert n == {v: sum(key[1] == v for key in want) for v in {key[1] for key in want}}
    named = kernels.mkda(p.withColumn("g", F.col("id") % 3), GRID, 4.0, keep=["g"])
    assert named.where("g <> id % 3").isEmpty() and named.count() == len(want)


def test_largest_kernel_value_and_names_of_text(spark):
    p, rows = points(spark, seed=1)
    kernel = [(0, 0, 0, 0.25), (1, 0, 0, 0.125), (0, -1, 0, 0.5)]
    out = {}
    for a, i, j, k in rows:
        for x, y, z, v in kernel:
            if 0 <= i + x < 6 and 0 <= j + y < 7 and 1 <= k + z < 7:
                key = (f"a{a}", (i + x) * 56 + (j + y) * 8 + k + z)
                out[key] = max(out.get(key, 0), v)
    found = kernels.ale(p.withColumn("id", F.concat(F.lit("a"), "id")), spark.createDataFrame(kernel, "di int, dj int, dk int, v double"), GRID)
    assert {(r["id"], r["voxel"]): r["value"] for r in found.collect()} == out


def test_permuted_volumes_are_summed_where_the_terms_are(spark):
    from quillmap.operators import cbma, pairwise

    rng = np.random.default_rng(2)
    rows = sorted({(int(i), int(v)) for i, v in zip(rng.integers(0, 40, 900), rng.integers(0, 336, 900))})
    terms = spark.createDataFrame([(i, v, float(v % 5) / 8) for i, v in rows], "id long, voxel long, term double")
    ids = spark.range(40).select("id")
    one, two = ids.where("id < 15"), ids.where("id >= 15")
    cuts = cbma.label_cuts(ids, 15, 6, 0)
    found = {r["iteration"]: np.frombuffer(bytes(r["part"])) for r in pairwise.permuted_volumes(terms, one, two, GRID, 6).collect()}
    hashed = {r["id"]: r["h"] for r in ids.select("id", F.xxhash64("id").alias("h")).collect()}
    draws = cbma._draws(np.array([hashed[i] for i in range(40)]), np.arange(6), 0).astype(np.int64)
    for it in range(6):
        want = np.zeros(336)
        for i, v in rows:
            want[v] += v % 5 / 8 * (draws[i, it] <= cuts[it])
        assert (draws[:, it] <= cuts[it]).sum() == 15 and np.array_equal(found[it], want)
    plan = pairwise.permuted_volumes(terms.withColumn("g", F.lit(1)), one, two, GRID, 6)._jdf.queryExecution().executedPlan().toString()
    assert "voxel" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_sums_of_many_analyses_by_kinds(spark, monkeypatch):
    from quillmap.operators import cbma

    hist = spark.createDataFrame([(i, b, s) for i in range(90) for b, s in (((0, 0.7), (1, 0.3)) if i % 3 else ((0, 0.5), (1, 0.25), (4, 0.25)))], "id long, bin long, share double")
    want = cbma.fold_histograms(hist, 1.0, additive=True, most=30)
    monkeypatch.setattr(cbma, "FOLD_EXACT", 10)
    monkeypatch.setattr(cbma, "convolve", None)  # nothing is folded one by one
    got = cbma.fold_histograms(hist, 1.0, additive=True, most=30)
    assert len(got) == len(want) == 32 and np.allclose(got, want, atol=1e-14)


def test_pairs_within_a_radius_are_not_shuffled(spark):
    from quillmap.operators import selection

    rng = np.random.default_rng(3)
    p = [(int(i), *map(float, rng.integers(-4, 5, 3))) for i in rng.integers(0, 30, 120)]
    q = [(None if n % 17 == 0 else int(n % 40), *map(float, rng.integers(-4, 5, 3))) for n in range(60)]
    point, query = spark.createDataFrame(p, "id long, x double, y double, z double"), spark.createDataFrame(q, "query_id long, x double, y double, z double")
    want = {(i, n) for i, *a in p for n, *b in q if sum((s - t) ** 2 for s, t in zip(a, b)) <= 4}
    rows = [tuple(r) for r in selection.range_join(point, query, 2.0).select("id", "query_id").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_unions_of_cells_by_table(spark):
    from quillmap.operators import cbma

    rng = np.random.default_rng(4)
    rows = rng.integers(0, 1 << 63, (137, 3)).astype(np.uint64)
    assert np.array_equal(cbma.bit_sums(rows), np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0))
    foci = spark.createDataFrame([(i, 1 + i % 4, 10.0 + i % 3) for i in range(30)], "id long, n long, sample_size double")
    pool = np.argwhere(GRID.mask_array())[::3]
    for kind in ("mkda", "ale"):
        volumes = []
        for bytes_ in (256 << 20, 0):
            before, cbma.TABLE_BYTES = cbma.TABLE_BYTES, bytes_
            volumes.append({r["iteration"]: np.frombuffer(bytes(r["part"])) for r in cbma.simulated(spark, foci, pool, GRID, 3, kind, 4.0).collect()})
            cbma.TABLE_BYTES = before
        assert all(np.allclose(volumes[0][i], volumes[1][i], rtol=1e-12) for i in range(3))


def test_brainmap_keeps_the_sign_where_p_is_one(spark):
    from quillmap.operators import decode

    # both labels are on far fewer selected analyses than their foci would give by chance
    point = spark.range(4000).select("id").unionByName(spark.range(1_000_000).select((F.col("id") % 2000 + 2000).alias("id")))
    annotation = spark.range(1800, 4000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("label"), F.lit(1.0).alias("value"))
    out = decode.decode_brainmap(point, annotation, spark.range(2000).select("id"))
    rows = {r["label"]: r for r in out.collect()}
    assert all(r["p_forward"] == 1 and r["z_forward"] == 0 for r in rows.values())
    assert (rows["a"]["sign_forward"], rows["b"]["sign_forward"]) == (-1, 1)


def test_perplexity_counts_all_trusted_texts(spark, monkeypatch, tmp_path):
    from quillmap.llm import kneser_ney

    class Seen(Exception):
        pass

    def train(trusted):
        raise Seen(trusted.count())

    monkeypatch.setattr(kneser_ney, "train", train)
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    with pytest.raises(Seen) as found:
        kneser_ney.classify(docs, labels)
    assert found.value.args[0] == labels.where(kneser_ney.fold(0)).count() > 4500


def test_a_task_has_pairs_of_few_images(spark, monkeypatch):
    from quillmap.operators import ibma

    assert ibma.BLOCK_IMAGES <= 1000
    monkeypatch.setattr(ibma, "BLOCK_IMAGES", 8)
    rng = np.random.default_rng(5)
    values = rng.normal(size=(40, 6))
    image = spark.createDataFrame([(i, v, float(values[i, v])) for i in range(40) for v in range(6)], "id long, voxel long, value double")
    rows = {(r["a"], r["b"]): r["r"] for r in ibma.image_correlations(image).collect()}
    want = np.corrcoef(values)
    assert len(rows) == 780 and all(abs(r - want[a, b]) < 1e-12 for (a, b), r in rows.items())
