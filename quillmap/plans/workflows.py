"""Workflows: an estimator by name, then a correction, then clusters and diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions import special
from quillmap.operators import cbma, clusters, correction, diagnostics, ibma, kernels, pairwise, selection, structure, text
from quillmap.plans.studyset import Studyset


@dataclass
class Result:
    """Named maps (voxel, ...) and tables; how an estimator is drawn at random, its largest statistics under permutation, or family-wise p of voxels and clusters."""

    maps: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    random: dict | None = None
    maxima: Callable[[int, int], DataFrame] | None = None
    observed: Column | None = None
    families: Callable[[int, int], DataFrame] | None = None


def _counted(ss: Studyset) -> DataFrame:
    """(id, n, sample_size) of analyses with points, to draw random foci for."""
    n = ss.point.groupBy("id").agg(F.count("*").alias("n"))
    return structure.with_sample_size(n, ss.analysis) if "sample_size" in ss.analysis.columns else n


def _mkda(ss: Studyset, r: float = 10.0, **_) -> Result:
    ma, mask = kernels.mkda(ss.point, ss.grid, r), ss.grid.mask(ss.point.sparkSession)
    stat = cbma.mkda_density(ma, cbma.mkda_weights(ss.analysis, ss.point), mask)
    null = cbma.null_table(ma.sparkSession, cbma.mkda_null(ma, mask.count()))
    return Result({"stat": cbma.with_z(cbma.stat_to_p(stat, null, 1.0)), "ma": ma}, random={"kind": "mkda", "r": r})


def _kda(ss: Studyset, r: float = 10.0, **_) -> Result:
    ma, mask = kernels.kda(ss.point, ss.grid, r), ss.grid.mask(ss.point.sparkSession)
    null = cbma.null_table(ma.sparkSession, cbma.kda_null(ma, mask.count()))
    return Result({"stat": cbma.with_z(cbma.stat_to_p(cbma.kda_stat(ma, mask), null, 1.0)), "ma": ma}, random={"kind": "kda", "r": r})


def _activation(ss: Studyset, fwhm: float | None) -> tuple[DataFrame, float | None]:
    """ALE's modeled activation, by sample sizes if the analyses have them and no width is given, else by a width (10 mm)."""
    if fwhm is None and "sample_size" in ss.analysis.columns:
        return kernels.ale_gaussian(structure.with_sample_size(ss.point, ss.analysis), ss.grid), None
    return kernels.ale_gaussian(ss.point, ss.grid, fwhm or 10.0), fwhm or 10.0


def _ale(ss: Studyset, step: float = 1e-5, fwhm: float | None = None, **_) -> Result:
    spark = ss.point.sparkSession
    ma, width = _activation(ss, fwhm)
    mask = ss.grid.mask(spark)
    dist = cbma.fold_histograms(cbma.ale_histograms(ma, mask.count(), step), step)
    stat = cbma.stat_to_p(cbma.ale_stat(ma, mask), cbma.null_table(spark, dist), step)
    return Result({"stat": cbma.with_z(stat), "ma": ma}, random={"kind": "ale", "fwhm": width, "r": 0.0})


def _difference(ss: Studyset, group1: DataFrame, group2: DataFrame | None = None, fwhm: float | None = None, n_iters: int = 1000, seed: int = 0, within: DataFrame | None = None, **_) -> Result:
    ma, _width = _activation(ss, fwhm)
    group2 = ss.analysis.join(group1, "id", "left_anti").select("id") if group2 is None else group2
    stat = cbma.ale_difference(ma, group1, group2, ss.grid.mask(ma.sparkSession), n_iters, seed, within)
    return Result({"stat": stat, "ma": ma}, maxima=lambda n, s: cbma.difference_maxima(ma, group1, group2, n, s), families=lambda n, s: pairwise.subtraction_fwe(ma, group1, group2, ss.grid, n, seed=s))


def _scale(ss: Studyset, pool: DataFrame, fwhm: float | None = None, n_iters: int = 1000, seed: int = 0, **_) -> Result:
    ma, width = _activation(ss, fwhm)
    return Result({"stat": cbma.scale(ma, _counted(ss), pool, ss.grid, ss.grid.mask(ma.sparkSession), n_iters, width, seed), "ma": ma})


def _chi2(ss: Studyset, group1: DataFrame, r: float = 10.0, **_) -> Result:
    """The chi-square maps, with p of the uniformity, association and directed tests, and the uniformity of the second group."""
    ma = kernels.mkda(ss.point, ss.grid, r)
    ids = ss.point.select("id").distinct()
    one, two = ids.join(group1, "id", "left_semi"), ids.join(group1, "id", "left_anti")
    stat = cbma.mkda_chi2(ma, group1, ids, ss.grid.mask(ma.sparkSession))
    second = stat.agg(F.avg("b").alias("mean_b")).crossJoin(two.agg(F.count("*").cast("double").alias("n2")))
    stat = stat.crossJoin(F.broadcast(second)).withColumn("chi2_group2", cbma.one_way(F.col("b"), F.col("n2"), F.col("mean_b")))
    stat = stat.withColumn("z_group2", F.sqrt("chi2_group2") * F.signum(F.col("b") - F.col("mean_b"))).drop("mean_b", "n2")
    stat = stat.withColumns({f"p_{n}": F.exp(special.chi2_to_nlogp_udf(f"chi2_{n}")) for n in ("uniformity", "association", "group2")})
    observed = F.sqrt("chi2_association")
    return Result(
        {"stat": stat, "ma": ma},
        maxima=lambda n, s: cbma.chi2_maxima(ma, one, two, n, s).withColumn("max_stat", F.sqrt("max_stat")),
        observed=observed,
        families=lambda n, s: pairwise.chi2_fwe(ma, one, two, ss.grid, n, seed=s),
    )


def _permuted(ss: Studyset, **_) -> Result:
    image = ibma.valid(ss.image)
    t = ibma.one_sample_t(image)
    stat = ibma.finish(t.withColumnRenamed("dof", "_dof_").withColumn("z", F.col("t")), F.col("_dof_")).drop("_dof_")
    return Result({"stat": stat}, maxima=lambda n, s: ibma.sign_flips(image, n), observed=F.abs("t"))


def _z(f):
    """An estimator of a z map with its p and logp."""
    return lambda ss, **options: Result({"stat": ibma.finish(f(ss, **options))})


ESTIMATORS = {
    "ale": _ale,
    "alesubtraction": _difference,
    "scale": _scale,
    "mkdadensity": _mkda,
    "kda": _kda,
    "mkdachi2": _chi2,
    "stouffers": _z(lambda ss, correlation=None, **_: ibma.stouffers(ibma.valid(ss.image), correlation=correlation)),
    "fishers": lambda ss, **_: Result({"stat": ibma.fishers(ibma.valid(ss.image))}),
    "wleastsquares": _z(lambda ss, tau2=0.0, **_: ibma.weighted_least_squares(ibma.valid(ss.image), tau2)),
    "dersimonianlaird": lambda ss, **_: Result({"stat": ibma.random_effects(ibma.valid(ss.image))}),
    "hedges": lambda ss, **_: Result({"stat": ibma.random_effects(ibma.valid(ss.image), "hedges")}),
    "permutedols": _permuted,
    "variancebl": _z(lambda ss, **_: ibma.likelihood(ibma.valid(ss.image))),
    "samplesizebl": _z(lambda ss, **_: ibma.likelihood(ibma.valid(ss.image), by_size=True)),
}
#: Diagnostics by name.
DIAGNOSTICS = ("jackknife", "focuscounter")


def family_wise(ss: Studyset, result: Result, n_iters: int, threshold: float, seed: int) -> None:
    """Add p of the largest statistic of each iteration, and for random foci p of clusters by size and mass, to the result."""
    stat = result.maps["stat"]
    if result.random is not None:
        spark = stat.sparkSession
        at = _critical_statistic(stat, threshold)
        maxima = cbma.monte_carlo(spark, _counted(ss), ss.grid.mask(spark), ss.grid, result.random["r"], n_iters, seed, result.random["kind"], at, result.random.get("fwhm"))
        # drawn once: clusters and voxels are compared with the same iterations
        maxima = spark.createDataFrame(maxima.toPandas())
        table = clusters.cluster_table(stat.select("voxel", "stat"), ss.grid, at).where("tail = 'PositiveTail'")
        for name in ("size", "mass"):
            p = cbma.null_to_p(table.select(F.col("cluster").alias("key"), F.col(name).cast("double").alias("value")), maxima.select(F.col(f"max_{name}").cast("double").alias("value")))
            table = table.join(p.select(F.col("key").alias("cluster"), F.col("p").alias(f"p_{name}")), "cluster")
        result.tables["clusters_corr-FWE_method-montecarlo"] = table
        observed = F.col("stat")
    elif result.maxima is not None:
        if result.families is not None:
            by_family(result, n_iters, seed)
        maxima, observed = result.maxima(n_iters, seed), result.observed if result.observed is not None else F.abs("stat")
    else:
        raise ValueError("this estimator has no permutations for a family-wise correction")
    rows = stat.where(observed.isNotNull()).select("voxel", observed.cast("double").alias("stat"))
    fixed = correction.max_stat_p(rows, maxima)
    z = next(c for c in ("z", "z_association") if c in stat.columns)
    result.maps["p_level-voxel_corr-FWE_method-montecarlo"] = fixed.select("voxel", F.col("p").alias("value"))
    result.maps["z_level-voxel_corr-FWE_method-montecarlo"] = fixed.join(stat.select("voxel", F.signum(z).alias("sign")), "voxel").select("voxel", (F.col("sign") * special.p_to_z_udf("p")).alias("value"))


def by_family(result: Result, n_iters: int, seed: int) -> None:
    """Add p, z and logp of voxels and of clusters by size and mass, for each family of a comparison of groups.

    The second group's z and the uniformity's take the sign of their departure from the mean.
    """
    table = text.checkpointed(pairwise.with_z(result.families(n_iters, seed)))
    stat = result.maps["stat"]
    for family in sorted(r[0] for r in table.select("family").distinct().collect()):
        own = table.where(F.col("family") == family)
        if f"z_{family}" in stat.columns:
            sign = stat.select("voxel", F.when(F.col(f"z_{family}") < 0, -1.0).otherwise(1.0).alias("sign"))
            own = own.join(sign, "voxel").withColumns({f"z_{v}": F.col("sign") * F.col(f"z_{v}") for v in ("voxel", "size", "mass")})
        for level, name in (("voxel", "level-voxel"), ("size", "Size_level-cluster"), ("mass", "Mass_level-cluster")):
            for kind in ("p", "z", "logp"):
                key = f"{kind}_desc-{family}{'_' if level == 'voxel' else ''}{name}_corr-FWE_method-montecarlo"
                result.maps[key] = own.select("voxel", F.col(f"{kind}_{level}").alias("value"))


def _critical_statistic(stat: DataFrame, threshold: float) -> float:
    """The least statistic with a z above the threshold, or beyond the largest if there is none."""
    row = stat.agg(F.min(F.when(F.col("z") > threshold, F.col("stat"))).alias("low"), F.max("stat").alias("high")).first()
    return float(row["low"]) * (1 - 1e-12) if row["low"] is not None else float(row["high"])


def run(ss: Studyset, estimator: str, correct: str | None = "bonferroni", threshold: float = 1.96, diagnose: tuple[str, ...] = DIAGNOSTICS, n_iters: int = 1000, seed: int = 0, **options) -> Result:
    """Fit, correct z maps, and for maps of z a table of clusters and, for activation, contributions of analyses.

    ``correct`` is None (nothing is corrected, and no map says so), bonferroni, an FDR method (fdr is indep) or montecarlo; an estimator without z
    cannot be corrected, which is an error.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator: {estimator}")
    if unknown := set(diagnose) - set(DIAGNOSTICS):
        raise ValueError(f"unknown diagnostics: {sorted(unknown)}")
    correct = {"fdr": "indep"}.get(correct, correct)
    if correct not in (None, "montecarlo", *correction.METHODS):
        raise ValueError(f"unknown correction: {correct}")
    if estimator in ("alesubtraction", "scale"):
        options = {"n_iters": n_iters, "seed": seed, **options}
    result = ESTIMATORS[estimator](ss, **options)
    stat = result.maps["stat"]
    names = [c for c in ("z", "z_association", "z_uniformity", "z_group2") if c in stat.columns]
    if not names and correct is not None:
        raise ValueError(f"{estimator} gives no z, so nothing can be corrected")
    if correct == "montecarlo":
        family_wise(ss, result, n_iters, threshold, seed)
    elif names and correct is not None:
        for name in names:
            logs = stat.select("voxel", F.col(name).alias("z"), special.z_to_nlogp_udf(name).alias("nlogp"))
            fixed = correction.correct(logs, correct)
            key = correction.suffix(name if name != names[0] else "z", "FDR" if correct in ("indep", "negcorr", "bh", "by") else "FWE", correct)
            result.maps[key] = fixed.select("voxel", (F.signum("z") * special.nlogp_to_z_udf("corrected")).alias("value"))
    if names and ss.grid is not None and "ma" in result.maps:
        name = names[0]
        result.tables["clusters"] = clusters.cluster_table(stat.select("voxel", F.col(name).alias("stat")), ss.grid, threshold)
        named = clusters.cluster_voxels(stat.where(F.col(name) > threshold).select("voxel"), ss.grid)
        if "focuscounter" in diagnose:
            result.tables["focus_counter"] = diagnostics.focus_counter(ss.point, named, ss.grid)
        if "jackknife" in diagnose:
            result.tables["jackknife"] = diagnostics.jackknife(result.maps["ma"], named, "ale" if estimator in ("ale", "scale", "alesubtraction") else "sum")
    return result


def coactivation(ss: Studyset, roi: DataFrame | tuple[int, int], **options) -> Result:
    """Analyses with a point in a region, voxels or a range of planes k, then ALE and its correction."""
    if isinstance(roi, tuple):
        ids = ss.point.where(F.col("k").between(*roi)).select("id").distinct()
    else:
        at = ss.point.where(ss.grid.inside(F.col("i"), F.col("j"), F.col("k"))).withColumn("voxel", ss.grid.flat(F.col("i"), F.col("j"), F.col("k")).cast("long"))
        ids = at.join(roi.select(F.col("voxel").cast("long").alias("voxel")), "voxel", "left_semi").select("id").distinct()
    return run(ss.select(ids), "ale", **options)


def by_labels(ss: Studyset, labels: list[str], **options) -> Studyset:
    return ss.select(selection.by_labels(ss.analysis, ss.annotation, labels, **options))


def contrast(ss: Studyset, group1: DataFrame, group2: DataFrame, threshold: float = 1.96, **options) -> Result:
    """Main effects of two groups, their conjunction, and each direction of the contrast where that group's own effect passes the threshold."""
    one, two = (run(ss.select(g), "ale", None, threshold, **options) for g in (group1, group2))
    a, b = (r.maps["stat"].select("voxel", F.col("z").alias("value")) for r in (one, two))
    both = run(ss.select(group1.select("id").unionByName(group2.select("id"))), "mkdachi2", None, threshold, group1=group1, r=options.get("r", 10.0))
    z = both.maps["stat"].select("voxel", F.col("z_association").alias("z"))
    gated = z.join(a.withColumnRenamed("value", "a"), "voxel").join(b.withColumnRenamed("value", "b"), "voxel")
    gated = gated.select("voxel", F.when((F.col("z") > 0) & (F.col("a") > threshold), F.col("z")).when((F.col("z") < 0) & (F.col("b") > threshold), F.col("z")).otherwise(0.0).alias("value"))
    return Result({"group1": a, "group2": b, "conjunction": diagnostics.conjunction(a, b), "contrast": gated})
