"""Diagnostics: contributions of analyses to clusters, stability, conjunctions, summaries."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators import cbma
from quillmap.plans.studyset import Grid


def jackknife(ma: DataFrame, clusters: DataFrame, kind: str = "ale") -> DataFrame:
    """(id, cluster, contribution): mean over a cluster of 1 - statistic without the analysis / statistic.

    The statistic is additive (for ALE in ln(1 - v)), so leaving one out is a
    subtraction and nothing is fitted again.
    """
    own = ma.join(F.broadcast(clusters), "voxel")
    term = F.log1p(-F.least("value", F.lit(1 - 1e-12))) if kind == "ale" else F.col("value")
    total = own.withColumn("term", term).groupBy("voxel").agg(F.sum("term").alias("total"))
    rows = own.withColumn("term", term).join(F.broadcast(total), "voxel")
    stat = (lambda c: 1 - F.exp(c)) if kind == "ale" else (lambda c: c)
    left_out = 1 - F.coalesce(F.try_divide(stat(F.col("total") - F.col("term")), stat(F.col("total"))), F.lit(1.0))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return rows.withColumn("c", left_out).groupBy("id", "cluster").agg(F.sum("c").alias("c")).join(size, "cluster").select("id", "cluster", (F.col("c") / F.col("size")).alias("contribution"))


def focus_counter(point: DataFrame, clusters: DataFrame, grid: Grid) -> DataFrame:
    """(id, cluster, n): points less than one voxel from a voxel of a cluster, each once for each cluster.

    Such a voxel is in the 27 cells around the point, so the join is on the cell.
    """
    near = point.withColumn("pid", F.monotonically_increasing_id()).select("id", "pid", "x", "y", "z", *[v.alias(c) for v, c in zip(grid.voxels(*map(F.col, "xyz")), "ijk", strict=True)])
    for c in "ijk":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    near = near.where(grid.inside(F.col("ci"), F.col("cj"), F.col("ck"))).withColumn("voxel", grid.flat(F.col("ci"), F.col("cj"), F.col("ck")))
    off = [F.col(a) - p for a, p in zip("xyz", grid.places(*(F.col(f"c{c}") for c in "ijk")), strict=True)]
    if grid.affine is None:
        steps = [o / abs(size) for o, size in zip(off, grid.sizes, strict=True)]
    else:
        steps = [sum(float(w) * o for w, o in zip(row, off, strict=True)) for row in np.linalg.inv(grid.matrix[:, :3])]
    d2 = sum(s**2 for s in steps)
    # on a rotated grid, a distance of one voxel is known to 1e-9
    hit = near.where(d2 < (1.0 if grid.affine is None else 1 - 1e-9)).join(clusters, "voxel").select("id", "pid", "cluster").distinct()
    return hit.groupBy("id", "cluster").agg(F.count("*").alias("n"))


def subsets(n: int, size: int, most: int = 1000, seed: int = 0) -> list[tuple[int, ...]]:
    """All subsets if at most ``most``, else that many different ones at random, in order."""
    if math.comb(n, size) <= most:
        return list(itertools.combinations(range(n), size))
    rng, out = random.Random(seed), set()
    while len(out) < most:
        out.add(tuple(sorted(rng.sample(range(n), size))))
    return sorted(out)


def stability(ma: DataFrame, schedule: DataFrame, threshold: float, mask: DataFrame) -> DataFrame:
    """(voxel, support): share of replicates, given as (replicate, id), whose ALE statistic passes the threshold."""
    logs = ma.select("id", "voxel", F.log1p(-F.least("value", F.lit(1 - 1e-12))).alias("lv"))
    n = schedule.agg(F.countDistinct("replicate").cast("double").alias("n"))
    stat = logs.join(schedule, "id").groupBy("replicate", "voxel").agg((1 - F.exp(F.sum("lv"))).alias("stat"))
    hits = stat.where(F.col("stat") > threshold).groupBy("voxel").agg(F.count("*").alias("hits"))
    return mask.select("voxel").join(hits, "voxel", "left").crossJoin(F.broadcast(n)).select("voxel", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("support"))


def leave_one_out(ids: DataFrame) -> DataFrame:
    """(replicate, id): every analysis but the one the replicate is named for, as a schedule; ``leave_one_out_support`` needs none."""
    return ids.select(F.col("id").alias("replicate")).crossJoin(ids.select("id")).where("replicate <> id")


def leave_one_out_support(ma: DataFrame, ids: DataFrame, threshold: float, mask: DataFrame) -> DataFrame:
    """(voxel, support): share of analyses without which the ALE statistic still passes the threshold.

    Leaving one out is a subtraction of its logarithm, and changes only voxels where it is active.
    """
    n = ids.select("id").distinct().agg(F.count("*").cast("double").alias("n"))
    own = cbma.with_ids(ma, ids.select("id").distinct(), "left_semi")
    return leave_one_out_of_counts(own.groupBy("voxel", "value").agg(F.count("*").alias("n")), n, threshold, mask)


def leave_one_out_of_counts(counts: DataFrame, n: DataFrame, threshold: float, mask: DataFrame) -> DataFrame:
    """``leave_one_out_support`` from (voxel, value, n), how many analyses have each value at a voxel, and one row (n) of all analyses there are."""
    logs = counts.select("voxel", F.log1p(-F.least("value", F.lit(1 - 1e-12))).alias("lv"), F.col("n").alias("times"))
    total = logs.groupBy("voxel").agg(F.sum(F.col("lv") * F.col("times")).alias("total"), F.sum("times").alias("active"))
    passes = lambda t: (1 - F.exp(t) > threshold).cast("long")
    # the sums are of the mask's size
    without = logs.join(F.broadcast(total), "voxel").groupBy("voxel").agg(F.sum(F.col("times") * passes(F.col("total") - F.col("lv"))).alias("still"), F.first("total").alias("total"), F.first("active").alias("active"))
    rows = mask.select("voxel").join(without, "voxel", "left").fillna(0, ["still", "active"]).fillna(0.0, ["total"]).crossJoin(F.broadcast(n))
    return rows.select("voxel", ((F.col("still") + (F.col("n") - F.col("active")) * passes(F.col("total"))) / F.col("n")).alias("support"))


def conjunction(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller value where both have the same sign, else 0."""
    j = a.withColumnRenamed("value", "p").join(b.withColumnRenamed("value", "q"), "voxel")
    return j.select("voxel", F.when(F.col("p") * F.col("q") > 0, F.least("p", "q")).otherwise(0.0).alias("value"))


def summary(analysis: DataFrame, point: DataFrame, grid: Grid) -> DataFrame:
    """Studies, analyses, points, and points in and out of the mask."""
    i, j, k = grid.voxels(*map(F.col, "xyz"))
    inside = (grid.inside(i, j, k) & grid.in_mask(i, j, k)).cast("int")
    p = point.agg(F.count("*").alias("n_points"), F.sum(inside).alias("n_inside"), F.sum(1 - inside).alias("n_outside"), F.countDistinct("id").alias("n_with_points"))
    a = analysis.agg(F.countDistinct("study_id").alias("n_studies"), F.count("*").alias("n_analyses"))
    return a.crossJoin(p)


def image_summary(image: DataFrame) -> DataFrame:
    """Statistics of each image over its finite, non-zero voxels."""
    v = F.col("value")
    rows = image.where(v.isNotNull() & ~F.isnan(v) & (v != 0))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.percentile(v, 0.5).alias("median"), F.mode(v, True).alias("mode"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr"))


def coverage(image: DataFrame) -> DataFrame:
    """(voxel, share of images valid there)."""
    n = image.select(F.countDistinct("id").cast("double").alias("n"))
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0)
    return image.groupBy("voxel").agg(F.sum(ok.cast("int")).alias("have")).crossJoin(F.broadcast(n)).select("voxel", (F.col("have") / F.col("n")).alias("share"))


def derive_images(wide: DataFrame) -> DataFrame:
    """Missing maps of (z, t, p, beta, varcope, se, sd, sample_size) from those there are, and d, g and g_var; the first route that applies wins."""
    from quillmap.functions import native, special

    n = F.col("sample_size").cast("double")
    rows = wide.withColumn("varcope", F.coalesce("varcope", native.se_to_varcope(F.col("se")), native.sd_to_varcope(F.col("sd"), n)))
    rows = rows.withColumn("t", F.coalesce("t", F.try_divide(F.col("beta"), F.sqrt("varcope"))))
    rows = rows.withColumn("varcope", F.coalesce("varcope", native.t_and_beta_to_varcope(F.col("t"), F.col("beta"))))
    rows = rows.withColumn("beta", F.coalesce("beta", native.t_and_varcope_to_beta(F.col("t"), F.col("varcope"))))
    rows = rows.withColumn("z", F.coalesce("z", special.t_to_z_udf(F.col("t"), n - 1), special.p_to_z_udf("p")))
    rows = rows.withColumn("t", F.coalesce("t", F.when(F.col("z").isNotNull() & (n > 1), special.z_to_t_udf(F.col("z"), n - 1))))
    rows = rows.withColumn("p", F.coalesce("p", F.exp(special.z_to_nlogp_udf("z"))))
    d = native.t_to_d(F.col("t"), n)
    g, g_var = native.d_to_g(d, n)
    return rows.withColumns({"d": d, "g": g, "g_var": g_var})


def peaks(stat: DataFrame, grid: Grid, threshold: float = 3.1, distance: float = 8.0, most: int = 1) -> DataFrame:
    """(cluster, rank, voxel, value): up to ``most`` peaks of each cluster above the threshold, at least ``distance`` mm apart.

    The first is the largest value of the cluster (ties to the least voxel); others are voxels
    that no face, edge or corner neighbour exceeds, by falling value. A volume is one group.
    """
    from quillmap.operators.clusters import label

    shape, sizes = grid.shape, grid.matrix[:, :3]

    def run(pdf):
        import pandas as pd

        value = np.full(shape, -np.inf)
        value.ravel()[pdf["voxel"].to_numpy()] = pdf["value"].to_numpy()
        marks = label(np.isfinite(value))
        wide = np.pad(value, 1, constant_values=-np.inf)
        top = np.ones(shape, bool)
        for a in range(3):
            for b in range(3):
                for c in range(3):
                    top &= value >= wide[a : a + shape[0], b : b + shape[1], c : c + shape[2]]
        out = []
        for cluster in range(1, marks.max() + 1):
            own = np.flatnonzero((marks == cluster).ravel())
            name = int(own.min())
            own = own[np.lexsort((own, -value.ravel()[own]))]
            own = np.concatenate([own[:1], own[1:][top.ravel()[own[1:]]]])
            chosen = []
            for v in own:
                at = sizes @ np.array(np.unravel_index(v, shape))
                if all(np.linalg.norm(at - other) >= distance for other in chosen):
                    chosen.append(at)
                    out.append((name, len(chosen), int(v), float(value.ravel()[v])))
                if len(chosen) == most:
                    break
        return pd.DataFrame(out, columns=["cluster", "rank", "voxel", "value"])

    own = stat.where(F.col("value") > threshold).select(F.col("voxel").cast("long").alias("voxel"), F.col("value").cast("double").alias("value"), F.lit(0).alias("volume"))
    return own.groupBy("volume").applyInPandas(run, "cluster long, rank int, voxel long, value double")
