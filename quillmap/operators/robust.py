"""Inference that is robust to dependent images: one estimate for each voxel, with clusters of images from the same participants.

Weights are those of the correlated-effects model (``rescale``: an image's weight is
divided by its cluster's number of images), of each image alone (``individual``), or of
clusters' means (``collapse``). The variance between clusters comes from a moment estimator, in
which images of one cluster correlate by rho. Standard errors are a sandwich over
clusters, each residual adjusted for its leverage so that the variance is unbiased under the working
model (CR2), with Satterthwaite's degrees of freedom.

For one mean all of this has closed forms in a cluster's sums. With W_j the sum of weights of cluster j, W that of
all, q_j = W_j / W and r_j the cluster's weighted sum of residuals, the variance is sum(r_j**2 / (1 - q_j)) / W**2, and
the degrees of freedom are 1 / (sum(q**2) + sum(q**2 / (1 - q))**2 - sum(q**4 / (1 - q)**2)). So images are
summed by (voxel, cluster) once, and totals of a voxel come by windows over those sums:
no image is gathered, and no sum is joined.

The adjustment is the one whose square root is taken in the scale of the working covariance; where the
images of a cluster have equal weights (``rescale``, ``collapse``) it is the same as the symmetric one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.operators import ibma

SCHEMES = ("rescale", "individual", "collapse")
RHO = 0.8


def sums_of(weight: Column, value: Column) -> list[Column]:
    return [F.sum(weight).alias("w"), F.sum(weight * value).alias("wy")]


def clusters_of(image: DataFrame, group: str) -> DataFrame:
    """(voxel, g, n, v, y, yy, ss): a cluster's images, mean variance, sums of values and squares, and sum of standard deviations."""
    return image.groupBy("voxel", F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg("varcope").alias("v"), F.sum("value").alias("y"), F.sum(F.col("value") * F.col("value")).alias("yy"), F.sum(F.sqrt("varcope")).alias("ss"))


def cluster_weights(image: DataFrame, tau2: float | str = "dl", scheme: str = "rescale", rho: float = RHO, group: str = "study_id") -> DataFrame:
    """(voxel, g, n, tau2, w, wy): for each cluster the sums of its images' weights and weighted values."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme: {scheme}")
    if not 0 <= rho <= 1:
        raise ValueError(f"rho must lie in [0, 1]: {rho}")
    if isinstance(tau2, str) and tau2 != "dl":
        raise ValueError(f"unknown estimator of tau2: {tau2}")
    every = Window.partitionBy("voxel")
    total = lambda c: F.sum(c).over(every)
    positive = lambda top, bottom: F.greatest(F.lit(0.0), F.coalesce(F.try_divide(top, bottom), F.lit(0.0)))
    fixed = None if isinstance(tau2, str) else F.lit(float(tau2))
    if scheme == "individual":
        rows = image
        if fixed is None:
            u, y = 1 / F.col("varcope"), F.col("value")
            rows = rows.withColumns({"_w_": total(u), "_ww_": total(u * u), "_wy_": total(u * y), "_wyy_": total(u * y * y), "_k_": F.count("*").over(every)})
            q = F.col("_wyy_") - F.col("_wy_") * F.col("_wy_") / F.col("_w_")
            rows = rows.withColumn("tau2", positive(q - (F.col("_k_") - 1), F.col("_w_") - F.col("_ww_") / F.col("_w_")))
        else:
            rows = rows.withColumn("tau2", fixed)
        # dealt by voxel already, so this needs no exchange
        return rows.groupBy("voxel", F.col(group).alias("g")).agg(F.count("*").alias("n"), F.first("tau2").alias("tau2"), *sums_of(1 / (F.col("varcope") + F.col("tau2")), F.col("value")))
    own = clusters_of(image, group)
    if scheme == "collapse":
        # the mean of correlated images, and its variance
        own = own.withColumn("v", ((1 - rho) * F.col("v") * F.col("n") + rho * F.col("ss") * F.col("ss")) / (F.col("n") * F.col("n"))).withColumns({"y": F.col("y") / F.col("n")})
        own = own.withColumns({"yy": F.col("y") * F.col("y"), "k": F.lit(1.0)})
    else:
        own = own.withColumn("k", F.col("n").cast("double"))
    u = 1 / (F.col("k") * F.col("v"))  # the weight of an image without a variance between clusters
    if fixed is None:
        own = own.withColumns({"_s_": total(F.col("k") * u), "_u_": total(u), "_q_": total(u * F.col("yy")), "_t_": total(u * F.col("y")), "_kk_": total(F.col("k") * F.col("k") * u * u), "_m_": F.count("*").over(every)})
        q = F.col("_q_") - F.col("_t_") * F.col("_t_") / F.col("_s_")
        shared = ((1 - rho) * F.col("_u_") + rho * F.col("_s_")) / F.col("_s_")
        own = own.withColumn("tau2", positive(q - F.col("_m_") + shared, F.col("_s_") - F.col("_kk_") / F.col("_s_")))
    else:
        own = own.withColumn("tau2", fixed)
    w = 1 / (F.col("v") + F.col("tau2"))
    return own.select("voxel", "g", "n", "tau2", w.alias("w"), (w * F.col("y") / F.col("k")).alias("wy"))


def sandwich(weights: DataFrame) -> DataFrame:
    """(voxel, est, se, dof, tau2, k, m) from (voxel, g, n, tau2, w, wy); se and dof are null with fewer than two clusters."""
    every = Window.partitionBy("voxel")
    rows = weights.withColumns({"total": F.sum("w").over(every), "est": F.sum("wy").over(every) / F.sum("w").over(every)})
    rows = rows.withColumns({"q": F.col("w") / F.col("total"), "r": F.col("wy") - F.col("est") * F.col("w")})
    rest = 1 - F.col("q")
    out = rows.groupBy("voxel").agg(
        F.first("est").alias("est"), F.first("total").alias("total"), F.first("tau2").alias("tau2"), F.sum("n").alias("k"), F.count("*").alias("m"),
        F.sum(F.try_divide(F.col("r") * F.col("r"), rest)).alias("s"),
        F.sum(F.col("q") * F.col("q")).alias("a"), F.sum(F.try_divide(F.col("q") * F.col("q"), rest)).alias("b"), F.sum(F.try_divide(F.pow("q", F.lit(4.0)), rest * rest)).alias("c"),
    )
    some = F.col("m") > 1
    return out.select("voxel", "est", F.when(some, F.sqrt(F.greatest("s", F.lit(0.0))) / F.col("total")).alias("se"), F.when(some, 1 / (F.col("a") + F.col("b") * F.col("b") - F.col("c"))).alias("dof"), "tau2", "k", "m")


def estimate(image: DataFrame, tau2: float | str = "dl", scheme: str = "rescale", rho: float = RHO, group: str = "study_id") -> DataFrame:
    """est, se, dof, tau2, z, p and logp of each voxel; a voxel with one cluster has no inference.

    ``tau2`` is a number (weighted least squares) or ``dl``. Images are rows (voxel, value, varcope) with a column
    that names their cluster; a null one is a cluster of its own.
    """
    out = sandwich(cluster_weights(image, tau2, scheme, rho, group)).withColumn("z", F.try_divide(F.col("est"), F.col("se")))
    return ibma.finish(out, F.col("dof"))


def stouffers(image: DataFrame, correlation: float, weight: Column | None = None) -> DataFrame:
    """Stouffer's z for clusters of correlated images, referred to a t with as many degrees of freedom as there are clusters but one."""
    rows = ibma.stouffers(image, weight, correlation)
    m = image.groupBy("voxel").agg(F.countDistinct("study_id").alias("m"))
    out = rows.join(m, "voxel")
    return ibma.finish(out, F.when(F.col("m") > 1, F.col("m") - 1))
