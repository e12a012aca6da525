"""Clusters of face-connected voxels, in one volume (numpy) or by a distributed join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.plans.studyset import Grid


def label(on: np.ndarray) -> np.ndarray:
    """Cluster numbers of a small boolean volume (0 outside): face neighbours hook to the lesser root, and roots are halved until nothing changes."""
    at = np.arange(on.size).reshape(on.shape)
    pairs = []
    for axis in range(on.ndim):
        a, b = (np.take(at, range(lo, on.shape[axis] - 1 + lo), axis) for lo in (0, 1))
        both = on.ravel()[a] & on.ravel()[b]
        pairs.append(np.stack([a[both], b[both]]))
    u, v = np.concatenate(pairs, 1)
    root = np.arange(on.size)
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not ((up := root[root]) == root).all():
            root = up
    marks = np.zeros(on.size, np.int64)
    marks[on.ravel()] = np.unique(root[on.ravel()], return_inverse=True)[1] + 1
    return marks.reshape(on.shape)


def cluster_voxels(above: DataFrame, grid: Grid) -> DataFrame:
    """(voxel, cluster) of face-connected voxels, the cluster named by its least voxel.

    One volume has a fixed number of voxels, so it is one group; several volumes
    (a column ``volume``) are labelled in parallel.
    """
    shape = (grid.nx, grid.ny, grid.nz)
    group = "volume" if "volume" in above.columns else None
    rows = above if group else above.withColumn("volume", F.lit(0).cast("long"))

    def run(pdf):
        on = np.zeros(shape, bool)
        on.ravel()[pdf["voxel"].to_numpy()] = True
        marks = label(on).ravel()
        own = pdf[["volume", "voxel"]].copy()
        own["cluster"] = marks[own["voxel"].to_numpy()]
        own["cluster"] = own.groupby("cluster")["voxel"].transform("min")
        return own

    out = rows.select(F.col("volume").cast("long").alias("volume"), F.col("voxel").cast("long").alias("voxel")).groupBy("volume").applyInPandas(run, "volume long, voxel long, cluster long")
    return out if group else out.drop("volume")


def cluster_table(stat: DataFrame, grid: Grid, threshold: float, least: int = 0) -> DataFrame:
    """(tail, cluster, size, mass, peak) above the threshold and below its negative, of more than ``least`` voxels."""
    parts = []
    for tail, sign in (("PositiveTail", 1.0), ("NegativeTail", -1.0)):
        own = stat.withColumn("s", sign * F.col("stat")).where(F.col("s") > threshold)
        named = cluster_voxels(own, grid).join(own.select("voxel", "s"), "voxel")
        parts.append(named.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("s") - threshold).alias("mass"), F.max("s").alias("peak")).where(F.col("size") > least).withColumn("tail", F.lit(tail)))
    return parts[0].unionByName(parts[1])
