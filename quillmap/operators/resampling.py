"""Stability under leaving analyses out and under subsamples, and maps of two groups of unequal size by balanced subsamples.

A replicate is a set of analyses of exact size: those whose hash with the replicate's number is at
most a cut, which is found by counting. So a replicate is never a table: tasks that hold stripes of
voxels decide membership themselves (``pairwise.subset_volumes``), and what comes from each replicate is one volume of an
additive statistic: sums of ln(1 - value) for ALE, of values for KDA, of weighted values with their weights for MKDA density.
Volumes are thresholded, and clusters below a size dropped, where they are; only counts of voxels are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators import cbma, clusters, pairwise
from quillmap.plans.studyset import Grid

KINDS = ("ale", "kda", "mkda")


def terms_of(ma: DataFrame, kind: str, grid: Grid, weights: DataFrame | None = None) -> DataFrame:
    """(id, voxel, term) of an additive statistic. MKDA's weights (id, weight; 1 without) are also terms at the voxel after the last; a column ``weight`` of ``ma`` saves joining them."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    if kind == "ale":
        return cbma._log_terms(ma)
    if kind == "kda":
        return ma.select("id", "voxel", F.col("value").alias("term"))
    own = ma.select("id").distinct().withColumn("weight", F.lit(1.0)) if weights is None else weights.select("id", F.col("weight").cast("double").alias("weight"))
    at = (ma if "weight" in ma.columns else ma.join(own, "id")).select("id", F.col("voxel").cast("long").alias("voxel"), (F.col("weight") * F.col("value")).alias("term"))
    return at.unionByName(own.select("id", F.lit(int(np.prod(grid.shape))).cast("long").alias("voxel"), F.col("weight").alias("term")))


def statistic(volume: np.ndarray, kind: str) -> np.ndarray:
    """The statistic of a volume of sums; MKDA's as a share of all weights."""
    if kind == "ale":
        return -np.expm1(volume)
    return volume if kind == "kda" else volume[:-1] / (volume[-1] or 1.0)


def passing(stat: np.ndarray, grid: Grid, inside: np.ndarray, threshold: float, least: float) -> np.ndarray:
    """Voxels of the mask above the threshold, in clusters of at least so many."""
    on = (stat.reshape(grid.shape) > threshold) & inside
    if least > 1 and on.any():
        marks = clusters.label(on)
        sizes = np.bincount(marks.ravel())
        sizes[0] = 0
        on = sizes[marks] >= least
    return on.ravel()


def taken(ids: DataFrame, chosen: Callable[[np.ndarray, int], np.ndarray], n: int) -> DataFrame:
    """Ids that at least one of ``n`` replicates takes."""
    names = ids.select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, some = b.column("h").to_numpy(), np.zeros(b.num_rows, bool)
            for it in range(n):
                some |= chosen(h, it)
            yield b.filter(pa.array(some)).select(["id"])

    return names.withColumn("h", F.xxhash64("id")).mapInArrow(run, f"id {names.schema['id'].dataType.simpleString()}")


def subsamples(terms: DataFrame | Callable[[DataFrame], DataFrame], ids: DataFrame, size: int, n: int, grid: Grid, kind: str, seed: int = 0, joined: bool = False) -> DataFrame:
    """(iteration, part): the sums of ``n`` subsamples of ``size`` analyses of ``ids``.

    ``terms`` may be a function of ids, which then is asked for the analyses that a subsample takes only; ``joined`` says that terms have no others than ``ids``.
    """
    every = ids.select("id").distinct().count()
    if not 0 < size <= every:
        raise ValueError(f"a subsample of {size} of {every} analyses")
    cuts = cbma.label_cuts(ids, size, n, seed)
    chosen = lambda h, it: cbma._draws(h, np.array([it]), seed)[:, 0].astype(np.int64) <= cuts[it]
    if callable(terms):
        own = terms(taken(ids, chosen, n))
    else:
        own = terms if joined else terms.join(ids.select("id").distinct(), "id", "left_semi")
    return pairwise.subset_volumes(own, chosen, n, grid, int(kind == "mkda"))


def support(volumes: DataFrame, grid: Grid, kind: str, threshold: float, n: int, least: float = 0) -> DataFrame:
    """(voxel, support): the share of ``n`` replicates in which a voxel passes."""
    inside = grid.mask_array()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.zeros(inside.size, np.int64)
        for b in batches:
            for raw in b["part"]:
                hits += passing(statistic(np.frombuffer(raw), kind), grid, inside, threshold, least)
        at = np.flatnonzero(hits)
        yield pd.DataFrame({"voxel": at, "hits": hits[at]})

    found = volumes.mapInPandas(run, "voxel long, hits long").groupBy("voxel").agg(F.sum("hits").alias("hits"))
    mask = grid.mask(volumes.sparkSession).select(F.col("voxel").cast("long").alias("voxel"))
    return mask.join(found, "voxel", "left").select("voxel", (F.coalesce("hits", F.lit(0)) / F.lit(float(n))).alias("support"))


def stability(ma: DataFrame, ids: DataFrame, grid: Grid, threshold: float, kind: str = "ale", size: int | None = None, leave: int | None = None, n: int = 1000, least: float = 0, weights: DataFrame | None = None, seed: int = 0, joined: bool = False) -> DataFrame:
    """(voxel, support): over subsamples of ``size`` analyses, or of all but ``leave``, the share that keeps a voxel above the threshold (in clusters of ``least`` voxels).

    ``joined`` says that ``ma`` and the weights have no other analyses than ``ids``.
    """
    if (size is None) == (leave is None):
        raise ValueError("give the size of subsamples, or how many analyses are left out")
    every = ids.select("id").distinct().count()
    size = every - leave if size is None else size
    return support(subsamples(terms_of(ma, kind, grid, weights), ids, size, n, grid, kind, seed, joined), grid, kind, threshold, n, least)


def cluster_size_null(spark: SparkSession, foci: DataFrame, size: int, grid: Grid, threshold: float, kind: str = "ale", r: float = 10.0, fwhm: float | None = None, n_iters: int = 1000, alpha: float = 0.05, seed: int = 0) -> float:
    """The 1 - ``alpha`` percentile of the largest cluster when ``size`` random analyses of ``foci`` (id, n) have random foci."""
    maxima = cbma.monte_carlo(spark, foci, grid.mask(spark), grid, r, n_iters, seed, kind, threshold, fwhm, size)
    return float(maxima.agg(F.percentile("max_size", 1 - alpha)).first()[0] or 0.0)


def mean_difference(one: DataFrame, two: DataFrame, grid: Grid, per: int) -> DataFrame:
    """(iteration, part): ALE differences of pairs of replicates, averaged over each ``per`` of them in a row."""
    size = int(np.prod(grid.shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                d = (-np.expm1(np.frombuffer(row.one)) + np.expm1(np.frombuffer(row.two))) / per
                yield pd.DataFrame({"iteration": [row.iteration // per], "block": [row.iteration % per], "part": [d.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for x in rows.sort_values("block")["part"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"iteration": [key[0]], "block": [key[1]], "part": [total.tobytes()]})

    kind, blocks = "iteration long, block long, part binary", per
    out = one.withColumnRenamed("part", "one").join(two.withColumnRenamed("part", "two"), "iteration").mapInPandas(run, kind)
    while blocks > 1:
        blocks = -(-blocks // cbma.ADD_VOLUMES)
        out = out.groupBy("iteration", F.floor(F.col("block") / cbma.ADD_VOLUMES).alias("into")).applyInPandas(add, kind)
    return out.select("iteration", "part")


def balanced(ma: DataFrame | Callable[[DataFrame], DataFrame], group1: DataFrame, group2: DataFrame, foci: DataFrame, grid: Grid, threshold: float, size: int, n_subsamples: int = 2500, n_iters: int = 1000, per: int = 10, alpha: float = 0.05, fwhm: float | None = None, seed: int = 0) -> DataFrame:
    """(voxel, prob1, prob2, conjunction, difference, p): two groups compared by subsamples of the same ``size``.

    prob1 and prob2 are the shares of a group's subsamples in which a voxel passes the threshold in a cluster
    that is not smaller than the 1 - ``alpha`` percentile of the group's own null of clusters. The difference is the
    mean of ``per`` differences of ALE between subsamples of both; its null permutes the groups' labels, and in each
    labelling takes as many pairs of subsamples. ``ma`` may be a function of ids, which is asked for the analyses of some subsample only. p is 1 unless a voxel is beyond the percentile alpha / 2 of the null's least, or
    1 - alpha / 2 of its largest, values; then it is the share of labellings with one as extreme, 1 / n_iters at least.
    """
    from quillmap.operators.text import checkpointed

    cbma.apart(group1, group2)
    spark, inside = foci.sparkSession, grid.mask_array().ravel()
    terms = (lambda ids: terms_of(ma(ids), "ale", grid)) if callable(ma) else terms_of(ma, "ale", grid)
    maps = []
    for place, group in enumerate((group1, group2)):
        own = foci.join(group.select("id").distinct(), "id", "left_semi")
        least = cluster_size_null(spark, own, size, grid, threshold, fwhm=fwhm, n_iters=n_iters, alpha=alpha, seed=seed + place)
        volumes = subsamples(terms, group, size, n_subsamples, grid, "ale", seed + place)
        maps.append(support(volumes, grid, "ale", threshold, n_subsamples, least).withColumnRenamed("support", f"prob{place + 1}"))
    seen = mean_difference(*(subsamples(terms, g, size, per, grid, "ale", seed + 10 + i) for i, g in enumerate((group1, group2))), grid, per)
    difference = np.zeros(inside.size)
    for r in seen.toLocalIterator():  # one volume
        difference = np.frombuffer(bytes(r["part"]))
    # labellings, and in each of them subsamples of both sides: draws of a second kind, among those of one label
    ids = group1.select("id").unionByName(group2.select("id")).distinct()
    cuts = cbma.label_cuts(ids, group1.select("id").distinct().count(), n_iters, seed + 20)
    first = lambda h, its: cbma._draws(h, its // per, seed + 20).astype(np.int64) <= cuts[its // per]
    sides = []
    for side, of_side in enumerate((first, lambda h, its: ~first(h, its))):
        nested = cbma.label_cuts(ids, size, n_iters * per, seed + 21 + side, of_side)

        def chosen(h: np.ndarray, it: int, side: int = side, of_side=of_side, nested: np.ndarray = nested) -> np.ndarray:
            its = np.array([it])
            return (of_side(h, its) & (cbma._draws(h, its, seed + 21 + side).astype(np.int64) <= nested[it]))[:, 0]

        sides.append(pairwise.subset_volumes(terms(taken(ids, chosen, n_iters * per)) if callable(terms) else terms.join(ids, "id", "left_semi"), chosen, n_iters * per, grid))

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["part"]:
                d = np.frombuffer(raw)[inside]
                yield pd.DataFrame({"least": [d.min()], "largest": [d.max()]})

    null = checkpointed(mean_difference(*sides, grid, per).mapInPandas(extremes, "least double, largest double")).toPandas()
    least, largest = np.sort(null["least"].to_numpy()), np.sort(null["largest"].to_numpy())
    low, high = np.percentile(least, 100 * alpha / 2), np.percentile(largest, 100 * (1 - alpha / 2))
    n = len(largest)
    up = (n - np.searchsorted(largest, difference, "left")) / n
    down = np.searchsorted(least, difference, "right") / n
    p = np.where(difference > high, np.maximum(up, 1 / n), np.where(difference < low, np.maximum(down, 1 / n), 1.0))
    at = np.flatnonzero(inside)
    rows = spark.createDataFrame(pd.DataFrame({"voxel": at, "difference": difference[at], "p": p[at]}))  # of the grid's size
    return maps[0].join(maps[1], "voxel").join(rows, "voxel").select("voxel", "prob1", "prob2", F.least("prob1", "prob2").alias("conjunction"), "difference", "p")
