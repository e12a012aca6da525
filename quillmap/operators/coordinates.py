"""Coordinates from images: peaks of each image's clusters, merged with the points that analyses have.

An image is one group of at most the grid's voxels, so images are the parallel unit; merging is a
union with an anti-join, and no list of ids leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.operators.clusters import label
from quillmap.operators.kernels import whole_analyses
from quillmap.plans.studyset import Grid, Studyset

MODES = ("fill", "replace", "demolish")
#: Subpeaks of a cluster, besides its peak.
MOST = 3


def peaks_of(value: np.ndarray, sizes: np.ndarray, threshold: float, least: int, distance: float, most: int) -> list[tuple[int, int, int, float]]:
    """(cluster, rank, voxel, value) of a volume: of each cluster above the threshold its peak, then up to ``most`` subpeaks.

    A cluster is named by its least voxel. A subpeak is a voxel that no face, edge or corner neighbour exceeds, and is
    at least ``distance`` mm from those taken before it; values fall, ties go to the least voxel.
    """
    value = np.where(value > threshold, value, -np.inf)
    marks = label(np.isfinite(value)).ravel()
    wide = np.pad(value, 1, constant_values=-np.inf)
    top = np.ones(value.shape, bool)
    for a, b, c in np.ndindex(3, 3, 3):
        top &= value >= wide[a : a + value.shape[0], b : b + value.shape[1], c : c + value.shape[2]]
    flat, out = value.ravel(), []
    for cluster in range(1, int(marks.max(initial=0)) + 1):
        own = np.flatnonzero(marks == cluster)
        if len(own) < least:
            continue
        name = int(own.min())
        own = own[np.lexsort((own, -flat[own]))]
        chosen: list[np.ndarray] = []
        for v in [own[0], *own[1:][top.ravel()[own[1:]]]]:
            at = sizes @ np.array(np.unravel_index(v, value.shape))
            if all(np.linalg.norm(at - other) >= distance for other in chosen):
                chosen.append(at)
                out.append((name, len(chosen), int(v), float(flat[v])))
            if len(chosen) > most:
                break
    return out


#: Voxels of the volumes that a task holds at once.
VOLUME_VOXELS = 1 << 21


def clusters_of(on: np.ndarray) -> np.ndarray:
    """Each voxel's cluster, named by the least voxel, in several volumes at once (the first axis); face neighbours take the lesser name until nothing changes."""
    n, size = len(on), on[0].size
    at = np.arange(size).reshape(on.shape[1:])
    pairs = []
    for axis in range(at.ndim):
        a, b = (np.take(at, range(lo, at.shape[axis] - 1 + lo), axis).ravel() for lo in (0, 1))
        v, e = np.nonzero(on.reshape(n, size)[:, a] & on.reshape(n, size)[:, b])
        pairs.append(np.stack([v * size + a[e], v * size + b[e]]))
    u, v = np.concatenate(pairs, 1)
    root = np.arange(on.size)
    while len(u):
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not ((up := root[root]) == root).all():
            root = up
    return root.reshape(n, size) - np.arange(n)[:, None] * size


def many_peaks(value: np.ndarray, sizes: np.ndarray, threshold: float, least: int, distance: float, most: int) -> tuple[np.ndarray, ...]:
    """(volume, cluster, rank, voxel, value) as ``peaks_of`` gives them for each volume of the first axis."""
    on = value > threshold
    size = on[0].size
    flat, name = value.reshape(len(on), size), clusters_of(on)
    volume, voxel = np.nonzero(on.reshape(len(on), size))
    key = volume * size + name[volume, voxel]
    order = np.lexsort((voxel, -flat[volume, voxel], key))
    volume, voxel, key = volume[order], voxel[order], key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(first, append=len(key))
    first, count = first[count >= least], count[count >= least]
    rank = np.ones(len(first), np.int64)
    if most and len(first):
        wide = np.pad(np.where(on, value, -np.inf), [(0, 0)] + [(1, 1)] * 3, constant_values=-np.inf)
        top, shape = np.ones(on.shape, bool), on.shape[1:]
        for a, b, c in np.ndindex(3, 3, 3):
            top &= value >= wide[:, a : a + shape[0], b : b + shape[1], c : c + shape[2]]
        is_top, taken, ranks = top.reshape(len(on), size)[volume, voxel], [], []
        for lo, n in zip(first.tolist(), count.tolist(), strict=True):
            chosen: list[np.ndarray] = []
            for r in [lo, *(lo + 1 + np.flatnonzero(is_top[lo + 1 : lo + n])).tolist()]:
                at = sizes @ np.array(np.unravel_index(voxel[r], shape))
                if all(np.linalg.norm(at - other) >= distance for other in chosen):
                    chosen.append(at)
                    taken.append(r)
                    ranks.append(len(chosen))
                if len(chosen) > most:
                    break
        first, rank = np.array(taken, np.int64), np.array(ranks, np.int64)
    return volume[first], key[first] % size, rank, voxel[first], flat[volume[first], voxel[first]]


def image_peaks(image: DataFrame, grid: Grid, threshold: float = 3.1, least: int = 0, distance: float = 8.0, two_sided: bool = False, subpeaks: bool = True) -> DataFrame:
    """(id, cluster, rank, voxel, value) of every image of (id, voxel, value); with ``two_sided`` of clusters below the negative threshold too.

    Images are dealt by id; a task labels the clusters of many of them at once.
    """
    kind = image.schema["id"].dataType.simpleString()
    shape, sizes, most = grid.shape, grid.matrix[:, :3], MOST if subpeaks else 0
    size = int(np.prod(shape))
    step = max(1, VOLUME_VOXELS // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, own in whole_analyses(batches):
            names = pa.concat_arrays(t["id"].chunks).take(pa.array(np.flatnonzero(np.diff(own, prepend=-1))))
            voxel, value = t["voxel"].to_numpy(), t["value"].to_numpy()
            for lo in range(0, len(names), step):
                a, b = np.searchsorted(own, [lo, lo + step])
                volumes = np.full((min(step, len(names) - lo), size), -np.inf)
                volumes[own[a:b] - lo, voxel[a:b]] = value[a:b]
                volumes = volumes.reshape(-1, *shape)
                parts = [many_peaks(volumes, sizes, threshold, least, distance, most)]
                if two_sided:
                    v, c, r, x, y = many_peaks(np.where(np.isfinite(volumes), -volumes, -np.inf), sizes, threshold, least, distance, most)
                    parts.append((v, c, r, x, -y))
                for v, c, r, x, y in parts:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lo + v)), pa.array(c), pa.array(r.astype(np.int32)), pa.array(x), pa.array(y)], ["id", "cluster", "rank", "voxel", "value"])

    # what no cluster can hold stays where it is
    some = F.abs("value") > threshold if two_sided else F.col("value") > threshold
    rows = image.where(some).select("id", F.col("voxel").cast("long").alias("voxel"), F.col("value").cast("double").alias("value"))
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(run, f"id {kind}, cluster long, rank int, voxel long, value double")


def points_of(peaks: DataFrame, grid: Grid, space: str) -> DataFrame:
    """Peaks as points, in mm, numbered by cluster and rank."""
    v = F.col("voxel")
    at = (F.floor(v / (grid.ny * grid.nz)), F.floor(v / grid.nz) % grid.ny, v % grid.nz)
    place = F.row_number().over(Window.partitionBy("id").orderBy("cluster", "rank", F.col("value").desc())) - 1
    rows = peaks.withColumns(dict(zip("xyz", grid.places(*(i.cast("double") for i in at)), strict=True)))
    return rows.select("id", place.alias("point_pos"), "x", "y", "z", F.lit(space).alias("space"), F.lit("center of mass").alias("kind"), F.create_map(F.lit("z_stat"), "value").alias("values"))


def merge(points: DataFrame | None, made: DataFrame, mode: str = "fill") -> DataFrame:
    """Points with a ``source``, original or generated.

    ``fill`` adds generated points to analyses that have none; ``replace`` takes them for the
    points of analyses for which there are any; ``demolish`` keeps nothing else.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    new = made.withColumn("source", F.lit("generated"))
    if points is None or mode == "demolish":
        return new
    old = points.withColumn("source", F.lit("original"))
    if mode == "fill":
        new = new.join(points.select("id").distinct(), "id", "left_anti")
    else:
        old = old.join(made.select("id").distinct(), "id", "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def images_to_coordinates(ss: Studyset, image: DataFrame, grid: Grid, mode: str = "fill", threshold: float = 3.1, least: int = 0, distance: float = 8.0, two_sided: bool = False, subpeaks: bool = True) -> Studyset:
    """The studyset with points from images (id, voxel, value of z), and a field coordinate_source of its analyses."""
    if mode == "fill" and ss.point is not None:  # no image of an analysis with points is looked at
        image = image.join(ss.point.select("id").distinct(), "id", "left_anti")
    own = image.join(ss.analysis.select("id"), "id", "left_semi")
    made = points_of(image_peaks(own, grid, threshold, least, distance, two_sided, subpeaks), grid, ss.space)
    merged = merge(ss.point, made, mode)
    generated = merged.where("source = 'generated'").select("id").distinct().withColumn("_new_", F.lit("generated"))
    analysis = ss.analysis.drop("coordinate_source").join(generated, "id", "left").withColumn("coordinate_source", F.coalesce("_new_", F.lit("original"))).drop("_new_")
    return ss.with_(point=merged.drop("source"), analysis=analysis)
