"""Family-wise inference for two groups: whole permuted volumes, their largest statistics and clusters.

Under permuted labels, volumes that fit a task are summed where the terms (id, voxel, term) are. Others' terms are dealt once, by stripes of voxels and, where a
stripe has many rows, parts of the ids. Each of these tasks computes an id's label from a hash of
(id, iteration) and gives its stripe's sums for each iteration; the stripes of an iteration are then put together to a
volume (parts are added), whose statistic, and largest clusters, are found where it is. So neither labels nor
permuted activations are rows, no task holds more than one volume, and a busy voxel is not one task's work.
Random foci come as volumes from ``cbma.simulated``, one of each group, and meet by iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions import special
from quillmap.operators import cbma, clusters, kernels
from quillmap.plans.studyset import Grid

#: Rows that one task holds, bytes that it returns, and parts of a stripe that are added at once.
TASK_ROWS, TASK_BYTES, ADD_PARTS = 2_000_000, 64 << 20, 8
#: Rows whose ids' labels a task computes at once.
HELD_ROWS = 1_000_000
FAMILIES = ("uniformity", "group2", "association")
MAXIMA = "iteration long, family string, max_stat double, max_size long, max_mass double"


def grouped(point: DataFrame, group1: DataFrame, group2: DataFrame) -> DataFrame:
    """Points of both groups' analyses, with their group ``g`` (1 or 2), which kernels ``keep`` so that activations need no join."""
    return point.join(group1.select("id", F.lit(1).alias("g")).unionByName(group2.select("id", F.lit(2).alias("g"))).distinct(), "id")


def permuted_volumes(terms: DataFrame, group1: DataFrame, group2: DataFrame, grid: Grid, n_iters: int, seed: int = 0) -> DataFrame:
    """(iteration, part): for each labelling the sums over the analyses labelled as the first group, as a volume's bytes.

    Terms with a column ``g`` are of analyses of the groups only (see ``grouped``).
    """
    ids = group1.select("id").unionByName(group2.select("id")).distinct()
    cuts = cbma.label_cuts(ids, group1.select("id").distinct().count(), n_iters, seed)
    own = terms if "g" in terms.columns else terms.join(ids, "id", "left_semi")
    return subset_volumes(own, lambda h, it: cbma._draws(h, np.array([it]), seed)[:, 0].astype(np.int64) <= cuts[it], n_iters, grid)


def subset_volumes(terms: DataFrame, chosen: Callable[[np.ndarray, int], np.ndarray], n_iters: int, grid: Grid, more: int = 0) -> DataFrame:
    """(iteration, part): for each iteration the sums of terms (id, voxel, term) over the ids that ``chosen`` (hashes of ids, iteration) takes.

    A volume has ``more`` numbers after the grid's, of terms at voxels beyond it.
    """
    size = int(np.prod(grid.shape)) + more
    rows = terms.select(F.xxhash64("id").alias("h"), F.col("voxel").cast("long").alias("voxel"), F.col("term").cast("double").alias("term"))
    if 8 * size * n_iters <= TASK_BYTES:
        return small_volumes(rows, chosen, n_iters, size)
    n, threads = rows.count(), terms.sparkSession.sparkContext.defaultParallelism
    stripes = int(min(size, max(threads, -(-n // TASK_ROWS), -(-8 * size * n_iters // TASK_BYTES))))
    parts = max(1, -(-n // (TASK_ROWS * stripes)))
    long = -(-size // stripes)

    def sums(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "voxel"])
        names, at = np.unique(own["h"].to_numpy(), return_inverse=True)
        place, term = own["voxel"].to_numpy() // stripes, own["term"].to_numpy()
        out = []
        for it in range(n_iters):
            one = chosen(names, it)[at]
            out.append(np.bincount(place[one], term[one], long).tobytes())
        return pd.DataFrame({"iteration": np.arange(n_iters), "stripe": key[0], "part": key[1], "sums": out})

    def add(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in own.sort_values("part")["sums"])
        return pd.DataFrame({"iteration": [key[0]], "stripe": [key[1]], "part": [key[2]], "sums": [total.tobytes()]})

    def assemble(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        volume = np.zeros((long, stripes))
        for stripe, raw in zip(own["stripe"], own["sums"], strict=True):
            volume[:, stripe] = np.frombuffer(raw)
        return pd.DataFrame({"iteration": [key[0]], "part": [volume.ravel()[:size].tobytes()]})

    kind = "iteration long, stripe long, part long, sums binary"
    dealt = rows.withColumn("stripe", F.pmod("voxel", F.lit(stripes))).withColumn("part", F.pmod("h", F.lit(parts)))
    pieces = dealt.groupBy("stripe", "part").applyInPandas(sums, kind)
    while parts > 1:
        parts = -(-parts // ADD_PARTS)
        pieces = pieces.groupBy("iteration", "stripe", F.floor(F.col("part") / ADD_PARTS).alias("into")).applyInPandas(add, kind)
    return pieces.groupBy("iteration").applyInPandas(assemble, "iteration long, part binary")


def small_volumes(rows: DataFrame, chosen: Callable[[np.ndarray, int], np.ndarray], n_iters: int, size: int, labelled: bool = False) -> DataFrame:
    """(iteration, part) as ``subset_volumes`` from rows (h, voxel, term), where the volumes of all iterations fit a task.

    With ``labelled`` rows have a fourth column, and two more volumes, summed in the same order, are of the rows it marks and of all.

    Terms add up wherever they are, so no row is dealt: each task sums its own, and only its volumes are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros((n_iters + 2 * labelled, size)), [], 0
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                n += b.num_rows
            if n >= HELD_ROWS:
                add_chosen(total, n_iters, chosen, *map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            add_chosen(total, n_iters, chosen, *map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([row.tobytes() for row in total], pa.binary())], ["iteration", "part"])

    return added(rows.mapInArrow(run, "iteration long, part binary"), size)


def added(parts: DataFrame, size: int) -> DataFrame:
    """(iteration, part): the sum of all tasks' volumes of each iteration."""

    def add(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for x in own.sort_values("task")["part"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"iteration": [key[0]], "task": [key[1]], "part": [total.tobytes()]})

    kind = "iteration long, task long, part binary"
    parts = parts.withColumn("task", F.spark_partition_id().cast("long"))
    # two levels, so that a group holds about the root of as many volumes as there are tasks
    for level in (F.pmod(F.col("task"), F.lit(32)), F.lit(0).cast("long")):
        parts = parts.groupBy("iteration", level.alias("into")).applyInPandas(add, kind)
    return parts.select("iteration", "part")


def group_ids(point: DataFrame, group1: DataFrame, group2: DataFrame, grid: Grid, stamps: kernels.Stamps) -> tuple[DataFrame, DataFrame]:
    """Rows (id, cell, label, h) of points and of both groups, which meet by id in one shuffle, and (h, label): a hash of the id of each analysis with a point, with its group. Analyses in both groups are an error."""
    labels = group1.select("id", F.lit(1).cast("tinyint").alias("label")).unionByName(group2.select("id", F.lit(2).cast("tinyint").alias("label"))).where("id is not null")
    rows = kernels.labelled_rows(point, labels, grid, stamps).withColumn("h", F.xxhash64("id"))

    of = rows.groupBy("id").agg(F.max(F.col("label").isNull()).alias("point"), F.min("label").alias("least"), F.max("label").alias("most")).where("point and least is not null")
    from quillmap.operators.text import checkpointed

    ids = checkpointed(of.select(F.xxhash64("id").alias("h"), F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(3).alias("label")))
    if not ids.where("label = 3").isEmpty():
        raise ValueError("the groups share analyses")
    return rows, ids


def permuted_counts(rows: DataFrame, chosen: Callable[[np.ndarray, int], np.ndarray], n_iters: int, stamps: kernels.Stamps) -> DataFrame:
    """(iteration, part): for each labelling how many of the analyses it takes have a sphere at each voxel, from ``group_ids``' rows; then, as two more, of the first group and of both.

    An analysis is a row of a matrix only where its points are.
    """
    size = stamps.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_iters + 2, size))
        for t, own in kernels.whole_analyses(batches):
            group, at = kernels.two_groups(t, own)
            h = t["h"].to_numpy()[np.flatnonzero(np.diff(own, prepend=-1))]
            takes = np.ones((n_iters + 2, len(h)), np.float32)
            for it in range(n_iters):
                takes[it] = chosen(h, it)
            takes[n_iters] = group == 1
            for start, row, voxel, _ in stamps.each(*stamps.distinct(t.take(pa.array(at)), own[at])):
                if not len(row):
                    continue
                n = int(row[-1]) + 1
                if n * size <= kernels.STAMPS:
                    on = np.zeros((n, size), np.float32)  # counts of fewer than 2**24 are exact
                    on[row, voxel] = 1
                    total += takes[:, start : start + n] @ on
                else:
                    for it in range(n_iters + 2):
                        total[it] += np.bincount(voxel[takes[it, start + row] > 0], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([v.tobytes() for v in total], pa.binary())], ["iteration", "part"])

    return added(rows.mapInArrow(run, "iteration long, part binary"), size)


def add_chosen(total: np.ndarray, n_iters: int, chosen: Callable[[np.ndarray, int], np.ndarray], h: np.ndarray, voxel: np.ndarray, term: np.ndarray, one: np.ndarray | None = None) -> None:
    """Add the terms of the ids that each iteration takes to its volume: a product of matrices where rows fill the volumes well, else one by one."""
    size = total.shape[1]
    order = np.argsort(h, kind="stable")
    h, voxel, term = h[order], voxel[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    names, at = h[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    takes = np.ones((len(total), len(names)), bool)
    for it in range(n_iters):
        takes[it] = chosen(names, it)
    if one is not None:
        takes[n_iters] = one[order][first]
    if len(names) * size > 64 * len(h):
        for it in range(len(total)):
            own = takes[it][at]
            total[it] += np.bincount(voxel[own], term[own], size)
        return
    step = max(1, (1 << 20) // size)
    for lo in range(0, len(names), step):
        hi = min(lo + step, len(names))
        a, b = first[lo], first[hi] if hi < len(first) else len(h)
        terms = np.bincount((at[a:b] - lo) * size + voxel[a:b], term[a:b], (hi - lo) * size).reshape(hi - lo, size)
        total += takes[:, lo:hi].astype(float) @ terms


def total_volume(terms: DataFrame, grid: Grid) -> np.ndarray:
    """The sum of all analyses' terms: as many numbers as the grid has voxels."""
    out = np.zeros(int(np.prod(grid.shape)))
    rows = terms.groupBy("voxel").agg(F.sum("term").alias("s")).toArrow()
    out[rows["voxel"].to_numpy().astype(np.int64)] = rows["s"].to_numpy()
    return out


def one_way(x: np.ndarray, n: float) -> np.ndarray:
    """Chi-square of counts against their mean, each of n; 0 where the mean is 0 or n."""
    mean = x.mean() if len(x) else 0.0
    den = mean * (n - mean)
    return (x - mean) ** 2 * n / den if den > 0 else np.zeros(len(x))


def two_way(a: np.ndarray, b: np.ndarray, n1: float, n2: float) -> np.ndarray:
    """2 x 2 chi-square of counts; 2.0 where its denominator is 0."""
    den = (a + b) * (n1 + n2 - a - b) * n1 * n2
    return np.where(den == 0, 2.0, (n1 + n2) * (a * n2 - b * n1) ** 2 / np.where(den == 0, 1.0, den))


def chi2_families(a: np.ndarray, b: np.ndarray, n1: float, n2: float) -> dict[str, np.ndarray]:
    """The three families of tests at the mask's voxels: activity of each group against its mean, and their difference."""
    return dict(zip(FAMILIES, (one_way(a, n1), one_way(b, n2), two_way(a, b, n1, n2)), strict=True))


def largest(values: np.ndarray, inside: np.ndarray, threshold: float | None) -> tuple[float, int, float]:
    """Largest absolute value of the mask's voxels, and the largest size and mass of clusters of either sign beyond the threshold."""
    top, size, mass = float(np.abs(values).max(initial=0.0)), 0, 0.0
    if threshold is None:
        return top, size, mass
    volume = np.zeros(inside.shape)
    volume[inside] = values
    for sign in (1.0, -1.0):
        marks = clusters.label(sign * volume > threshold).ravel()
        if marks.any():
            size = max(size, int(np.bincount(marks)[1:].max()))
            mass = max(mass, float(np.bincount(marks, sign * volume.ravel() - threshold)[1:].max()))
    return top, size, mass


def volume_maxima(volumes: DataFrame, grid: Grid, families: Callable[..., dict[str, np.ndarray]], threshold: float | None, parts: tuple[str, ...] = ("part",)) -> DataFrame:
    """(iteration, family, max_stat, max_size, max_mass) of volumes; ``families`` gives statistics of the mask's voxels."""
    inside = grid.mask_array()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = families(*[np.frombuffer(getattr(row, p))[inside.ravel()] for p in parts])
                yield pd.DataFrame([(row.iteration, name, *largest(v, inside, threshold)) for name, v in own.items()], columns=["iteration", "family", "max_stat", "max_size", "max_mass"])

    return volumes.mapInPandas(run, MAXIMA)


def with_p(observed: DataFrame, maxima: DataFrame, grid: Grid, threshold: float | None) -> DataFrame:
    """(family, voxel, stat, p_voxel, p_size, p_mass): the share of iterations with a maximum at least as large, clipped to [1/n, 1 - 1/n].

    ``observed`` has (family, voxel, stat). A voxel in no cluster has 1 for those. The maxima,
    three numbers an iteration and family, go to all tasks.
    """
    own = {(r["family"], c): [] for r in maxima.select("family").distinct().collect() for c in ("max_stat", "max_size", "max_mass")}
    for r in maxima.toLocalIterator():
        for c in ("max_stat", "max_size", "max_mass"):
            own[r["family"], c].append(r[c])
    sent = observed.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, float)) for k, v in own.items()})

    def tail(name: str):
        def share(family: pd.Series, value: pd.Series) -> pd.Series:
            out = np.full(len(value), np.nan)
            for f in family.unique():
                null, at = sent.value[f, name], (family == f).to_numpy()
                n = len(null)
                out[at] = np.clip((n - np.searchsorted(null, value[at].to_numpy() * (1 - 1e-12), "left")) / n, 1 / n, 1 - 1 / n)
            return pd.Series(out)

        return F.pandas_udf(share, "double")

    rows = observed.select("family", F.col("voxel").cast("long").alias("voxel"), F.col("stat").cast("double").alias("stat"))
    out = rows.withColumn("p_voxel", tail("max_stat")("family", F.abs("stat")))
    if threshold is None:
        return out.withColumns({"p_size": F.lit(1.0), "p_mass": F.lit(1.0)})
    # clusters of each family and sign are volumes of their own
    sign = F.when(F.col("stat") > threshold, 1).when(F.col("stat") < -threshold, -1)
    above = rows.withColumn("volume", F.abs(F.xxhash64("family", sign))).where(sign.isNotNull())
    named = above.join(clusters.cluster_voxels(above.select("volume", "voxel"), grid), ["volume", "voxel"])
    groups = named.groupBy("volume", "cluster", "family").agg(F.count("*").cast("double").alias("size"), F.sum(F.abs("stat") - threshold).alias("mass"))
    groups = groups.select("volume", "cluster", tail("max_size")("family", "size").alias("p_size"), tail("max_mass")("family", "mass").alias("p_mass"))
    of_voxel = named.join(groups, ["volume", "cluster"]).select("family", "voxel", "p_size", "p_mass")
    return out.join(of_voxel, ["family", "voxel"], "left").fillna(1.0, ["p_size", "p_mass"])


def with_z(rows: DataFrame) -> DataFrame:
    """Add z and -log10 p of each level; z takes the statistic's sign."""
    sign = F.when(F.col("stat") < 0, -1.0).otherwise(1.0)
    return rows.withColumns({f"{k}_{level}": v for level in ("voxel", "size", "mass") for k, v in (("z", sign * special.p_to_z_udf(f"p_{level}")), ("logp", -F.log10(f"p_{level}")))})


def long_families(wide: DataFrame) -> DataFrame:
    """(family, voxel, stat) of a table with a column for each family."""
    return wide.select("voxel", F.explode(F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.col(f))])).alias("family", "stat"))


def chi2_observed(active: DataFrame, group1: DataFrame, group2: DataFrame, mask: DataFrame) -> DataFrame:
    """(family, voxel, stat) of the three families, from one pass of counts over ``active`` (id, voxel)."""
    flagged = group1.select("id", F.lit(1).alias("g")).unionByName(group2.select("id", F.lit(0).alias("g"))).distinct()
    own = active.withColumn("g", 2 - F.col("g")) if "g" in active.columns else active.join(flagged, "id")
    n = flagged.agg(F.sum("g").cast("double").alias("n1"), F.sum(1 - F.col("g")).cast("double").alias("n2"))
    counts = own.groupBy("voxel").agg(F.sum("g").cast("double").alias("a"), F.sum(1 - F.col("g")).cast("double").alias("b"))
    v = mask.select("voxel").join(counts, "voxel", "left").fillna(0.0, ["a", "b"])
    v = v.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(v.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return long_families(v.select("voxel", zero(cbma.one_way(F.col("a"), F.col("n1"), F.col("mean_a"))).alias("uniformity"), zero(cbma.one_way(F.col("b"), F.col("n2"), F.col("mean_b"))).alias("group2"), cbma.two_way(F.col("a"), F.col("b"), F.col("n1"), F.col("n2")).alias("association")))


def chi2_null(active: DataFrame, group1: DataFrame, group2: DataFrame, grid: Grid, n_iters: int, threshold: float | None, seed: int = 0) -> DataFrame:
    """Maxima of the three families under permuted labels."""
    cbma.apart(group1, group2)
    both = group1.select("id").unionByName(group2.select("id")).distinct()
    terms = active.select("id", "voxel", "g", F.lit(1.0).alias("term")) if "g" in active.columns else active.select("id", "voxel", F.lit(1.0).alias("term")).join(both, "id", "left_semi")
    n1, n2 = (float(g.select("id").distinct().count()) for g in (group1, group2))
    total = total_volume(terms, grid)[grid.mask_array().ravel()]
    return volume_maxima(permuted_volumes(terms, group1, group2, grid, n_iters, seed), grid, lambda a: chi2_families(a, total - a, n1, n2), threshold)


def chi2_foci_null(spark: SparkSession, foci1: DataFrame, foci2: DataFrame, grid: Grid, r: float, n_iters: int, threshold: float | None, seed: int = 0, pool: np.ndarray | None = None) -> DataFrame:
    """Maxima of the three families when both groups' foci (id, n) are drawn at random from the mask, or from a ``pool`` of cells."""
    pool = np.argwhere(grid.mask_array()) if pool is None else pool
    n1, n2 = (float(f.select("id").distinct().count()) for f in (foci1, foci2))
    one, two = (cbma.simulated(spark, f, pool, grid, n_iters, "mkda", r, seed=seed + i).withColumnRenamed("part", name) for i, (f, name) in enumerate(((foci1, "one"), (foci2, "two"))))
    return volume_maxima(one.join(two, "iteration"), grid, lambda a, b: chi2_families(a, b, n1, n2), threshold, ("one", "two"))


def chi2_fwe(active: DataFrame, group1: DataFrame, group2: DataFrame, grid: Grid, n_iters: int = 1000, voxel_p: float = 0.001, seed: int = 0, null: DataFrame | None = None) -> DataFrame:
    """Voxel, size and mass p of the chi-square families under permuted labels, or a given null; clusters are of voxels with an uncorrected p below ``voxel_p``."""
    from quillmap.operators.text import checkpointed

    threshold = chi2_threshold(voxel_p)
    maxima = checkpointed(chi2_null(active, group1, group2, grid, n_iters, threshold, seed) if null is None else null)
    return with_p(chi2_observed(active, group1, group2, grid.mask(active.sparkSession)), maxima, grid, threshold)


def chi2_threshold(p: float) -> float:
    """The chi-square of one degree of freedom with this upper tail: the square of a two-sided z."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - p / 2) ** 2


def exact_quantile(volumes: DataFrame, values: Callable[[bytes], np.ndarray], q: float, bins: int = 1 << 12) -> float:
    """The quantile (linear between order statistics) of all numbers of all volumes, by counts of ranges that narrow around it."""

    def counted(lo: float, hi: float) -> dict[int, int]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for raw in b["part"]:
                    x = values(raw)
                    x = x[(x >= lo) & (x <= hi)]
                    at = np.minimum(((x - lo) / (hi - lo) * bins).astype(np.int64), bins - 1) if hi > lo else np.zeros(len(x), np.int64)
                    found, n = np.unique(at, return_counts=True)
                    yield pd.DataFrame({"bin": found, "n": n})

        return {r["bin"]: r["n"] for r in volumes.mapInPandas(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["part"]:
                x = values(raw)
                yield pd.DataFrame({"lo": [x.min()], "hi": [x.max()], "n": [len(x)]})

    e = volumes.mapInPandas(ends, "lo double, hi double, n long").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).first()
    if not e["n"]:
        return 0.0
    place = q * (e["n"] - 1)

    def order_statistic(k: int) -> float:
        lo, hi, before = e["lo"], e["hi"], 0
        for _ in range(8):
            counts = counted(lo, hi)
            seen = before
            for b in sorted(counts):
                if seen + counts[b] > k:
                    break
                seen += counts[b]
            before, width = seen, (hi - lo) / bins
            lo, hi = lo + b * width, (lo + (b + 1) * width if b < bins - 1 else hi)
            if counts[b] <= 100_000:
                break

        def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for raw in b["part"]:
                    x = values(raw)
                    found, n = np.unique(x[(x >= lo - abs(lo) * 1e-12) & (x <= hi)], return_counts=True)
                    yield pd.DataFrame({"x": found, "n": n})

        def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"n": [int(sum((values(raw) < lo - abs(lo) * 1e-12).sum() for raw in b["part"]))]})

        rows = sorted((r["x"], r["n"]) for r in volumes.mapInPandas(inside, "x double, n long").groupBy("x").agg(F.sum("n").alias("n")).collect())
        left = k - (volumes.mapInPandas(below, "n long").agg(F.sum("n")).first()[0] or 0)
        for x, n in rows:
            if left < n:
                return x
            left -= n
        return rows[-1][0]

    low = order_statistic(int(np.floor(place)))
    high = order_statistic(int(np.ceil(place))) if place % 1 else low
    return float(low + (high - low) * (place % 1))


def subtraction_fwe(ma: DataFrame, group1: DataFrame, group2: DataFrame, grid: Grid, n_iters: int = 1000, voxel_p: float = 0.001, seed: int = 0) -> DataFrame:
    """Voxel, size and mass p of the difference of two groups' ALE under permuted labels.

    Clusters are of absolute differences beyond the quantile 1 - ``voxel_p`` of those of all labellings and voxels.
    """
    from quillmap.operators.text import checkpointed

    cbma.apart(group1, group2)
    both = group1.select("id").unionByName(group2.select("id")).distinct()
    terms = cbma._log_terms(ma, "g") if "g" in ma.columns else cbma._log_terms(ma.join(both, "id", "left_semi"))
    inside = grid.mask_array().ravel()
    total = total_volume(terms, grid)[inside]
    difference = lambda a: np.exp(total - a) - np.exp(a)
    volumes = checkpointed(permuted_volumes(terms, group1, group2, grid, n_iters, seed))
    threshold = exact_quantile(volumes, lambda raw: np.abs(difference(np.frombuffer(raw)[inside])), 1 - voxel_p)
    maxima = checkpointed(volume_maxima(volumes, grid, lambda a: {"difference": difference(a)}, threshold))
    flagged = terms.withColumn("one", 2 - F.col("g")) if "g" in terms.columns else terms.join(group1.select("id").distinct().withColumn("one", F.lit(1)), "id", "left")
    sums = flagged.groupBy("voxel").agg(F.sum("term").alias("t"), F.coalesce(F.sum(F.when(F.col("one") == 1, F.col("term"))), F.lit(0.0)).alias("a"))
    seen = grid.mask(ma.sparkSession).select("voxel").join(sums, "voxel", "left").fillna(0.0, ["t", "a"])
    seen = seen.select(F.lit("difference").alias("family"), "voxel", (F.exp(F.col("t") - F.col("a")) - F.exp("a")).alias("stat"))
    return with_p(seen, maxima, grid, threshold)


def scale_fwe(ma: DataFrame, foci: DataFrame, pool: np.ndarray, grid: Grid, n_iters: int = 1000, fwhm: float | None = None, seed: int = 0) -> DataFrame:
    """Voxel p of the union statistic when foci are drawn from a pool of cells, by each iteration's largest; the null of a voxel is its own, so no clusters are formed.

    ``ma`` has (id, voxel, value), or (voxel, stat) of the mask where the statistic is there already.
    """
    from quillmap.operators.text import checkpointed

    spark = ma.sparkSession
    volumes = cbma.simulated(spark, foci, pool, grid, n_iters, "ale", fwhm=fwhm, seed=seed, least=cbma.NONE_LEFT)
    maxima = checkpointed(volume_maxima(volumes, grid, lambda t: {"stat": -np.expm1(t)}, None))
    seen = cbma.ale_stat(ma, grid.mask(spark)) if "stat" not in ma.columns else ma
    seen = seen.select(F.lit("stat").alias("family"), "voxel", "stat")
    return with_p(seen, maxima, grid, None).drop("p_size", "p_mass")
