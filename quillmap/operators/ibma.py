"""Image-based meta-analysis: one group for each voxel of (id, study_id, voxel, value, varcope)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions import special


def valid(image: DataFrame, aggressive: bool = False, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Rows finite and not 0; with ``aggressive`` only voxels valid in all images."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c)
        ok &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0)
    rows = image.where(ok)
    if not aggressive:
        return rows
    n = image.select(F.countDistinct("id").alias("n"))
    full = rows.groupBy("voxel").agg(F.countDistinct("id").alias("have")).crossJoin(F.broadcast(n)).where("have = n").select("voxel")
    return rows.join(full, "voxel", "left_semi")


def finish(rows: DataFrame, dof: Column | None = None) -> DataFrame:
    """Add p, logp (-log10), and dof to rows with z; with ``dof``, z is a t first and becomes the z of the same p."""
    if dof is None:
        rows = rows.withColumn("_n_", special.z_to_nlogp_udf("z")).withColumn("dof", F.lit(None).cast("double"))
    else:
        rows = rows.withColumn("dof", dof.cast("double")).withColumn("_n_", F.when(F.col("dof") > 0, special.t_to_nlogp_udf("z", "dof")))
        rows = rows.withColumn("z", F.when(F.col("dof") > 0, F.signum("z") * special.nlogp_to_z_udf("_n_")))
    return rows.withColumns({"p": F.exp("_n_"), "logp": -F.col("_n_") / float(np.log(10))}).drop("_n_")


def stouffers(image: DataFrame, weight: Column | None = None, correlation: float | None = None) -> DataFrame:
    """z of each voxel; with ``correlation`` between images of one study, the variance of the sum grows by their products of weights."""
    w = F.lit(1.0) if weight is None else weight
    if correlation is not None:
        per = image.groupBy("voxel", "study_id").agg(F.sum(w * F.col("value")).alias("wz"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.count("*").alias("n"))
        spread = F.col("ww") + correlation * (F.col("w") * F.col("w") - F.col("ww"))
        return per.groupBy("voxel").agg((F.sum("wz") / F.sqrt(F.sum(spread))).alias("z"), F.sum("n").alias("k"))
    return image.groupBy("voxel").agg((F.sum(w * F.col("value")) / F.sqrt(F.sum(w * w))).alias("z"), F.count("*").alias("k"))


def fishers(image: DataFrame) -> DataFrame:
    """-2 sum ln p of one-tailed p values in each direction; the stronger direction gives the sign."""
    rows = image.withColumn("up", special.z_to_nlogp_one_udf("value")).withColumn("down", special.z_to_nlogp_one_udf(-F.col("value")))
    sums = rows.groupBy("voxel").agg((-2 * F.sum("up")).alias("up"), (-2 * F.sum("down")).alias("down"), F.count("*").alias("k"))
    best = sums.withColumn("chi2", F.greatest("up", "down")).withColumn("sign", F.when(F.col("up") >= F.col("down"), 1).otherwise(-1))
    best = best.withColumn("nlogp", F.least(special.chi2_dof_to_nlogp_udf("chi2", (2 * F.col("k")).cast("double")) + float(np.log(2)), F.lit(0.0)))
    return best.select("voxel", "chi2", "k", "nlogp", (F.col("sign") * special.nlogp_to_z_udf("nlogp")).alias("z"))


def weighted_least_squares(image: DataFrame, tau2: float | Column = 0.0) -> DataFrame:
    t = tau2 if isinstance(tau2, Column) else F.lit(float(tau2))
    w = 1 / (F.col("varcope") + t)
    out = image.groupBy("voxel").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("est"), (1 / F.sqrt(F.sum(w))).alias("se"), F.count("*").alias("k"))
    return out.withColumn("z", F.col("est") / F.col("se"))


def between_study(image: DataFrame, method: str = "dl") -> DataFrame:
    """(voxel, tau2) by DerSimonian-Laird's or Hedges' moment estimator, from one pass of sums."""
    y, v = F.col("value"), F.col("varcope")
    if method == "hedges":
        s = image.groupBy("voxel").agg(F.var_samp("value").alias("var"), F.avg("varcope").alias("mean_v"))
        return s.select("voxel", F.greatest(F.lit(0.0), F.coalesce(F.col("var"), F.lit(0.0)) - F.col("mean_v")).alias("tau2"))
    s = image.groupBy("voxel").agg(F.sum(1 / v).alias("w"), F.sum(1 / (v * v)).alias("ww"), F.sum(y / v).alias("wy"), F.sum(y * y / v).alias("wyy"), F.count("*").alias("k"))
    q = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    c = F.col("w") - F.col("ww") / F.col("w")
    return s.select("voxel", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("k") - 1), c), F.lit(0.0))).alias("tau2"))


def random_effects(image: DataFrame, method: str = "dl", knapp_hartung: bool = True) -> DataFrame:
    """est, se, z, p, logp, dof and tau2 of each voxel, by default with Knapp and Hartung's variance and a t of k - 1 degrees. tau2 goes back to the rows by a join on voxel, which reuses the grouping's partitioning."""
    tau = between_study(image, method)
    rows = image.join(tau, "voxel")
    w = 1 / (F.col("varcope") + F.col("tau2"))
    s = rows.groupBy("voxel").agg(F.sum(w).alias("w"), F.sum(w * F.col("value")).alias("wy"), F.sum(w * F.col("value") * F.col("value")).alias("wyy"), F.first("tau2").alias("tau2"), F.count("*").alias("k"))
    est = F.col("wy") / F.col("w")
    se = 1 / F.sqrt(F.col("w"))
    if knapp_hartung:
        se = se * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"), F.col("k") - 1)))
    out = s.select("voxel", "tau2", "k", est.alias("est"), se.alias("se"))
    return finish(out.withColumn("z", F.try_divide(F.col("est"), F.col("se"))), F.col("k") - 1 if knapp_hartung else None)


def one_sample_t(image: DataFrame) -> DataFrame:
    """t over the means of dependent groups (study_id); fewer than two groups give null."""
    groups = image.groupBy("voxel", "study_id").agg(F.avg("value").alias("m"))
    s = groups.groupBy("voxel").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("*").alias("n"))
    t = F.when(F.col("n") > 1, F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
    return s.select("voxel", t.alias("t"), F.when(F.col("n") > 1, F.col("n") - 1).alias("dof"))


def sign_flips(image: DataFrame, n_iters: int = 100) -> DataFrame:
    """(iteration, max_stat): the largest |t| over voxels when whole groups change sign, signs by a hash of (group, iteration).

    Blocks of voxels are the tasks; signs are computed there, so flipped images are never rows.
    """
    from quillmap.operators.cbma import _draws, by_voxels

    groups = by_voxels(image.groupBy("voxel", "study_id").agg(F.avg("value").alias("m")).select("voxel", F.xxhash64("study_id").alias("h"), "m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["voxel", "h"])
        names, at = np.unique(pdf["h"].to_numpy(), return_inverse=True)
        _, first, n = np.unique(pdf["voxel"].to_numpy(), return_index=True, return_counts=True)
        m = pdf["m"].to_numpy()
        squares, out = np.add.reduceat(m * m, first), []
        for it in range(n_iters):
            sign = np.where(_draws(names, np.array([it]), 0)[:, 0] & np.uint64(1), 1.0, -1.0)
            total = np.add.reduceat(sign[at] * m, first)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.abs(total / n / np.sqrt((squares - total * total / n) / (n - 1) / n))
            out.append(float(np.nan_to_num(t[n > 1], posinf=0.0).max(initial=0.0)))
        return pd.DataFrame({"iteration": np.arange(n_iters), "max_stat": out})

    return groups.groupBy("block").applyInPandas(run, "iteration long, max_stat double").groupBy("iteration").agg(F.max("max_stat").alias("max_stat"))


def fixed_effects_hedges(image: DataFrame) -> DataFrame:
    """t and sample_size to Hedges' g and its variance, then weighted least squares."""
    from quillmap.functions.native import d_to_g, t_to_d

    g, v = d_to_g(t_to_d(F.col("value"), F.col("sample_size")), F.col("sample_size"))
    return weighted_least_squares(image.withColumn("varcope", v).withColumn("value", g).where("varcope > 0"))


def likelihood(image: DataFrame, method: str = "ML", by_size: bool = False, points: int = 16, rounds: int = 9) -> DataFrame:
    """est, se, z, tau2 (and sigma2 with ``by_size``) of each voxel by maximum or restricted likelihood.

    The profile likelihood of a tau2 needs four sums of a voxel. Each round takes those
    sums for a grid of tau2 in one grouped pass, as columns of the voxel's row, and narrows the range around the best,
    so no voxel's images are gathered or multiplied; a range shrinks to 2 / (points - 1) in a round.
    """
    first = image.groupBy("voxel").agg(F.var_pop("value").alias("var"), F.avg("value").alias("mean"), F.count("*").alias("k"))
    if by_size:
        spread = image.join(first.select("voxel", "mean"), "voxel").groupBy("voxel").agg(F.sum((F.col("value") - F.col("mean")) ** 2 * F.col("sample_size")).alias("s"), F.count("*").alias("n"))
        sigma = spread.select("voxel", F.greatest(F.lit(1e-12), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))).alias("sigma2"))
        rows = image.join(sigma, "voxel").select("voxel", F.col("value").alias("y"), (F.col("sigma2") / F.col("sample_size")).alias("v"))
        first = first.join(sigma, "voxel")
    else:
        rows, first = image.select("voxel", F.col("value").alias("y"), F.col("varcope").alias("v")), first.withColumn("sigma2", F.lit(None).cast("double"))
    bounds = first.select("voxel", F.lit(0.0).alias("lo"), F.greatest(4 * F.col("var"), F.lit(1e-9)).alias("hi"), "sigma2")

    def sums(rows: DataFrame, n: int) -> DataFrame:
        """(voxel, s): tau2, loss, estimate and weight at n points of a voxel's range."""
        y, v, aggs = F.col("y"), F.col("v"), []
        step = (F.col("hi") - F.col("lo")) / max(n - 1, 1)
        for i in range(n):
            t = F.col("lo") + i * step
            w = 1 / (v + t)
            aggs += [F.sum(F.log(v + t)).alias(f"l{i}"), F.sum(w).alias(f"w{i}"), F.sum(w * y).alias(f"wy{i}"), F.sum(w * y * y).alias(f"wyy{i}")]
        s, out = rows.groupBy("voxel", "lo", "hi").agg(*aggs), []
        for i in range(n):
            l, w, wy, wyy = (F.col(f"{c}{i}") for c in ("l", "w", "wy", "wyy"))
            loss = 0.5 * (l + wyy - wy * wy / w)
            if method == "REML":
                loss = loss + 0.5 * F.log(w)
            out.append(F.struct(loss.alias("loss"), (F.col("lo") + i * step).alias("t"), (wy / w).alias("est"), w.alias("w")))
        return s.select("voxel", F.array_min(F.array(*out)).alias("s") if n > 1 else out[0].alias("s"))

    for _ in range(rounds):
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        best = sums(rows.join(bounds.select("voxel", "lo", "hi"), "voxel"), points).select("voxel", F.col("s.t").alias("tau2"))
        bounds = bounds.select("voxel", "lo", "hi", "sigma2").join(best, "voxel").select("voxel", F.greatest(F.lit(0.0), F.col("tau2") - step).alias("lo"), (F.col("tau2") + step).alias("hi"), "sigma2", "tau2")
        from quillmap.operators.text import checkpointed

        bounds = checkpointed(bounds)
    at = sums(rows.join(bounds.select("voxel", F.col("tau2").alias("lo"), F.col("tau2").alias("hi")), "voxel"), 1)
    out = at.join(bounds.select("voxel", "tau2", "sigma2"), "voxel").select("voxel", F.col("s.est").alias("est"), (1 / F.sqrt("s.w")).alias("se"), "tau2", "sigma2")
    return out.withColumn("z", F.col("est") / F.col("se"))


#: Values of a block of images that a task holds.
BLOCK_VALUES = 4_000_000
#: Images of each side whose pairs a task forms at once, and blocks that are made to give all cores pairs of blocks.
BLOCK_IMAGES, BLOCKS = 1000, 16


def image_correlations(image: DataFrame) -> DataFrame:
    """Pearson's r of every pair of images (a < b) over shared voxels, by products of blocks of images.

    An image is packed into a row first. Each pair of blocks is a task, which gives the pairs of some images at a time, so blocks,
    and with them the copies of an image that are shuffled, are no more than a task's memory and the cores ask for.
    """
    sizes = image.agg(F.count_distinct("voxel").alias("voxels"), F.count_distinct("id").alias("ids")).first()
    blocks = max(1, -(-sizes["ids"] * sizes["voxels"] // BLOCK_VALUES), min(BLOCKS, -(-sizes["ids"] // BLOCK_IMAGES)))
    known = image.select(F.col("id").cast("long").alias("id"), F.col("voxel").cast("long").alias("voxel"), F.col("value").cast("double").alias("value")).where("id is not null and voxel is not null and value is not null")
    packed = known.groupBy("id").agg(F.collect_list("voxel").alias("voxel"), F.collect_list("value").alias("value"))
    rows = packed.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    unit = F.least("own", "other") * blocks + F.greatest("own", "other")
    rows = rows.select(unit.alias("unit"), (F.col("own") <= F.col("other")).alias("first"), "id", "voxel", "value")
    rows = rows.repartitionByRange(blocks * (blocks + 1) // 2, "unit").sortWithinPartitions("unit")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        rest, unit = [], None
        for b in batches:
            own = b.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if rest and own[lo] != unit:
                    yield unit, pa.Table.from_batches(rest)
                    rest = []
                unit = int(own[lo])
                rest.append(b.slice(lo, hi - lo))
        if rest:
            yield unit, pa.Table.from_batches(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, t in units(batches):
            voxels = np.unique(np.concatenate([np.unique(c.flatten().to_numpy()) for c in t["voxel"].chunks]))

            def matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
                """Ids in order, values, 1 where there is one (None: everywhere), and values of each image less their mean, of length 1."""
                ids = part["id"].to_numpy()
                order = np.argsort(ids)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                x, start, count = np.zeros((len(ids), len(voxels))), 0, 0
                places = []
                for v, w in zip(part["voxel"].chunks, part["value"].chunks, strict=True):
                    at = np.repeat(rank[start : start + len(v)], v.value_lengths().to_numpy())
                    places.append((at, np.searchsorted(voxels, v.flatten().to_numpy())))
                    x[places[-1]] = w.flatten().to_numpy()
                    start, count = start + len(v), count + len(at)
                on = None
                if count < x.size:
                    on = np.zeros(x.shape)
                    for p in places:
                        on[p] = 1.0
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = x - x.mean(1, keepdims=True)
                    z /= np.where(x.max(1, initial=-np.inf) == x.min(1, initial=np.inf), np.nan, np.sqrt((z * z).sum(1)))[:, None]
                return ids[order], x, on, z

            same = unit // blocks == unit % blocks
            ids_a, x, on_x, z_x = matrix(t if same else t.filter(t["first"]))
            ids_b, y, on_y, z_y = (ids_a, x, on_x, z_x) if same else matrix(t.filter(pc.invert(t["first"])))
            for i in range(0, len(ids_a), BLOCK_IMAGES):
                for j in range(i if same else 0, len(ids_b), BLOCK_IMAGES):
                    a, b = slice(i, i + BLOCK_IMAGES), slice(j, j + BLOCK_IMAGES)
                    if on_x is None and on_y is None:
                        r = z_x[a] @ z_y[b].T
                        take = None if len(voxels) > 1 else np.zeros(r.shape, bool)
                    else:
                        p, q = (np.ones(v[s].shape) if o is None else o[s] for o, v, s in ((on_x, x, a), (on_y, y, b)))
                        n, sx, sy = p @ q.T, x[a] @ q.T, p @ y[b].T
                        with np.errstate(divide="ignore", invalid="ignore"):
                            r = (n * (x[a] @ y[b].T) - sx * sy) / np.sqrt((n * (x[a] * x[a] @ q.T) - sx * sx) * (n * (p @ (y[b] * y[b]).T) - sy * sy))
                        take = n > 1
                    if same and i == j:
                        take = np.triu(np.ones(r.shape, bool) if take is None else take, 1)
                    out = [np.minimum(ids_a[a][:, None], ids_b[b][None, :]), np.maximum(ids_a[a][:, None], ids_b[b][None, :]), r]
                    out = [c.ravel() if take is None else c[take] for c in out]
                    for lo in range(0, len(out[0]), 1 << 17):
                        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in out], ["a", "b", "r"])

    return rows.mapInArrow(run, "a long, b long, r double")
